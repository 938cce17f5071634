"""Gates on observations, suggestions, events and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import vocabulary as V
from ..spread import ranked

NETWORK = (
    "timeout|connectionerror|connectionreseterror|connectionrefusederror|readtimeout|connecttimeout|sslerror|socketerror|oserror|"
    "remotedisconnected|chunkedencodingerror|toomanyredirects|gaierror|urlerror"
)
PARSER = "unicodedecodeerror|valueerror|jsondecodeerror|parsererror|recursionerror|attributeerror|typeerror|keyerror|indexerror|memoryerror|xmlsyntaxerror"


def classify_error(phase: Column, status: Column, exception: Column, message: Column, attempt: Column) -> tuple[Column, Column]:
    """Category and whether to retry."""
    name, said = F.lower(F.coalesce(exception, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    setup = said.rlike("credential|api key|not configured")
    network = name.rlike(NETWORK) | said.contains("timed out")
    category = (
        F.when(phase == "llm", F.when(setup, "configuration_error").otherwise("provider_failure"))
        .when(status == 429, "transient_network")
        .when(status.between(500, 599), F.when(attempt <= 1, "transient_network").otherwise("website_defect"))
        .when(status.between(400, 499), "website_defect")
        .when(network, "transient_network")
        .when(name.rlike(PARSER), "auditor_limitation")
        .otherwise("unknown")
    )
    failing = said.contains("timeout") | said.contains("rate") | F.coalesce(status, F.lit(0)).between(500, 599)
    retry = (
        F.when(phase == "llm", ~setup & failing)
        .when(status == 429, True).when(status.between(500, 599), True).when(status.between(400, 499), False)
        .otherwise(network)
    )
    return category, retry


def retry_delay(status: Column, retry_after: Column, attempt: Column, backoff: float = 0.5) -> Column:
    """Seconds to wait before an attempt; null where no retry is due. Retry-After in digits wins, both stop at 5 seconds."""
    due = status.isNull() | status.isin(408, 425, 429, 500, 502, 503, 504)
    header = F.when(retry_after.rlike("^[0-9]+$"), F.least(retry_after.cast("double"), F.lit(5.0)))
    return F.when(due & (attempt >= 2), F.coalesce(header, F.least(F.lit(backoff) * F.pow(F.lit(2.0), attempt - 2), F.lit(5.0))))


def recovery_allowed(category: Column, code: Column) -> Column:
    """C11: the closed list of recoveries of each category."""
    out = F.lit(False)
    for name, codes in V.RECOVERIES.items():
        out = out | ((category == name) & code.isin(*codes))
    return out


def audit_status(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites (site_id, pages_analyzed, skills_failed) to complete, partial or failed."""
    blocking = F.col("category").isin("auditor_limitation", "transient_network") & F.col("phase").isin("crawl", "render", "parse")
    seen = events.groupBy("site_id").agg(F.bool_or(blocking).alias("_b"))
    status = F.when(F.col("pages_analyzed") == 0, "failed").when((F.col("skills_failed") > 0) | F.coalesce("_b", F.lit(False)), "partial").otherwise("complete")
    return sites.join(seen, "site_id", "left").select("site_id", status.alias("status"))


def promotion(confidence: Column, severity: Column, refs: Column, pages: Column, verdict: Column) -> Column:
    """Promote, observe or abstain; the unreachable corroboration branch is left out."""
    high = severity.isin("critical", "high")
    return (
        F.when(confidence < 0.65, "abstain")
        .when(high & (refs < 2), "observe").when(high & verdict.isNull(), "observe").when(high & (verdict != "confirm"), "abstain")
        .when(~high & (verdict == "reject"), "abstain").when(confidence >= 0.80, "promote")
        .when((refs >= 2) & (pages >= 2), "promote").otherwise("observe")
    )


def confidence_of(raw: Column) -> Column:
    """Numbers in (1, 100] are percentages; others outside [0, 1] are none."""
    value = F.when((raw > 1) & (raw <= 100), raw / 100).otherwise(raw)
    return F.when((value >= 0) & (value <= 1), F.round(value, 4))


def observe(sections: DataFrame) -> DataFrame:
    """Per site and aspect the first section that matches, and at most two references.

    ``sections``: site_id, seq, text, source_kind. Matches are found in one scan;
    per aspect only the two smallest positions survive, by an aggregate.
    """
    hits = [F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(a).alias("aspect"), F.lit(e).alias("emotion"), F.lit(c).alias("confidence"), F.lit(s).alias("severity"))) for a, e, p, c, s in V.ASPECTS]
    found = sections.select("site_id", "seq", "source_kind", F.explode(F.array_compact(F.array(*hits))).alias("r")).select("site_id", "seq", "source_kind", "r.*")
    first = found.groupBy("site_id", "aspect", "emotion", "confidence", "severity").agg(
        F.min("seq").alias("first"), F.min_by("source_kind", "seq").alias("source_kind"), F.count("*").alias("hits")
    )
    mood = F.when(F.col("emotion").isin("confidence", "trust", "reassurance"), "positive").otherwise("negative")
    kind = F.when(F.col("source_kind") == "customer_voice", "customer_sentiment").otherwise("predicted_visitor_friction")
    return first.select("site_id", "aspect", "emotion", "severity", "confidence", "first", mood.alias("sentiment"), kind.alias("analysis_type"), F.least("hits", F.lit(2)).cast("int").alias("refs"))


def reference_problems(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """Refs (observation, ref, page) that are malformed, were never issued, or belong to another page: observation, ref, problem."""
    issued = sections.select(F.col("evidence_id").alias("ref"), F.col("page_id").alias("_owner"))
    out = refs.join(issued, "ref", "left")
    problem = (
        F.when(~F.col("ref").rlike("^P[0-9]{3,}-S[0-9]{3,}$"), "evidence_id_format")
        .when(F.col("_owner").isNull(), "unknown_evidence_id")
        .when(F.col("page") != F.col("_owner"), "evidence_page_mismatch")
    )
    return out.withColumn("problem", problem).filter("problem is not null").select("observation", "ref", "problem")


def unsupported_numbers(claim: Column, support: Column) -> Column:
    """Numbers claimed that the evidence does not have."""
    return F.array_except(T.numbers(claim), T.numbers(support))


def quotes_found(quotes: DataFrame, texts: DataFrame, words: int = 8) -> DataFrame:
    """Which quotes (quote_id, quote) occur word for word in which texts (text_id, text), in normalised form.

    Texts are met through their ``words``-word shingles: a quote is looked up by
    its first shingle only, so a text sends one row per distinct shingle and
    never meets quotes it can't hold; quotes under ``words`` words are looked up
    by shingles of their own length, one pass for each length that occurs. The
    match itself is then checked on the whole strings. Rows: quote_id, text_id.
    """
    def shingle_at(w: Column, i: Column, k: int | Column) -> Column:
        return F.xxhash64(F.slice(w, i, k))

    def shingles_of(w: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: shingle_at(w, i, k))

    q = quotes.select("quote_id", T.quote_form(F.col("quote")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " "))
    q = q.withColumn("k", F.least(F.size("w"), F.lit(words))).select("quote_id", "q", "k", shingle_at(F.col("w"), F.lit(1), F.col("k")).alias("h"))
    t = texts.select("text_id", F.split(T.quote_form(F.col("text")), " ").alias("w"))
    heads = None
    for k in sorted(r.k for r in q.select("k").distinct().collect()) or [words]:
        found = F.array_distinct(shingles_of(F.col("w"), k))
        one = t.filter(F.size("w") >= k).select("text_id", F.lit(k).alias("k"), F.explode(found).alias("h"))
        heads = one if heads is None else heads.unionByName(one)
    pairs = heads.join(q.select("k", "h", "quote_id"), ["k", "h"]).select("text_id", "quote_id").distinct()
    met = pairs.join(q.select("quote_id", "q"), "quote_id").join(texts, "text_id")
    return met.filter(F.instr(T.quote_form(F.col("text")), F.col("q")) > 0).select("quote_id", "text_id")


def seal(payload: Column, fence: str = "<<<UNTRUSTED>>>") -> Column:
    """JSON without the fence that would close it."""
    return F.concat(F.lit(f"{fence}\n"), F.replace(payload, F.lit(fence), F.lit("")), F.lit(f"\n{fence}"))


def request_guard(chars: Column, secret: Column, call: Column, max_tokens: int = 12000, max_calls: int = 6) -> Column:
    """Ok, or why a request is refused, from the prompt's length in characters (four are a token), whether it holds a secret, and the number of the call."""
    return (
        F.when(call > max_calls, "call_budget").when(F.ceil(chars / 4) > max_tokens, "token_budget").when(secret, "secret").otherwise("ok")
    )


def tolerant_json(text: Column) -> Column:
    """A fenced block, the whole text, the outermost braces or brackets: the first that parses, as VARIANT."""
    tries = (F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1), text, F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.regexp_extract(text, "(?s)(\\[.*\\])", 1))
    return F.coalesce(*(F.try_parse_json(F.nullif(t, F.lit(""))) for t in tries))


def rollup(events: DataFrame) -> DataFrame:
    """Events per site and category, with sequence-free counts of retryable ones."""
    return events.groupBy("site_id", "category").agg(F.count("*").alias("events"), F.count_if("retryable").alias("retryable"))


def limitation_notes(events: DataFrame) -> DataFrame:
    """What a report can't speak of: distinct notes per site with how often and where they first occur, in that order.

    ``events``: site_id, event_id, ts, category, phase, operation, exception, url
    and summary. Defects of the site itself give no note. Repeats meet map-side,
    so only distinct notes are ordered, and a site's notes are ranked by ranges.
    """
    what = F.when(F.coalesce("exception", F.lit("")) == "", "error").otherwise(F.col("exception"))
    note = (
        F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary"))
        .when(F.coalesce("url", F.lit("")) != "", F.concat("operation", F.lit(" failed at "), "url", F.lit(" ("), what, F.lit("): the page is missing")))
        .otherwise(F.concat("phase", F.lit("/"), "operation", F.lit(" failed ("), what, F.lit("): results may be incomplete")))
    )
    said = events.filter(F.coalesce("category", F.lit("")) != "website_defect").withColumn("note", note)
    first = said.groupBy("site_id", "note").agg(F.count("*").alias("times"), F.min(F.struct("ts", "event_id")).alias("at"))
    placed = ranked(first.select("site_id", "note", "times", "at.ts", "at.event_id"), "site_id", [F.col("ts"), F.col("event_id")], "notes")
    return placed.select("site_id", (F.col("rank") + 1).cast("int").alias("place"), "note", "times", "event_id")


def telemetry(calls: DataFrame) -> DataFrame:
    """Calls, characters, tokens (four characters each) and calls by status per site; ``calls``: site_id, chars, status."""
    states = ("ok", "failed", "refused")
    return calls.groupBy("site_id").agg(
        F.count("*").alias("calls"), F.sum("chars").alias("chars"), F.sum(F.ceil(F.col("chars") / 4)).alias("tokens"), *(F.count_if(F.col("status") == s).alias(s) for s in states)
    )


def number_events(events: DataFrame) -> DataFrame:
    """Ids ERR-001 on, in order of time and event."""
    n = F.row_number().over(W.partitionBy("site_id").orderBy("ts", "event_id"))
    return events.withColumn("n", n).withColumn("id", F.concat(F.lit("ERR-"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))))
