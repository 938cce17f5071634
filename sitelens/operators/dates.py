"""Dates on pages with place, context and kind, copyright years, and a site's freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: patterns and words that results must equal; word edges are ASCII
YEAR = "(?<![0-9A-Za-z_])(?:199[0-9]|20[0-4][0-9])(?![0-9A-Za-z_])"
FOUNDING = (
    "(?i)(founded|founding|since|established|est[.]|inception|incorporated|operating since|serving since|in business since"
    "|copyright ©?[ \t\n\r\f]*[0-9]{4}[ \t\n\r\f]*[-–])[^0-9]{0,25}$"
)
COPYRIGHT = "(?i)(?:©|&copy;|\\(c\\)|copyright)[ \t\n\r\f]*([0-9]{4})(?:[ \t\n\r\f]*[-–—][ \t\n\r\f]*([0-9]{2,4}))?"
CLAIMS = (
    ("pricing", ("price", "pricing", "/month", "per month", "plan", "$")),
    ("award", ("award", "winner", "recognit", "vendor", "named", "best ")),
    ("statistic", ("survey", "report", "market", "statist", "according to", "research", "data")),
    ("update stamp", ("last updated", "updated:", "effective", "as of", "revised")),
    ("press", ("press", "announce", "raises", "launch", "release")),
    ("team", ("ceo", "cto", "appointed", "team", "founder")),
)
UNDATED = "undated claim"
_AROUND = 40


def claim_kind(context: Column) -> Column:
    """The first kind with a keyword in the context."""
    low, out = F.lower(context), F.lit(UNDATED)
    for label, words in reversed(CLAIMS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def year_mentions(text: Column) -> Column:
    """Array of (at, year, before, after): every year 1990 to 2049 that stands alone, with 40 characters on both sides.

    Places come from the pieces between the matches, so one pass of the pattern
    finds them and contexts are slices of the whole text.
    """
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p) + 4).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(p)).alias("out"))
    places = F.aggregate(F.split(whole, YEAR, -1), start, step)["out"]
    cut = lambda t, p: F.struct(
        p.alias("at"), F.substring(t, p + 1, F.lit(4)).cast("int").alias("year"),
        F.substring(t, F.greatest(p - _AROUND, F.lit(0)) + 1, F.least(p, F.lit(_AROUND))).alias("before"), F.substring(t, p + 5, F.lit(_AROUND)).alias("after"),
    )
    # one-element array: a binding, so that the text is split once; the last piece has no match behind it
    bound = F.array(F.struct(whole.alias("t"), places.alias("p")))
    return F.flatten(F.transform(bound, lambda b: F.transform(F.slice(b["p"], F.lit(1), F.size(b["p"]) - 1), lambda p: cut(b["t"], p))))


def copyright_year(text: Column, as_of: int) -> Column:
    """The latest copyright year up to next year; of a range its end, two digits in the century of its start."""
    whole = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(whole, F.lit(COPYRIGHT), F.lit(1)).alias("a"), F.regexp_extract_all(whole, F.lit(COPYRIGHT), F.lit(2)).alias("b"))

    def last(pair: Column) -> Column:
        begun, end = pair["a"].cast("int"), F.nullif(pair["b"], F.lit("")).cast("int")
        end = F.when(end < 100, end + F.floor(begun / 100) * 100).otherwise(end)
        return F.greatest(begun, end).cast("int")

    return F.array_max(F.filter(F.transform(pairs, last), lambda y: (y >= 1990) & (y <= as_of + 1)))


def page_dates(pages: DataFrame, as_of: int, text_col: str = "text") -> DataFrame:
    """All columns and stale (array of at, year, kind, context), recent (distinct years, sorted) and copyright_year.

    A year up to two before ``as_of`` is stale, one from ``as_of`` on recent; a year
    behind a founding phrase is neither.
    """
    found = F.filter(year_mentions(F.col(text_col)), lambda m: ~m["before"].rlike(FOUNDING))
    old = F.transform(F.filter("_m", lambda m: m["year"] <= as_of - 2), lambda m: F.struct(
        m["at"].alias("at"), m["year"].alias("year"), claim_kind(F.concat(m["before"], F.substring(m["after"], 1, 30))).alias("kind"),
        T.collapse(F.concat(m["before"], m["year"].cast("string"), F.substring(m["after"], 1, 25))).alias("context"),
    ))
    new = F.array_sort(F.array_distinct(F.transform(F.filter("_m", lambda m: m["year"] >= as_of), lambda m: m["year"])))
    return pages.withColumn("_m", found).withColumns({"stale": old, "recent": new, "copyright_year": copyright_year(F.col(text_col), as_of)}).drop("_m")


def freshness(dates: DataFrame, as_of: int, site_col: str = "site_id") -> DataFrame:
    """D12 per site, from ``page_dates``: stale_mentions, stale_pages, kinds, severity (null where nothing is wrong) and advice.

    A page without a recent year is stale with three stale mentions, or, on a
    site without any recent year, with an old copyright line. Where no page is
    stale, old copyright lines and undated claims become advice. Mentions are
    counted by kind map-side; a site's row is bounded by the kinds.
    """
    old = F.coalesce(F.col("copyright_year") <= as_of - 2, F.lit(False))
    quiet, many = F.size("recent") == 0, F.size("stale") >= 3
    of = lambda kind: F.filter("stale", lambda m: m["kind"] == kind)
    counts = {k: F.sum(F.size(of(k))) for k in (*(c for c, _ in CLAIMS), UNDATED)}
    sites = dates.groupBy(site_col).agg(
        F.sum(F.size("stale")).alias("stale_mentions"), F.bool_or(~quiet).alias("maintained"), F.count_if(quiet & many).alias("_many"), F.count_if(quiet & ~many & old).alias("_line"),
        F.count_if(quiet & many & old).alias("_both"), F.count_if(old).alias("_old"), F.count("copyright_year").alias("_stamped"),
        F.min(F.when(old, F.col("copyright_year"))).alias("oldest_copyright"), F.max("copyright_year").alias("newest_copyright"),
        F.array(*(F.struct((-n).alias("n"), F.lit(k).alias("k")) for k, n in counts.items())).alias("_kinds"),
    )
    line = F.when(F.col("maintained"), 0).otherwise(F.col("_line"))
    sites = sites.withColumn("stale_pages", F.col("_many") + line).withColumn("old_lines", F.col("_old") - F.col("_both") - line)
    wrong = F.col("stale_pages") > 0
    top = F.slice(F.array_sort(F.filter("_kinds", lambda x: x["n"] < 0)), 1, 4)
    advice = F.array_compact(F.array(
        F.when(~wrong & (F.col("old_lines") > 0), "Generate the copyright year from the server clock"),
        F.when(~wrong & (F.col("stale_mentions") > 0) & (F.col("_stamped") == 0), "Date-stamp the factual sections"),
    ))
    return sites.select(
        site_col, "stale_mentions", "stale_pages", "maintained", "oldest_copyright", "newest_copyright",
        F.array_join(F.transform(top, lambda x: F.concat(x["k"], F.lit(" x"), (-x["n"]).cast("string"))), ", ").alias("kinds"),
        F.when(wrong, F.when(F.col("stale_mentions") >= 8, "high").otherwise("medium")).alias("severity"), F.array_join(advice, "; ").alias("advice"),
    )
