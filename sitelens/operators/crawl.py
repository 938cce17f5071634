"""The crawl frontier over captured sites: waves, saturation, expansion, recovery and stop reasons.

Every (site, budget) is a run; all runs advance together, one wave per turn of the
loop. What a run knows (its URLs and their states) and where it stands (pages,
allowances, time) are shared tables, rewritten once a wave; so a sweep over
budgets is a column, not a loop over sites, and the driver sees one flag a wave.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import scratch
from ..functions import urls as U
from ..functions import vocabulary as V
from .access import governed
from .templates import templates


@dataclass(frozen=True)
class Budget:
    """Limits of a crawl; ``deadline_ms`` of captured fetch time, None for none. ``stratified`` False is plain breadth first."""

    budget: str = "extended"
    hard_limit: int = 80
    soft_target: int = 30
    per_template: int = 3
    patience: int = 6
    concurrency: int = 6
    max_depth: int | None = 4
    deeper: int | None = None
    additions: int = 0
    expansions: int = 0
    headroom: float = 0.0
    deadline_ms: int | None = None
    stratified: bool = True


_KINDS = {
    "budget": "string", "hard_limit": "int", "soft_target": "int", "per_template": "int", "patience": "int", "concurrency": "int", "max_depth": "int",
    "deeper": "int", "additions": "int", "expansions": "int", "headroom": "double", "deadline_ms": "long", "stratified": "boolean",
}
#: Sitemap pages put back on the queue where a crawl read one page at most.
RECOVERY = 20


def _literal(budgets: list[Budget]) -> Column:
    return F.array(*(F.struct(*(F.lit(v).cast(_KINDS[k]).alias(k) for k, v in asdict(b).items())) for b in budgets))


def _in_scope(url: Column, entry: Column, assets: str) -> Column:
    scope = U.scope_prefix(entry)
    return U.same_site(U.host(url), U.host(entry)) & ((scope == "") | F.startswith(U.path(url), scope)) & ~U.path(url).rlike(assets)


def _allowed(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``rows`` (site, url, ...) with may: whether robots.txt lets the auditor fetch the URL."""
    if rules is None:
        return rows.withColumn("may", F.lit(True))
    place = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    rows = rows.withColumn("_path", place)
    asked = rows.select(F.col("site").alias("site_id"), F.lit(V.AUDITOR).alias("agent"), F.col("_path").alias("path")).distinct()
    said = governed(rules, asked).groupBy(F.col("site_id").alias("site"), F.col("path").alias("_path")).agg(F.bool_and("allowed").alias("may"))
    return rows.join(said, ["site", "_path"], "left").withColumn("may", F.coalesce("may", F.lit(True))).drop("_path")


def _start(entries: DataFrame, seeds: DataFrame, budgets: list[Budget], rules: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(runs, known) before the first wave: a run's entry, then its sitemap's useful pages by rank."""
    runs = entries.select("site", F.col("url").alias("entry"), F.explode(_literal(budgets)).alias("b")).select("site", "entry", "b.*")
    zero = lambda kind="int": F.lit(0).cast(kind)
    runs = runs.select(
        F.concat_ws("\1", "budget", "site").alias("run"), "*", zero().alias("pages"), zero().alias("ok"), zero().alias("since"), zero().alias("expanded"),
        zero("long").alias("spent"), zero().alias("waves"), zero().alias("phase"), F.lit(None).cast("string").alias("stop"),
    )
    runs = scratch.table(runs, "crawl-runs")
    begun = runs.select("run", "site", F.col("entry").alias("url"), zero().alias("depth"), zero("long").alias("seq"))
    listed = runs.filter("stratified").select("run", "site", "entry").join(seeds, "site")
    listed = listed.filter(_in_scope(F.col("url"), F.col("entry"), U.SEED_ASSETS) & ~U.low_value(F.col("url")))
    listed = listed.select("run", "site", "url", F.lit(1).alias("depth"), F.col("rank").cast("long").alias("seq"))
    first = begun.unionByName(listed).groupBy("run", "site", U.canonical_key(F.col("url")).alias("key"))
    known = first.agg(F.min(F.struct("seq", "depth", "url")).alias("k")).select("run", "site", "key", "k.url", "k.depth", "k.seq")
    known = _allowed(known, rules).withColumn("state", F.when(F.col("may"), "queued").otherwise("skipped")).drop("may")
    return runs, scratch.table(known.withColumn("ok", F.lit(None).cast("boolean")), "crawl-known")


def _decided(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Runs that have not stopped, with queue and what they do next: fetch, expand, recover or a stop reason."""
    need = counts.join(runs.select("run", "per_template"), "run").groupBy("run").agg(
        F.sum("queued").alias("queue"), F.bool_or((F.col("sampled") < F.col("per_template")) & (F.col("queued") > 0)).alias("wanting")
    )
    here = runs.filter("stop is null").join(need, "run", "left").withColumn("queue", F.coalesce("queue", F.lit(0))).withColumn("wanting", F.coalesce("wanting", F.lit(False)))
    late = F.coalesce(F.col("spent") >= F.col("deadline_ms"), F.lit(False))
    saturated = F.col("stratified") & (F.col("pages") >= F.col("soft_target")) & (F.col("since") >= F.col("patience")) & ~F.col("wanting")
    left = F.coalesce(1 - F.col("spent") / F.col("deadline_ms"), F.lit(0.0))
    widen = (F.col("expanded") < F.col("expansions")) & (left >= F.col("headroom"))
    next_ = (
        F.when(F.col("queue") == 0, F.when((F.col("pages") == 0) & (F.col("skipped") > 0), "robots_disallowed_auditor").otherwise("queue_exhausted"))
        .when(F.col("pages") >= F.col("hard_limit"), "page_limit").when(late, "exploration_deadline")
        .when(saturated & widen, "expand").when(saturated, "saturated").otherwise("fetch")
    )
    again = F.col("stratified") & (F.col("phase") == 0) & (F.col("ok") <= 1) & ~F.col("next").isin("fetch", "expand", "exploration_deadline", "page_limit")
    return here.withColumn("next", next_).withColumn("next", F.when(again, F.concat(F.lit("recover/"), "next")).otherwise(F.col("next")))


def _wave(pool: DataFrame, counts: DataFrame, decided: DataFrame, widest: int) -> DataFrame:
    """The next URLs of every run that fetches: least sampled template first, then shallowest, then in order of discovery.

    A template's r-th candidate counts as one of ``sampled + r`` samples, so the
    picks of a wave spread over templates. Ranks under a literal limit are cut
    before the shuffle.
    """
    room = decided.filter("next = 'fetch'").select("run", "stratified", F.least("concurrency", F.col("hard_limit") - F.col("pages")).alias("room"))
    rows = pool.filter("state = 'queued'").join(room, "run").join(counts.select("run", "template", "sampled"), ["run", "template"])
    rows = rows.withColumn("depth_", F.when(F.col("stratified"), F.col("depth")).otherwise(0)).withColumn("sampled_", F.when(F.col("stratified"), F.col("sampled")).otherwise(0))
    shape = F.when(F.col("stratified"), F.col("template")).otherwise("")
    rows = rows.withColumn("shape", shape).withColumn("r", F.row_number().over(W.partitionBy("run", "shape").orderBy("depth_", "seq"))).filter(F.col("r") <= widest)
    order = F.when(F.col("stratified"), F.col("sampled_") + F.col("r")).otherwise(0)
    rows = rows.withColumn("turn", order).withColumn("place", F.row_number().over(W.partitionBy("run").orderBy("turn", "depth_", "seq"))).filter(F.col("place") <= widest)
    rows = rows.filter(F.col("place") <= F.col("room"))
    fresh = (F.col("sampled") == 0) & (F.col("place") == F.min("place").over(W.partitionBy("run", "template")))
    return rows.select("run", "site", "key", "url", "depth", "place", fresh.alias("fresh"))


def _found(wave: DataFrame, runs: DataFrame, known: DataFrame, rules: DataFrame | None, number: int) -> DataFrame:
    """URLs that the wave's readable pages link to and the run doesn't know yet."""
    links = wave.filter("ok").join(runs.select("run", "entry", "max_depth", "stratified"), "run")
    links = links.select("run", "site", "entry", "max_depth", "stratified", "depth", "place", F.col("url").alias("_from"), F.posexplode("links").alias("at", "href"))
    links = links.filter(~F.col("href").rlike(U.NOT_NAVIGABLE)).withColumn("url", U.absolute(F.col("_from"), F.col("href")))
    links = links.filter(_in_scope(F.col("url"), F.col("entry"), U.LINK_ASSETS) & ~(F.col("stratified") & U.low_value(F.col("url"))))
    seq = F.lit(number).cast("long") * (1 << 42) + F.col("place") * F.lit(1 << 26).cast("long") + F.col("at")
    links = links.select("run", "site", U.canonical_key(F.col("url")).alias("key"), "url", (F.col("depth") + 1).alias("depth"), seq.alias("seq"), F.coalesce(F.col("depth") >= F.col("max_depth"), F.lit(False)).alias("late"))
    one = links.groupBy("run", "site", "key").agg(F.min(F.struct("seq", "url", "depth", "late")).alias("k")).select("run", "site", "key", "k.*")
    new = _allowed(one.join(known.select("run", "key"), ["run", "key"], "left_anti"), rules)
    state = F.when(~F.col("may"), "skipped").when(F.col("late"), "deferred").otherwise("queued")
    return new.select("run", "site", "key", "url", "depth", "seq", state.alias("state"), F.lit(None).cast("boolean").alias("ok"))


def _recovered(decided: DataFrame, seeds: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Per recovering run the first sitemap pages not fetched yet, low-value ones too."""
    todo = decided.filter("next like 'recover/%'").select("run", "site", "entry").join(seeds, "site")
    todo = todo.filter(_in_scope(F.col("url"), F.col("entry"), U.SEED_ASSETS)).withColumn("key", U.canonical_key(F.col("url")))
    todo = todo.join(known.filter("state in ('fetched', 'skipped')").select("run", "key"), ["run", "key"], "left_anti")
    todo = todo.groupBy("run", "site", "key").agg(F.min(F.struct("rank", "url")).alias("k")).select("run", "site", "key", "k.url", "k.rank")
    n = F.row_number().over(W.partitionBy("run").orderBy("rank", "key"))
    return todo.withColumn("n", n).filter(F.col("n") <= limit).select("run", "site", "key", "url", "n")


def crawl(entries: DataFrame, seeds: DataFrame, captured: DataFrame, budgets: list[Budget], rules: DataFrame | None = None, recovery: int = RECOVERY) -> tuple[DataFrame, DataFrame]:
    """(runs, known) when every run has stopped.

    ``entries`` (site, url), one a site; ``seeds`` (site, url, rank) the pages of
    its sitemap; ``captured`` (site, key, ok, links, ms) what a fetch of a canonical
    key gives, other keys are fetched without an answer; ``rules`` as
    ``robots_rules`` gives them. Per run: pages, ok, expanded, spent, waves and
    stop, one of queue_exhausted, page_limit, exploration_deadline, saturated and
    robots_disallowed_auditor. URLs that robots.txt shuts are skipped where they
    are found. A run with one readable page at most takes up to ``recovery``
    sitemap pages, once. Sites without an entry have no run; nulls in seeds and
    links are passed over.
    """
    seeds, captured = seeds.filter("url is not null"), captured.dropDuplicates(["site", "key"])
    runs, known = _start(entries, seeds, budgets, rules)
    widest, number = max(b.concurrency for b in budgets), 0
    while not runs.filter("stop is null").isEmpty():
        number += 1
        live = runs.filter("stop is null").select("run")
        skipped = known.groupBy("run").agg(F.count_if(F.col("state") == "skipped").alias("skipped"))
        pool = scratch.table(templates(known.filter("state in ('queued', 'fetched')").join(live, "run"), "run"), "crawl-pool")
        counts = scratch.table(pool.groupBy("run", "template").agg(F.count_if(F.col("state") == "fetched").alias("sampled"), F.count_if(F.col("state") == "queued").alias("queued")), "crawl-counts")
        decided = scratch.table(_decided(runs.join(skipped, "run", "left"), counts), "crawl-decided")
        wave = _wave(pool, counts, decided, widest).join(captured.select("site", "key", F.col("ok").alias("_ok"), "links", "ms"), ["site", "key"], "left")
        wave = scratch.table(wave.withColumn("ok", F.coalesce("_ok", F.lit(False))).drop("_ok"), "crawl-wave")
        back = scratch.table(_recovered(decided, seeds, known, recovery), "crawl-back")
        found = _found(wave, decided, known, rules, number)

        # what is known: fetched, released or put back, and found
        marks = wave.select("run", "key", F.lit("fetched").alias("_state"), F.col("ok").alias("_ok"), F.lit(None).cast("long").alias("_n"))
        marks = marks.unionByName(back.select("run", "key", F.lit("queued").alias("_state"), F.lit(None).cast("boolean").alias("_ok"), F.col("n").cast("long").alias("_n")))
        release = decided.filter("next = 'expand' and deeper is not null and (max_depth is null or deeper > max_depth)").select("run", F.lit(True).alias("_out"))
        old = known.join(marks, ["run", "key"], "left").join(release, "run", "left")
        freed = F.when((F.col("state") == "deferred") & F.coalesce("_out", F.lit(False)), "queued").otherwise(F.col("state"))
        seq = F.when(F.col("_n").isNotNull(), F.lit(number).cast("long") * (1 << 42) + F.col("_n")).otherwise(F.col("seq"))
        old = old.select("run", "site", "key", "url", F.when(F.col("_n").isNotNull(), 1).otherwise(F.col("depth")).alias("depth"), seq.alias("seq"), F.coalesce("_state", freed).alias("state"), F.coalesce("_ok", "ok").alias("ok"))
        put = back.join(known.select("run", "key"), ["run", "key"], "left_anti")
        put = put.select("run", "site", "key", "url", F.lit(1).alias("depth"), (F.lit(number).cast("long") * (1 << 42) + F.col("n")).alias("seq"), F.lit("queued").alias("state"), F.lit(None).cast("boolean").alias("ok"))
        next_known = scratch.table(old.unionByName(found).unionByName(put), "crawl-known")

        # where runs stand
        read = wave.groupBy("run").agg(F.count("*").alias("_n"), F.count_if("ok").alias("_ok"), F.max(F.when(F.col("fresh"), F.col("place"))).alias("_fresh"), F.max("ms").alias("_ms"))
        some = back.groupBy("run").agg(F.lit(True).alias("_back"))
        step = runs.join(decided.select("run", "next"), "run", "left").join(read, "run", "left").join(some, "run", "left")
        expand, recover = F.coalesce(F.col("next") == "expand", F.lit(False)), F.coalesce(F.col("next").startswith("recover/") & F.col("_back"), F.lit(False))
        n = F.coalesce("_n", F.lit(0)).cast("int")
        since = F.when(expand | recover, 0).when(F.col("_fresh").isNotNull(), n - F.col("_fresh")).otherwise(F.col("since") + n)
        lift = expand & F.coalesce((F.col("deeper") > F.col("max_depth")) | F.col("max_depth").isNull(), F.lit(False)) & F.col("deeper").isNotNull()
        going = F.col("next").isNull() | F.col("next").isin("fetch", "expand") | recover
        stop = F.coalesce("stop", F.when(~going, F.regexp_replace("next", "^recover/", "")))
        changed = {
            "per_template": F.when(expand, F.col("per_template") + F.col("additions")).otherwise(F.col("per_template")),
            "max_depth": F.when(lift, F.col("deeper")).otherwise(F.col("max_depth")), "pages": F.col("pages") + n, "ok": F.col("ok") + F.coalesce("_ok", F.lit(0)).cast("int"),
            "since": since, "expanded": F.col("expanded") + expand.cast("int"), "spent": F.col("spent") + F.coalesce("_ms", F.lit(0)), "waves": F.col("waves") + (n > 0).cast("int"),
            "phase": F.col("phase") + recover.cast("int"), "stop": stop,
        }
        next_runs = scratch.table(step.select(*(changed.get(c, F.col(c)).alias(c) for c in runs.columns)), "crawl-runs")
        for done in (runs, known, pool, counts, decided, wave, back):
            scratch.release(done)
        runs, known = next_runs, next_known
    return runs, known


def crawl_report(runs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per site and budget: what was read, the templates among it, what is left, and why the crawl ended."""
    shapes = templates(known.filter("state = 'fetched'"), "run").groupBy("run").agg(F.count_distinct("template").alias("templates"), F.max("depth").alias("depth"))
    left = known.groupBy("run").agg(F.count("*").alias("discovered"), F.count_if(F.col("state").isin("queued", "deferred")).alias("unvisited"))
    out = runs.join(shapes, "run", "left").join(left, "run", "left")
    return out.select(
        "site", "budget", "pages", "ok", F.coalesce("templates", F.lit(0)).alias("templates"), F.coalesce("depth", F.lit(0)).alias("depth"), "discovered", "unvisited",
        "expanded", "waves", "spent", "stop",
    )
