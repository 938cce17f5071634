"""Pages as a node table: tags and texts as rows with intervals, by windows; content root and blocks on it.

No parser in Python: one pattern cuts a page into tokens, which become rows. An
end tag closes the nearest open element of its name, so an element's interval is
found among the rows of its name and nesting level. Hidden, consent and chrome
subtrees go by containment of intervals: a running maximum of the ends of
dropped elements. Everything but the last grouping is partitioned by page, with
one shuffle; a page's rows are bounded by the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T

# fixed values: tag sets and patterns that results must equal
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
DROPPED = ("script", "style", "template", "svg", "noscript", "iframe", "canvas", "form")
CHROME = ("nav", "header", "footer")
CONSENT = "(?i)(cookie|consent|gdpr|ccpa|privacy[-_ ]?(banner|notice)|onetrust|cookiebot|truste)"
TRACKING = "(?i)(gtm|googletagmanager|analytics|pixel|hotjar|clarity|fbq|doubleclick)"
HIDDEN = "(?i)([ \t\n]hidden[ \t\n=>/]|aria-hidden[ \t\n]*=[ \t\n]*[\"']?true|style[ \t\n]*=[ \t\n]*[\"'][^\"']*(display[ \t\n]*:[ \t\n]*none|visibility[ \t\n]*:[ \t\n]*hidden))"
#: Elements that the next of their name ends where they have no end tag of their own.
IMPLIED = ("p", "li", "td", "th", "tr", "dt", "dd", "option")
BOXES = ("section", "article", "div", "main", "body")
HEADINGS = ("h1", "h2", "h3")
#: Bytes of bodies whose nodes one task takes.
TASK_BYTES = 2 << 20
_RAW = "|".join(DROPPED)
TOKEN = f"(?is)<!--.*?-->|<![^>]*>|<(?:{_RAW})[ \t\n>][^>]*>?.*?</(?:{_RAW})[ \t\n]*>|</?[a-z][^>]*>|[^<]+|<"
NAME = "^</?([A-Za-z][A-Za-z0-9]*)"


def attribute(token: Column, name: str) -> Column:
    """A quoted attribute's value in a start tag, empty without."""
    return F.regexp_extract(token, f"(?i)[ \t\n]{name}[ \t\n]*=[ \t\n]*[\"']([^\"']*)", 1)


def node_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, kind, tag, token, level, ends, gone): open tags and texts with their place; ``ends`` closes an element's interval, ``gone`` tells dropped subtrees.

    Comments, doctypes and whole elements of dropped tags are no rows. An
    element without its end reaches to the next one of its name where the end
    may be left out, else to the page's end. Null pages have no rows.
    """
    tokens = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.regexp_extract_all(html_col, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", NAME, 1))
    closing, raw = F.startswith("token", F.lit("</")), F.rlike("token", F.lit(f"(?is)^<(?:{_RAW})[ \t\n>].*</"))
    kind = F.when(F.startswith("token", F.lit("<!")) | raw, "none").when(tag == "", "text").when(closing, "close").when(tag.isin(*VOID) | F.endswith("token", F.lit("/>")), "void").otherwise("open")
    rows = tokens.withColumn("tag", tag).withColumn("kind", kind).filter("kind <> 'none'")
    # as many tasks as the bodies need: the windows' sorts hold a task's rows several times over
    size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    rows = rows.repartition(max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), "page_id")
    name = W.partitionBy("page_id", "tag").orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.sum(step).over(name.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("level", (depth + F.when(F.col("kind") == "close", 1).otherwise(0)).cast("int"))
    met = W.partitionBy("page_id", "tag", "level").orderBy("pos")
    page = W.partitionBy("page_id").orderBy("pos")
    whole = W.partitionBy("page_id")
    rows = rows.withColumn("_next", F.lead(F.struct("pos", "kind")).over(met)).withColumn("_same", F.lead("pos").over(name)).withColumn("_last", F.max("pos").over(whole))
    matched = F.when(F.col("_next.kind") == "close", F.col("_next.pos"))
    implied = F.when(F.col("tag").isin(*IMPLIED), F.col("_same") - 1)
    ends = F.when(F.col("kind") == "open", F.coalesce(matched, implied, F.col("_last"))).otherwise(F.col("pos"))
    blob = F.concat_ws(" ", *(attribute(F.col("token"), a) for a in ("id", "class", "data-testid", "role")))
    out = F.col("kind").isin("open", "void") & (F.col("tag").isin(*CHROME, *DROPPED) | blob.rlike(CONSENT) | blob.rlike(TRACKING) | F.rlike("token", F.lit(HIDDEN)))
    rows = rows.withColumn("ends", ends).withColumn("_out", F.when(out, F.col("ends")))
    shade = F.max("_out").over(page.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("gone", F.coalesce(shade >= F.col("pos"), F.lit(False)))
    return rows.filter("kind in ('open', 'text', 'void')").select("page_id", "pos", "kind", "tag", "token", "level", "ends", "gone")


def selector(tag: Column, token: Column) -> Column:
    """A short pointer for a reader: tag#id, tag.class or tag."""
    ident, first = attribute(token, "id"), F.split(F.trim(attribute(token, "class")), "[ \t\n]+")[0]
    return F.concat(tag, F.when(ident != "", F.concat(F.lit("#"), ident)).when(first != "", F.concat(F.lit("."), first)).otherwise(""))


def content_blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, selector, heading, text): the blocks of each page's content root, in place order.

    Root: the first main, else article, else body, else the page. With headings
    (h1 to h3) a block is what follows one inside its innermost box, up to the
    next heading of that box; a heading with nothing behind it gives itself. Without headings each
    innermost section, article, div or paragraph is a block, else the whole text.
    """
    page = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("page_id")
    kept = nodes.filter("not gone")
    spot = lambda t: F.min(F.when((F.col("kind") == "open") & (F.col("tag") == t), F.struct("pos", "ends"))).over(whole)
    kept = kept.withColumn("_root", F.coalesce(spot("main"), spot("article"), spot("body")))
    kept = kept.filter("_root is null or (pos >= _root.pos and pos <= _root.ends)")
    opens = lambda tags: (F.col("kind") == "open") & F.col("tag").isin(*tags)
    later = F.min(F.when(opens(("section", "article", "div")), F.col("pos"))).over(W.partitionBy("page_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing))
    kept = kept.withColumn("_titled", F.max(opens(HEADINGS)).over(whole)).withColumn("_inner", later)
    # innermost box of a heading: the last box opened before it that still holds it
    titles = kept.filter(opens(HEADINGS)).select("page_id", F.col("pos").alias("at"), F.col("ends").alias("title_ends"))
    boxes = kept.filter(opens(BOXES)).select("page_id", F.col("pos").alias("b"), "ends", "tag", "token")
    held = titles.join(boxes, "page_id").filter("b < at and at <= ends").groupBy("page_id", "at").agg(F.max(F.struct("b", "ends", "tag", "token")).alias("box"))
    held = titles.join(held, ["page_id", "at"], "left")
    # the next heading of the same box ends a block; headings of boxes inside belong to it
    stop = F.lead("at").over(W.partitionBy("page_id", "box.b").orderBy("at"))
    end = F.least(F.coalesce(F.col("box.ends"), F.lit(1 << 30)), F.coalesce(stop - 1, F.lit(1 << 30)))
    held = held.select("page_id", "at", "title_ends", end.alias("end"), selector(F.coalesce("box.tag", F.lit("body")), F.coalesce("box.token", F.lit(""))).alias("selector"))
    leaf = opens(("section", "article", "div", "p")) & (F.col("_inner").isNull() | (F.col("_inner") > F.col("ends")))
    kept = kept.withColumn("_leaf", F.max(F.when(leaf, F.struct("pos", "ends", "tag", "token"))).over(page))
    texts = kept.filter("kind = 'text'").withColumn("t", T.collapse(F.col("token"))).filter("t <> ''")
    join = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("pos", "t")))), lambda x: x["t"]), " ")
    # texts meet the headings of their own page only
    told = texts.filter("_titled").select("page_id", "pos", "t").join(held, "page_id").filter("pos > at and (pos <= title_ends or pos <= end)")
    told = told.groupBy("page_id", "at", "selector").agg(join(F.col("pos") <= F.col("title_ends")).alias("heading"), join(F.col("pos") > F.col("title_ends")).alias("body"))
    told = told.select("page_id", F.col("at").alias("pos"), "selector", "heading", F.when(F.col("body") == "", F.col("heading")).otherwise(F.col("body")).alias("text"))
    bare = texts.filter("not _titled").withColumn("_in", F.coalesce(F.col("_leaf.ends") >= F.col("pos"), F.lit(False)))
    bare = bare.withColumn("_any", F.max("_in").over(whole)).filter("_in or not _any")
    at, name = F.when(F.col("_in"), F.col("_leaf.pos")).otherwise(0), F.when(F.col("_in"), selector(F.col("_leaf.tag"), F.col("_leaf.token"))).otherwise("body")
    bare = bare.groupBy("page_id", at.alias("pos"), name.alias("selector")).agg(join(F.lit(True)).alias("text"))
    return told.unionByName(bare.select("page_id", "pos", "selector", F.lit("").alias("heading"), "text")).filter("text <> ''")
