"""Redaction of nested JSON to any depth: flattened to paths, redacted, folded back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import redaction as R


#: Levels that one plan walks; deeper containers are handed on as a shared table.
STRIDE = 8


def flatten(rows: DataFrame, id_col: str = "id", json_col: str = "json", sealed: tuple[str, ...] = ()) -> DataFrame:
    """(id, level, path, parent, key, pos, kind, value): every value of every document, without a shuffle.

    ``path`` is a JSON pointer, ``kind`` object, array or scalar, ``value`` JSON.
    Containers are opened level by level inside a row's task; values under
    ``sealed`` keys (lower case) stay shut. Only containers deeper than a stride are
    written, for the next stride to open. Texts that aren't JSON give nothing.
    """
    none = F.lit(None)
    top = rows.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col)).alias("value")).filter("value is not null")
    top = top.select("id", F.lit(0).alias("level"), F.lit("").alias("path"), none.cast("string").alias("parent"), none.cast("string").alias("key"), F.lit(0).alias("pos"), "value")
    out = None
    while True:
        walked = _typed(top, sealed)
        for _ in range(STRIDE):
            walked = _opened(walked, sealed)
        found = walked.select("id", "level", "path", "parent", "key", "pos", "kind", F.to_json("value").alias("value"))
        out = found if out is None else out.unionByName(found)
        shut = walked.filter("open")
        if shut.isEmpty():
            return out
        shut = scratch.table(shut.select("id", "level", "path", F.to_json("value").alias("value")), "nested-level").withColumn("value", F.parse_json("value"))
        top = _children(shut)


def _typed(values: DataFrame, sealed: tuple[str, ...]) -> DataFrame:
    shape = F.schema_of_variant("value")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("scalar")
    shut = F.coalesce(F.lower("key").isin(*sealed), F.lit(False)) if sealed else F.lit(False)
    return values.withColumn("kind", kind).withColumn("open", (F.col("kind") != "scalar") & ~shut)


def _children(containers: DataFrame) -> DataFrame:
    """What stands directly in the containers ``value``."""
    v = containers.select("id", F.col("level").alias("_level"), F.col("path").alias("_path"), F.col("value").alias("_v"))
    each = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    name = F.replace(F.replace(F.coalesce("key", F.col("pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return each.select("id", (F.col("_level") + 1).alias("level"), F.concat("_path", F.lit("/"), name).alias("path"), F.col("_path").alias("parent"), "key", "pos", "value")


def _opened(walked: DataFrame, sealed: tuple[str, ...]) -> DataFrame:
    """Every row, no longer open, and the children of the open ones, in one pass: an open row is dealt twice, once for itself."""
    own = ("id", "level", "path", "parent", "key", "pos", "value", "kind")
    twice = walked.withColumn("_inner", F.explode(F.when(F.col("open"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    twice = twice.select(*(F.col(c).alias(f"_{c}") for c in own), "_inner", F.when(F.col("_inner"), F.col("value")).alias("_v"))
    each = twice.lateralJoin(walked.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())).filter("not _inner or pos is not null")
    name = F.replace(F.replace(F.coalesce("key", F.col("pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    pick = lambda inner, c: F.when(F.col("_inner"), inner).otherwise(F.col(f"_{c}")).alias(c)
    each = each.select(
        F.col("_id").alias("id"), pick(F.col("_level") + 1, "level"), pick(F.concat("_path", F.lit("/"), name), "path"), pick(F.col("_path"), "parent"), pick(F.col("key"), "key"),
        pick(F.col("pos"), "pos"), pick(F.col("value"), "value"), F.col("_kind").alias("_kind"), "_inner",
    )
    typed = _typed(each, sealed)
    return typed.select("id", "level", "path", "parent", "key", "pos", "value", "kind", (F.col("_inner") & F.col("open")).alias("open"))


def redacted(rows: DataFrame, id_col: str = "id", json_col: str = "json", keep_emails: bool = False) -> DataFrame:
    """(id, level, path, parent, key, pos, kind, json, hidden): flatten's values, redacted; containers have no json unless they are replaced whole."""
    nodes = flatten(rows, id_col, json_col, sealed=R.SENSITIVE_KEYS)
    hidden = F.coalesce(F.lower("key").isin(*R.SENSITIVE_KEYS), F.lit(False))
    said = F.try_variant_get(F.parse_json("value"), "$", "string")
    text = F.when(F.startswith("value", F.lit('"')), F.to_json(F.to_variant_object(F.array(R.redact(said, keep_emails))))).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    plain = F.element_at(F.transform(F.array(text), lambda t: F.substring(t, F.lit(2), F.length(t) - 2)), 1)  # bound, so that a text is redacted once
    own = F.when(hidden, F.lit('"[REDACTED:sensitive_key]"')).when(F.col("kind") == "scalar", plain)
    return nodes.select("id", "level", "path", "parent", "key", "pos", "kind", own.alias("json"), hidden.alias("hidden"))


def leaves_of(nodes: DataFrame) -> DataFrame:
    """(id, path, value): the redacted scalars as JSON; what lies under a sensitive key was never opened."""
    return nodes.filter("kind = 'scalar' or hidden").select("id", "path", F.col("json").alias("value"))


def redact_nested(rows: DataFrame, id_col: str = "id", json_col: str = "json", keep_emails: bool = False) -> tuple[DataFrame, DataFrame]:
    """(leaves, documents): redacted scalars (id, path, value as JSON) and the documents folded back (id, json).

    A value under a sensitive key is replaced whole, whatever its kind; strings
    elsewhere are redacted, other scalars stay. Folding goes from the deepest
    level up; a container gathers its own children only. Who needs leaves alone takes
    ``leaves_of(redacted(rows))``, which writes and shuffles nothing.
    """
    nodes = scratch.table(redacted(rows, id_col, json_col, keep_emails), "nested-nodes")
    return leaves_of(nodes), fold(nodes)


def fold(nodes: DataFrame) -> DataFrame:
    """Documents (id, json) from redacted nodes that a shared table holds."""
    depth = nodes.agg(F.max("level")).first()[0]
    done = None
    for at in range(depth or 0, -1, -1):
        here = nodes.filter(F.col("level") == at)
        if done is not None:
            here = here.join(done.withColumnsRenamed({"parent": "path", "json": "inside"}), ["id", "path"], "left")
        else:
            here = here.withColumn("inside", F.lit(None).cast("string"))
        inside = F.coalesce("inside", F.lit(""))
        whole = F.when(F.col("kind") == "object", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]")))
        here = here.withColumn("json", F.coalesce("json", whole))
        if at == 0:
            return here.select("id", "json")
        quoted = F.to_json(F.to_variant_object(F.array("key")))
        member = F.when(F.col("key").isNull(), F.col("json")).otherwise(F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "json"))
        gathered = here.groupBy("id", "parent").agg(F.sort_array(F.collect_list(F.struct("pos", member.alias("m")))).alias("s"))
        done = scratch.table(gathered.select("id", "parent", F.array_join(F.transform("s", lambda x: x["m"]), ",").alias("json")), "nested-folded")
