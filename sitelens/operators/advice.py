"""Advice collected from reports of any shape (C33), through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: fields that hold advice, keys of an advice object, severities that are advice
FIELDS = ("recommendations", "proactive_recommendations", "proactive", "suggestions", "opportunities", "advice", "next_steps")
KEYS = ("title", "summary", "detail", "description", "recommendation", "action", "text")
ADVISORY = ("low", "info", "informational", "suggestion")


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _said(value: Column) -> Column:
    """A scalar's text, empty for nothing."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _items(value: Column) -> Column:
    """Elements of an array, a string as its only one, nothing otherwise."""
    none = F.array().cast("array<variant>")
    kind = _kind(value)
    return F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(value, "$", "array<variant>"), none)).when(kind == "STRING", F.array(value)).otherwise(none)


def _text(item: Column) -> Column:
    """A string itself, an object's known keys in their order, nothing otherwise."""
    keys = F.filter(F.array(*(_said(_at(item, f"$.{k}")) for k in KEYS)), lambda t: t != "")
    return F.when(_kind(item) == "STRING", _said(item)).when(_kind(item).startswith("OBJECT"), F.array_join(keys, " ")).otherwise("")


def advice_of(reports: DataFrame, id_col: str = "site_id", report_col: str = "report") -> DataFrame:
    """Reports as JSON text to rows (id, kind, field, at, text), without a shuffle.

    ``rec``: strings and objects in the seven advice fields, lists or lone
    strings, and low findings (title and action). ``action``: the remedy that any
    finding carries. An action is an object with a summary, or anything else as
    text. Elements that are neither strings nor objects, blank texts, null
    fields and texts that aren't JSON give nothing.
    """
    # one-element array: a binding, so that a report is made and parsed once, not once for each use of v
    v = reports.select(F.col(id_col).alias("id"), F.explode(F.array(F.try_parse_json(F.col(report_col)))).alias("v")).filter("v is not null")
    lists = F.array(*(F.struct(F.lit(f).alias("field"), _items(_at(F.col("v"), f"$.{f}")).alias("items")) for f in (*FIELDS, "findings")))
    each = v.select("id", F.explode(lists).alias("l")).select("id", "l.field", F.posexplode("l.items").alias("at", "item"))
    item, told = F.col("item"), lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    raw = _at(item, "$.suggested_action")
    action = F.when(_kind(raw).startswith("OBJECT"), _said(_at(raw, "$.summary"))).otherwise(_said(raw))
    both = F.concat_ws(" ", _said(_at(item, "$.title")), action)
    low = F.lower(_said(_at(item, "$.severity"))).isin(*ADVISORY)
    found = F.filter(F.array(F.when(low, told("rec", both)), F.when(F.trim(action) != "", told("action", both))), lambda t: t.isNotNull())
    # findings that are no objects tell nothing
    all_ = F.when(F.col("field") != "findings", F.array(told("rec", _text(item)))).when(_kind(item).startswith("OBJECT"), found)
    out = each.select("id", "field", "at", F.explode(all_).alias("t")).select("id", "t.kind", "field", "at", "t.text")
    return out.filter(F.trim("text") != "").withColumnRenamed("id", id_col)
