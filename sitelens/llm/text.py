"""Native column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; lower() does that by itself on ASCII texts."""
    text = whole(text)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def count_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space, as long."""
    return F.coalesce(F.regexp_count(whole(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Those runs as an array without nulls."""
    bare = F.btrim(whole(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def boxed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs can clash with a working column."""
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("row"))


def unboxed(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The boxed columns again and ``added``; a boxed column with the name of an added one is replaced in place."""
    new = {name.lower(): c.alias(name) for name, c in added.items()}
    kept = [new.pop(c.lower(), F.col("row")[c].alias(c)) for c in columns]
    return df.select(*kept, *new.values())
