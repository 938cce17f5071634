"""Names that a page gives its owner, as column expressions over parsed slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words and patterns that results must equal
LEGAL_SUFFIXES = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "plc", "gmbh", "ag", "sa", "bv", "srl", "sl", "pvt", "pte", "nv", "llp", "lp", "kk", "oy", "oyj",
    "ab", "aps", "pty", "ptyltd", "coltd", "sarl", "spa", "kg", "cokg", "holding", "holdings",
)
LEADING_WORDS = (
    "a", "an", "the", "our", "your", "his", "her", "its", "their", "this", "that", "these", "those", "we", "you", "they", "it", "all", "any", "some", "every", "each",
    "both", "more", "most", "many", "such", "one", "two", "if", "when",
)
STOP_NAMES = (
    "home", "about", "contact", "products", "product", "pricing", "welcome", "blog", "news", "documentation", "docs", "services", "overview", "menu", "login",
    "search", "support", "privacy policy", "terms of service", "us",
)
GENERIC_TITLES = (
    "about", "about us", "products", "product", "pricing", "prices", "plans", "contact", "contact us", "news", "blog", "docs", "documentation", "home", "services",
    "support", "careers", "faq", "team", "press", "resources", "solutions", "company", "overview",
)
ORG_TYPES = (
    "organization", "corporation", "localbusiness", "onlinebusiness", "newsmediaorganization", "educationalorganization", "govermentorganization", "ngo",
    "performinggroup", "sportsorganization", "medicalorganization", "airline", "store", "restaurant",
)
SEPARATOR = r"\s+(?:::|—|–|\||-|·|•|›|»)\s+"
WORD = r"[\p{L}\p{N}_]"
PHRASE = r"[A-Z][\p{L}\p{N}_&'’.\-]*(?:\s+[A-Z][\p{L}\p{N}_&'’.\-]*){0,4}"
BODY = (
    ("body 'Welcome to'", rf"\bWelcome to\s+({PHRASE})"),
    ("body 'formerly'", rf"\b(?i:formerly|previously known as|f/k/a|rebranded from)\s+({PHRASE})"),
    ("body 'division of'", rf"\b(?i:a division of|a subsidiary of|part of|an? .{{0,20}}company of)\s+({PHRASE})"),
)
FOOTER = r"(?:©|&copy;|\(c\)|copyright)\s*(?:\d{4}\s*[-–]\s*)?\d{4}\s+([A-Z][^.|\n]{2,60}?)(?:\.|,?\s*All rights|,?\s*All Rights|$)"
ABOUT = rf"^About\s+({PHRASE})$"
_EDGES = " \t\n\"'“”‘’,;:·|-–—"


def tidy(name: Column) -> Column:
    """One line up to its first sentence end, without quotes, separators and closing punctuation."""
    line = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    sentence = F.regexp_replace(line, r"(?<=[.!?])\s.*$", "")
    return F.regexp_replace(F.btrim(sentence, F.lit(_EDGES)), "[.,;:]+$", "")


def normal(name: Column) -> Column:
    """Lower words of a name without possessives, punctuation and legal suffixes of up to three trailing words."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(tidy(name)), rf"['’]s(?!{WORD})", ""), rf"[^\p{{L}}\p{{N}}_\s&]", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")

    def shorter(acc: Column, _: Column) -> Column:
        ends = lambda k: (F.size(acc) > k) & F.array_join(F.slice(acc, -k, k), "").isin(*LEGAL_SUFFIXES)
        cut = lambda k: F.slice(acc, F.lit(1), F.size(acc) - k)
        return F.when(ends(3), cut(3)).when(ends(2), cut(2)).when(ends(1), cut(1)).otherwise(acc)

    # a fold, so that the words are bound once; a name has few suffixes to lose
    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), words, shorter), " ")


def acceptable(name: Column) -> Column:
    """Of 3 to 60 characters and six words at most, with a capital and two letters, no stop name, no leading article or pronoun."""
    words = F.split(name, r"\s+")
    return (
        F.length(name).between(3, 60) & (F.size(words) <= 6) & name.rlike(r"\p{Lu}") & name.rlike("[A-Za-z]{2}") & ~F.lower(name).isin(*STOP_NAMES)
        & ~F.lower(F.get(words, 0)).isin(*LEADING_WORDS) & ~normal(name).isin(*STOP_NAMES)
    )


def brand(title: Column) -> Column:
    """The first part of a title, the last where the first is generic; a lone part of at most five words."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), SEPARATOR), F.trim), lambda p: p != "")
    lone = F.when(F.size(F.split(F.trim(title), r"\s+")) <= 5, F.trim(title)).otherwise("")
    return F.coalesce(F.when(F.size(parts) > 1, F.when(normal(F.get(parts, 0)).isin(*GENERIC_TITLES), F.element_at(parts, -1)).otherwise(F.get(parts, 0))).otherwise(lone), F.lit(""))


def identity_names(title: Column, metas: Column, headings: Column, entities: Column, body: Column) -> Column:
    """Array of (name, slot) that a page's slots give.

    ``metas``: map of meta keys; ``headings``: array of (level, text);
    ``entities``: array of (types, slots), slots an array of (slot, value) of one
    JSON-LD object. Each slot is an array of candidates; all are tidied and
    filtered in one place.
    """
    given = lambda slot, raw: F.transform(raw, lambda x: F.struct(x.alias("raw"), F.lit(slot).alias("slot")))
    titles = F.array(F.struct(brand(title).alias("raw"), F.lit("title").alias("slot")), *(F.struct(brand(metas[k]).alias("raw"), F.lit(k).alias("slot")) for k in ("og:title", "og:site_name")))
    first = F.slice(F.filter(headings, lambda h: h["level"] == 1), 1, 1)
    tops = given("h1", F.transform(first, lambda h: F.regexp_replace(h["text"], r"^\s*Welcome to\s+", "")))
    about = given("'About' heading", F.filter(F.transform(headings, lambda h: F.regexp_extract(F.trim(h["text"]), ABOUT, 1)), lambda x: x != ""))
    owners = F.filter(entities, lambda e: F.exists(e["types"], lambda t: F.lower(t).isin(*ORG_TYPES)))
    stated = F.transform(F.flatten(F.transform(owners, lambda e: e["slots"])), lambda s: F.struct(s["value"].alias("raw"), F.concat(F.lit("json-ld "), s["slot"]).alias("slot")))
    said = [given(slot, F.regexp_extract_all(body, F.lit(pattern), F.lit(1))) for slot, pattern in BODY]
    foot = given("footer copyright", F.filter(F.array(F.regexp_extract(body, FOOTER, 1)), lambda x: x != ""))
    tidied = F.transform(F.concat(titles, tops, stated, about, *said, foot), lambda s: F.struct(tidy(s["raw"]).alias("name"), s["slot"].alias("slot")))
    return F.filter(tidied, lambda s: (s["name"] != "") & acceptable(s["name"]))
