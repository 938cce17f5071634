"""Text columns in regular expressions that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that results must equal, written without \b and \w
NOISE = "(?is)<(script|style|template|svg|noscript)[^>]*>.*?</(script|style|template|svg|noscript)>"
CHROME = "(?is)<(nav|header|footer)[^>]*>.*?</(nav|header|footer)>"
PRICING = "(?i)[$€£₹] ?[0-9]|(^|[^0-9A-Za-z_])[0-9][0-9,.]* ?(usd|eur|gbp|inr)([^0-9A-Za-z_]|$)|(^|[^A-Za-z])per +(month|year|user|seat)([^A-Za-z]|$)|/ ?(mo|month|yr|year)([^A-Za-z]|$)"
CONTACT = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]{2,}|[+]?[0-9][0-9 ().-]{8,}[0-9]"
COMPANY = "(?i)(^|[^A-Za-z])(founded|founding|headquarter[a-z]*|employees|customers|clients|established|revenue|arr|offices|certified|iso *[0-9]{4,5}|soc *2|uptime|sla)([^A-Za-z0-9]|$)|(^|[^0-9])[0-9]{1,3}(,[0-9]{3})+([^0-9]|$)|[0-9]+([.][0-9]+)? *%"
QUOTABLE = "(?i)[$£€₹] ?[0-9]|[0-9][0-9,.]* ?%|(^|[^0-9A-Za-z_])[0-9]{4}([^0-9A-Za-z_]|$)|[0-9][0-9,.]* ?(users|customers|clients|employees|countries|years|projects|offices)([^A-Za-z]|$)"
CORROBORATION = "(?i)(press|newsroom|news|media kit|media|award|awards|recognition|in the news|coverage|featured in|case stud|testimonial|customer stor)"
QA = "(?i)(^|[^A-Za-z])(faq|frequently asked|q&a|common questions|questions we)([^A-Za-z]|$)"
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = "[0-9]{3,5}[ .-]?[0-9]{4,6}"
CUSTOMER_VOICE = "(?i)(review|testimonial|rating|customer[-_ ]?(say|story|voice|feedback)|what our|trustpilot|verified buyer|q *& *a)"
SYSTEM_MESSAGE = "(?i)(error|invalid|required field|please enter|try again|not found|failed|we could(n't| not)|something went wrong)"
CTA = "(?i)(^|[^A-Za-z])(contact|get in touch|book a|request a|start (free|your)|sign up|talk to|demo|quote|pricing)([^A-Za-z]|$)"
YEAR = "(^|[^0-9A-Za-z_])(19[9][0-9]|20[0-4][0-9])([^0-9A-Za-z_]|$)"
TITLE_SEPARATOR = " +(::|—|–|[|]|-|·|•|›|») +"
GENERIC_TITLES = (
    "about", "about us", "products", "product", "pricing", "prices", "plans", "contact", "contact us", "news", "blog", "docs",
    "documentation", "home", "services", "support", "careers", "faq", "team", "press", "resources", "solutions", "company", "overview",
)


#: What SQL's trim takes off: blanks of every script (Unicode Zs), not only the ASCII one.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def stripped(html: Column, chrome: bool = False) -> Column:
    """P1, or P2 with ``chrome`` dropped too: visible text of well-formed markup."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), NOISE, " ")
    bare = F.regexp_replace(bare, CHROME, " ") if chrome else bare
    return collapse(F.regexp_replace(bare, "<[^>]*>", " "))


def word_count(text: Column) -> Column:
    """Tokens between blanks with a letter or digit of any script."""
    # from a token's first letter or digit to its end
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}][^ \\t\\n\\r\\f]*"), F.lit(0))).cast("long")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the lower-case words in any case, by plain search."""

    def found(t: Column) -> Column:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out

    return F.exists(F.array(F.lower(text)), found)


# PRICING, CONTACT and COMPANY as tests: what must stand in a match is sought first, so that a text is not tried against
# every alternative at every character; each part begins with the one class of characters it can begin with


def has_pricing(text: Column) -> Column:
    symbol = text.contains("$") | text.contains("€") | text.contains("£") | text.contains("₹")
    amount = "(?i)[0-9](?<![0-9A-Za-z_].)[0-9,.]*+ ?(?:usd|eur|gbp|inr)(?![0-9A-Za-z_])"
    rate = text.contains("/") & text.rlike("(?i)/ ?(?:mo|month|yr|year)(?![A-Za-z])")
    return (symbol & text.rlike("[$€£₹] ?[0-9]")) | rate | text.rlike(amount) | text.rlike("(?i)p(?<![A-Za-z].)er +(?:month|year|user|seat)(?![A-Za-z])")


def has_contact(text: Column) -> Column:
    mail = text.contains("@") & text.rlike("[A-Za-z0-9_.+-]@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]{2}")
    return mail | text.rlike("[0-9][0-9 ().-]{8,}?[0-9]")


def has_company(text: Column) -> Column:
    words = ("found", "headquarter", "employees", "customers", "clients", "established", "revenue", "arr", "offices", "certified", "iso", "soc", "uptime", "sla")
    said = "(?i)(?<![A-Za-z])(?:founded|founding|headquarter[a-z]*|employees|customers|clients|established|revenue|arr|offices|certified|iso *[0-9]{4,5}|soc *2|uptime|sla)(?![A-Za-z0-9])"
    share = text.contains("%") & text.rlike("[0-9] *%")
    return share | text.rlike("[0-9](?<![0-9].)[0-9]{0,2}(?:,[0-9]{3})+(?![0-9])") | (_any(text, words) & text.rlike(said))


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def language(html: Column) -> Column:
    """First subtag of html lang, en without one."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), '(?i)<html[^>]* lang="([^"]*)"', 1)
    return F.substring(F.split(F.when(found == "", "en").otherwise(found), "-")[0], 1, 8)


def brand_segment(text: Column) -> Column:
    """The first segment of a title, the last if the first is generic, a lone one if it has at most five words."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), TITLE_SEPARATOR), trim), lambda s: s != "")
    few = F.size(F.split(trim(text), " +")) <= 5
    many = F.when(F.lower(F.translate(parts[0], "İ", "i")).isin(*GENERIC_TITLES), F.try_element_at(parts, F.lit(-1))).otherwise(F.get(parts, 0))
    return F.when(F.size(parts) > 1, many).when(few, trim(text)).otherwise("")


def source_kind(heading: Column, text: Column, selector: Column) -> Column:
    """P26."""
    blob = F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.coalesce(selector, F.lit("")))
    system = F.coalesce(heading, F.lit("")).rlike(SYSTEM_MESSAGE) | ((F.length(text) < 200) & text.rlike(SYSTEM_MESSAGE))
    return F.when(blob.rlike(CUSTOMER_VOICE), "customer_voice").when(system, "system_message").otherwise("brand_copy")


def years(text: Column) -> Column:
    """P31, counting form: four-digit years 1990 to 2049 that stand alone."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(2)), lambda y: y.cast("int"))


def http_label(status: Column) -> Column:
    """0 and null both read as no response."""
    return F.when(F.coalesce(status, F.lit(0)) == 0, "HTTP no-response").otherwise(F.concat(F.lit("HTTP "), status.cast("string")))


def numbers(text: Column) -> Column:
    """Numbers without thousands separators, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9][0-9,]*(?:[.][0-9]+)?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))))


def quote_form(text: Column) -> Column:
    """Lower case, plain quotes and dashes, single blanks."""
    return F.lower(collapse(F.translate(F.coalesce(text, F.lit("")), "“”‘’–—", "\"\"''--")))


def quote_window(text: Column, pattern: str) -> Column:
    """40 characters before and 60 after the first match, at most 200."""
    return F.substring(trim(F.regexp_extract(text, f"(?s).{{0,40}}?(?i:{pattern}).{{0,60}}", 0)), 1, 200)
