"""Redaction of credentials and personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels and patterns in the order they apply
PATTERNS = (
    ("api_key", r"(?i)\bsk-ant-[A-Za-z0-9_\-]{8,}"),
    ("api_key", r"\bsk-[A-Za-z0-9]{16,}"),
    ("api_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api_key", r"\bgh[pousr]_[A-Za-z0-9]{16,}"),
    ("api_key", r"(?i)\bxox[baprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{12,}"),
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("session_id", r"(?i)\b(?:sessionid|session_id|sid|phpsessid|jsessionid)\s*[=:]\s*[A-Za-z0-9._\-]{8,}"),
    ("credential", r"""(?i)\b(?:api[_\-]?key|secret|password|passwd|token|access[_\-]?key)\s*[=:]\s*["']?[A-Za-z0-9._\-]{8,}["']?"""),
    ("card_number", r"\b(?:\d[ \-]?){13,19}\b"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ \-]?)?(?:\(\d{2,4}\)[ \-]?)?\d{3,5}[ \-]\d{3,5}(?:[ \-]\d{2,5})?(?![\w.])"),
)
PERSONAL = ("card_number", "email", "phone")
FORBIDDEN_HEADERS = (
    "authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token",
    "authentication", "www-authenticate", "x-amz-security-token",
)
SENSITIVE_KEYS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "authorization", "cookie", "cookies", "session",
    "sessionid", "session_id", "credit_card", "card_number", "cvv", "ssn", "otp", "pin",
)


def _unicode(pattern: str) -> str:
    """Java reads \\b, \\w, \\d and \\s as Unicode with (?U), as the labels' owners do."""
    return f"(?U){pattern}"


def _cards(text: Column) -> Column:
    """Digit runs that pass the Luhn test, replaced one by one; the others stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_unicode(PATTERNS[10][1])), F.lit(0)))
    cards = F.filter(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")))
    return F.aggregate(cards, text, lambda out, m: F.replace(out, m, F.lit("[REDACTED:card_number]")))


#: Words without one of which no credential pattern matches, in lower case; those of the second row also need = or :.
HINTS = ("sk-", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyj", "bearer", "-----begin ")
ASSIGNED = ("sid", "session", "api", "secret", "passw", "token", "access")
DIGITS = r"\d(?:\d{2}[ \-]\d{3}|(?:[ \-]?\d){12})"


def _hinted(text: Column) -> Column:
    """Whether a credential pattern may match: fixed words, found by plain search in the text folded as Java's Unicode case does."""

    def any_of(t: Column, words: tuple[str, ...]) -> Column:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out

    folded = F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))
    return F.exists(F.array(folded), lambda t: any_of(t, HINTS) | (any_of(t, ("=", ":")) & any_of(t, ASSIGNED)))


def redact(text: Column, keep_emails: bool = False) -> Column:
    """Every pattern in order; null becomes empty. A text that no pattern can match is left without trying them."""
    text = F.coalesce(text, F.lit(""))
    may = text.contains("@") | _hinted(text) | text.rlike(_unicode(DIGITS))
    return F.when(may, _every(text, keep_emails)).otherwise(text)


def _every(out: Column, keep_emails: bool) -> Column:
    for label, pattern in PATTERNS:
        if label == "card_number":
            out = _cards(out)
        elif not (label == "email" and keep_emails):
            out = F.regexp_replace(out, _unicode(pattern), f"[REDACTED:{label}]")
    return out


def removed(redacted: Column) -> Column:
    """Labels in a redacted text, one per removal."""
    return F.regexp_extract_all(redacted, F.lit(r"\[REDACTED:([a-z_]+)\]"), F.lit(1))


def contains_secret(text: Column) -> Column:
    """Any credential pattern; personal data don't count."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit(False)
    for label, pattern in PATTERNS:
        if label not in PERSONAL:
            out = out | text.rlike(_unicode(pattern))
    return _hinted(text) & out


def scrub(message: Column, limit: int = 300) -> Column:
    """One line without paths and credentials, at most ``limit`` characters."""
    line = F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"\s+", " "))
    return F.substring(redact(F.regexp_replace(line, r"(?:[A-Za-z]:\\|/)(?:[\w .\-]+[\\/])+[\w .\-]+", "[path]")), 1, limit)


def redact_headers(headers: Column) -> Column:
    """Credential headers dropped, names lowered, values redacted."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*FORBIDDEN_HEADERS))
    return F.transform_values(F.map_from_entries(F.transform(F.map_entries(kept), lambda e: F.struct(F.lower(e["key"]), e["value"]))), lambda k, v: redact(v))


def redact_map(data: Column) -> Column:
    """Values of sensitive keys replaced, the others redacted."""
    return F.transform_values(data, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[REDACTED:sensitive_key]")).otherwise(redact(v)))
