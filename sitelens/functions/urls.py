"""URL columns, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: path and query patterns that results must equal
LOW_VALUE_PATH = "(?i)/(cart|checkout|basket|login|signin|sign-in|register|signup|account|my-?account|wishlist|compare|search|logout|password|reset)(/|[?]|$)"
TRANSACTIONAL_PATH = "(?i)/(account|login|signin|sign-in|register|cart|checkout|basket|search|admin|wp-admin|my-?account|profile|logout|password|reset)(/|[?]|$)"
TRACKING = "utm_|gclid|fbclid|mc_cid|mc_eid|msclkid|_ga"
DEEP_PAGE = "(^|[?&])(page|p)=([2-9]|[0-9]{2,})"
PAGE_TYPES = (
    ("pricing", "/(pricing|plans?|packages?|tariff|rate-?card)(/|$|[.])"),
    ("shipping_returns", "/(shipping|delivery|returns?|refunds?|exchange|cancellation)(/|$|[.])"),
    ("faq", "/(faq|faqs|help-?cent(er|re)|questions)(/|$|[.])"),
    ("support", "/(support|help|service|customer-?care|troubleshoot)(/|$|[.])"),
    ("contact", "/(contact|reach-?us|get-?in-?touch|locations?|stores?)(/|$|[.])"),
    ("about", "/(about|who-we-are|our-story|company|team|mission)(/|$|[.])"),
    ("legal", "/(privacy|terms|legal|cookie-?policy|disclaimer|imprint)(/|$|[.])"),
    ("blog", "/(blog|news|articles?|insights?|press|stories|resources?)(/|$|[.])"),
    ("product", "/(products?|item|sku|shop/[^/]+/[^/]|p/|dp/)(/|$|[.]|[^/]+$)"),
    ("category", "/(category|categories|collections?|catalog|shop|services?|solutions?)(/|$|[.])"),
)
SEED_ASSETS = "(?i)[.](pdf|jpe?g|png|gif|webp|svg|ico|css|js|xml|json|zip|gz|mp4|mp3|woff2?|ttf|md|txt)$"
LINK_ASSETS = "(?i)[.](pdf|jpe?g|png|gif|webp|svg|ico|css|js|xml|json|zip|gz|mp4|mp3|woff2?|ttf)$"
NOT_NAVIGABLE = "^(#|mailto:|tel:|javascript:|data:)"


def host(url: Column) -> Column:
    """Authority of an absolute URL as written; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*[?]([^#]*)", 1)


def bare_host(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), "^www[.]", "")


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal up to case and a leading www."""
    return bare_host(a) == bare_host(b)


def canonical_key(url: Column) -> Column:
    """Bare lower host, path without trailing slashes, query kept."""
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", "/").otherwise(p)
    q = url_query(url)
    return F.concat(bare_host(host(url)), p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def low_value(url: Column) -> Column:
    """transactional path, tracking key anywhere in the query, or deep pagination."""
    q = F.lower(url_query(url))
    return path(url).rlike(LOW_VALUE_PATH) | q.rlike(TRACKING) | q.rlike(DEEP_PAGE)


def scope_prefix(url: Column) -> Column:
    """"/" and the first path segment if it has no dot, else empty; used with startswith, so /ab also covers /abc."""
    first = F.regexp_extract(path(url), "^/+([^/]+)", 1)
    return F.when((first == "") | first.contains("."), "").otherwise(F.concat(F.lit("/"), first))


def absolute(base: Column, href: Column) -> Column:
    """A link as an absolute URL without fragment: absolute, scheme-relative, rooted, query-only or relative to the base's folder; dot segments are resolved."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(root, href))
    joined = joined.when(href.startswith("?") | (href == ""), F.concat(root, path(base), href)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    whole = F.regexp_replace(joined, "#.*$", "")
    keep = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    parts = F.aggregate(F.split(F.regexp_replace(path(whole), "^/", ""), "/"), F.array().cast("array<string>"), keep)
    q = F.regexp_extract(whole, "([?].*)$", 1)
    tidy = F.concat(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"), F.array_join(parts, "/"), q)
    return F.when(path(whole).rlike("/[.][.]?(/|$)"), tidy).otherwise(whole)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def page_type(url: Column, title: Column, entry: Column, product: Column, faq: Column) -> Column:
    """Home, then the patterns on the path, then on the title's slug, then schema types."""
    p = path(url)
    slug = F.concat(F.lit("/"), F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lit("-")))
    bare = F.regexp_replace(p, "/+$", "") == ""
    out = F.when(bare & entry, "home")
    for text in (p, slug):
        for kind, pattern in PAGE_TYPES:
            out = out.when(text.rlike(f"(?i){pattern}"), kind)
    return out.when(product, "product").when(faq, "faq").when(bare, "home").otherwise("other")


def local_path(url: Column) -> Column:
    """A file place for a URL: at most 8 sanitised segments of 60 characters, index.html where the last has no dot."""
    clean = F.transform(segments(url), lambda s: F.substring(F.regexp_replace(s, "[^A-Za-z0-9._-]", "_"), 1, 60))
    kept = F.slice(clean, 1, 8)
    last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))
    joined = F.array_join(kept, "/")
    return F.when(joined == "", "index.html").when(last.contains("."), joined).otherwise(F.concat(joined, F.lit("/index.html")))


def slug(url: Column) -> Column:
    """A host's name for files, at most 60 characters."""
    return F.substring(F.regexp_replace(bare_host(host(url)), "[^a-z0-9]+", "-"), 1, 60)


def report_name(url: Column) -> Column:
    """The host without www. and its last label."""
    return F.concat(F.regexp_replace(bare_host(host(url)), "[.][^.]*$", ""), F.lit(".json"))
