"""Addresses of pages: parts, filters, classes and priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.text import contains_any

#: Files and paths that are not crawled.
FILES = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".pdf", ".zip", ".rar", ".tar", ".gz", ".exe", ".dmg", ".mp4", ".avi", ".mov", ".mp3", ".wav", ".css", ".js", ".json", ".xml", ".txt")
PATHS = ("/login", "/signin", "/signup", "/register", "/cart", "/checkout", "/payment", "/search", "/filter", "/admin", "/wp-admin", "/dashboard", "/blog", "/news", "/article", "/post", "/product", "/item", "/category", "/privacy", "/terms", "/cookie", "/careers/job", "/jobs/", "/apply", "/download", "/upload", "#")
#: Classes of pages by address, first match first.
CLASSES = (
    (r"/(locations?|offices?|branches?|stores?|centers?)[/?]", "locations", 0.95),
    (r"/contact[-_]?us?[/?]", "contact", 0.90),
    (r"/find[-_]?us[/?]", "locations", 0.85),
    (r"/where[-_]?(we[-_]?are|to[-_]?find)[/?]", "locations", 0.85),
    (r"/global[-_]?(offices?|footprint|presence|locations?)[/?]", "locations", 0.90),
    (r"/worldwide[/?]", "locations", 0.85),
    (r"/reach[-_]?us[/?]", "contact", 0.80),
    (r"/about[-_]?(us|company)?[/?]", "about", 0.75),
    (r"/company[/?]", "company", 0.75),
    (r"/careers?/country[/?]", "locations", 0.70),
    (r"/investors?[/?]", "investor", 0.60),
    (r"/(map|store[-_]?locator)[/?]", "locations", 0.95),
)
#: Words in headings by class, order of visits, guessed paths, words and paths of links about places.
HEADING_WORDS = (
    ("locations", ("office", "location", "branch", "center", "store", "find us", "where we are", "global footprint", "worldwide", "our presence")),
    ("contact", ("contact us", "get in touch", "reach us", "contact information")),
    ("about", ("about us", "who we are", "our company", "company profile")),
    ("company", ("company", "organization", "enterprise")),
)
PRIORITY = {"locations": 1, "contact": 1, "about": 2, "company": 2, "investor": 3}
SEEDS = ("/contact", "/contact-us", "/contactus", "/locations", "/offices", "/office", "/branches", "/stores", "/find-us", "/where-we-are", "/global-offices", "/global-locations", "/worldwide", "/about", "/about-us", "/company", "/who-we-are", "/careers/country", "/company/regions", "/investors", "/store-locator", "/map")
LINK_WORDS = ("contact", "location", "office", "branch", "store", "center", "find us", "where we are", "reach us", "get in touch", "global", "worldwide", "international", "country", "region", "about", "company", "who we are", "careers")
LINK_PRIORITY = ((r"(?i)/(locations?|offices?|stores?)[/?]", 1), (r"(?i)/contact", 1), (r"(?i)/global", 2), (r"(?i)/about", 3), (r"(?i)/company", 3), (r"(?i)/careers", 4))
HIGH_PATHS = ("/contact", "/location", "/office", "/store", "/branch", "/find", "/where", "/address", "/about/us")
MEDIUM_PATHS = ("/about", "/company", "/corporate", "/headquarter", "/facility", "/site")


def host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def clean(url: Column) -> Column:
    """Without query and fragment."""
    return F.concat(origin(url), F.when(path(url) == "", "/").otherwise(path(url)))


def is_homepage(url: Column) -> Column:
    return path(url).isin("", "/")


def excluded(url: Column) -> Column:
    low = F.lower(url)
    return reduce(lambda a, b: a | b, (low.endswith(x) for x in FILES)) | contains_any(low, PATHS)


def is_pdf(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".pdf") | low.contains(".pdf?") | low.contains("/pdf/") | low.contains("doc_financials")


def is_document(url: Column) -> Column:
    """Of a text document other than PDF."""
    low = F.lower(url)
    return reduce(lambda a, b: a | b, (low.endswith(x) for x in (".doc", ".docx", ".txt", ".rtf")))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, but for a leading www."""
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    return bare(a) == bare(b)


def page_class(url: Column) -> Column:
    """struct<type, confidence, priority> by the address alone."""
    return _first(F.lower(url), [(p, (t, c)) for p, t, c in CLASSES])


def _first(low: Column, rules) -> Column:
    make = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).cast("double").alias("confidence"), F.lit(PRIORITY.get(t, 4)).alias("priority"))
    out = None
    for pattern, (t, c) in rules:
        out = F.when(low.rlike(pattern), make(t, c)) if out is None else out.when(low.rlike(pattern), make(t, c))
    return out.otherwise(make("general", 0.5))


def heading_class(headings: Column) -> Column:
    """struct<type, confidence> of the best class by words in headings; the first of equals."""
    low = F.lower(headings)
    hits = [F.struct((-F.least(F.lit(0.85), 0.6 + 0.1 * n)).alias("c"), F.lit(i).alias("i"), F.lit(t).alias("type"), n.alias("n")) for i, (t, words) in enumerate(HEADING_WORDS) for n in [sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))]]
    best = F.array_min(F.filter(F.array(*hits), lambda x: x["n"] > 0))
    return F.struct(F.coalesce(best["type"], F.lit("general")).alias("type"), F.coalesce(-best["c"], F.lit(0.0)).alias("confidence"))


def combined_class(url: Column, headings: Column) -> Column:
    """struct<type, confidence, priority>: the class of the address, else of the headings; the greater confidence of both."""
    a, b = page_class(url), heading_class(headings)
    kind = F.when(a["type"] != "general", a["type"]).otherwise(b["type"])
    sure = F.greatest(F.when(a["type"] != "general", a["confidence"]).otherwise(0.0), b["confidence"])
    return F.struct(kind.alias("type"), sure.alias("confidence"), F.coalesce(*(F.when(kind == t, F.lit(p)) for t, p in PRIORITY.items()), F.lit(4)).alias("priority"))


def strategy(priority: Column, confidence: Column) -> Column:
    """struct<aggressive, methods, timeout>."""
    make = lambda a, m, t: F.struct(F.lit(a).alias("aggressive"), F.array(*map(F.lit, m)).alias("methods"), F.lit(t).alias("timeout"))
    full = ("json-ld", "dom-blocks", "heuristics", "maps", "xhr")
    return F.when((priority == 1) & (confidence >= 0.85), make(True, full, 45000)).when((priority <= 2) & (confidence >= 0.70), make(True, full[:4], 30000)).otherwise(make(False, full[:2], 20000))


def is_location_link(href: Column, text: Column) -> Column:
    return contains_any(F.lower(href), LINK_WORDS) | contains_any(F.lower(text), LINK_WORDS)


def link_priority(url: Column) -> Column:
    out = None
    for pattern, p in LINK_PRIORITY:
        out = F.when(url.rlike(pattern), p) if out is None else out.when(url.rlike(pattern), p)
    return out.otherwise(999)


def crawl_tier(url: Column) -> Column:
    low = F.lower(url)
    return F.when(contains_any(low, HIGH_PATHS), 0).when(contains_any(low, MEDIUM_PATHS), 1).otherwise(2)
