"""Scores, levels and labels of a location row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.address import coordinate, lookup
from geoloom.functions.text import present

#: What each field given adds to the score.
WEIGHTS = {"location_name": 10, "location_address": 20, "latitude": 15, "longitude": 15, "country_iso3": 10, "postcode": 8, "state": 5, "street_or_city": 5, "activity": 5, "footprint": 3, "height": 2, "phone": 1, "email": 1}
REQUIRED = ("location_name", "location_address", "latitude", "longitude", "country_iso3", "postcode", "state", "street_or_city")
#: Levels from the score on, with their colours.
LEVELS = ((90, "Excellent", "#10b981"), (70, "Good", "#3b82f6"), (50, "Fair", "#f59e0b"), (None, "Poor", "#ef4444"))
BANDS = ((0.90, "HIGH"), (0.75, "MEDIUM-HIGH"), (0.70, "MEDIUM"))
METHODS = {"json-ld": "JSON-LD", "microdata": "Microdata", "dom-block": "DOM Block", "heuristic": "Heuristic", "map-iframe": "Map", "playwright-xhr": "XHR", "inline-script": "Script", "sequential-headers": "Headers", "data-attribute": "Data Attr", "location-list": "List"}
HEIGHTS = {"Headquarters": 45, "Office": 30, "Branch Office": 15, "Retail": 6, "Warehouse": 12, "Manufacturing": 15, "Data Center": 10, "Restaurant": 5}
OTHER_HEIGHT = 25
#: Words that give an activity, first match first.
ACTIVITIES = (
    ("Headquarters", ("headquarter", "hq")),
    ("Retail", ("retail", "store", "shop")),
    ("Warehouse", ("warehouse", "distribution", "fulfillment")),
    ("Manufacturing", ("manufacturing", "factory", "plant")),
    ("Data Center", ("data center", "datacenter")),
    ("Restaurant", ("restaurant", "cafe", "food")),
    ("Branch Office", ("branch", "regional")),
)
#: The shorter list, for rows found by page patterns.
PATTERN_ACTIVITIES = (("Retail", ("retail", "store")), ("Warehouse", ("warehouse", "distribution")), ("Manufacturing", ("manufacturing", "factory")), ("Office", ("office", "corporate")), ("Restaurant", ("restaurant", "food")))


def score(columns: dict[str, Column] | None = None) -> Column:
    """0 to 100; columns maps the fields' names to columns, by default those of these names."""
    col = lambda n: (columns or {}).get(n, F.col(n))
    given = reduce(add, (F.when(present(col(n)), w).otherwise(0) for n, w in WEIGHTS.items()))
    placed = F.when(coordinate(col("latitude")).isNotNull() & coordinate(col("longitude")).isNotNull(), 5).otherwise(0)
    address = F.lower(col("location_address").cast("string"))
    short = F.when(present(col("location_address")) & (F.length(address) < 10), 10).otherwise(0)
    unknown = F.when(F.coalesce(address.isin("unknown", "n/a"), F.lit(False)), 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), given + placed - short - unknown)).cast("int")


def level(s: Column) -> Column:
    return _by_step(s, 1)


def colour(s: Column) -> Column:
    return _by_step(s, 2)


def _by_step(s: Column, i: int) -> Column:
    out = F.when(s >= LEVELS[0][0], LEVELS[0][i])
    for step in LEVELS[1:-1]:
        out = out.when(s >= step[0], step[i])
    return out.otherwise(LEVELS[-1][i])


def missing_fields() -> Column:
    return F.array_compact(F.array(*(F.when(~present(F.col(n)), F.lit(n)) for n in REQUIRED)))


def completeness(s: Column) -> Column:
    return F.concat(F.round(s, 0).cast("int").cast("string"), F.lit("%"))


def band(c: Column) -> Column:
    """The band of a confidence; unknown where there is none."""
    out = F.when(c.isNull() | F.isnan(c), "unknown")
    for least, name in BANDS:
        out = out.when(c >= least, name)
    return out.otherwise("LOW")


def method_label(c: Column) -> Column:
    return F.coalesce(F.element_at(lookup(METHODS), c), c, F.lit("unknown"))


def height(activity: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in HEIGHTS.items() for x in kv))
    return F.coalesce(F.element_at(table, activity), F.lit(OTHER_HEIGHT)).cast("int")


def activity(text: Column, rules=ACTIVITIES) -> Column:
    """The first class whose words a text has, else Office."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in rules:
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Office")


def info_score(name: Column, address: Column, phone: Column, email: Column, activity_: Column) -> Column:
    """0 to 8: how much a row tells."""
    has = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0)
    return has(F.length(name) > 5, 2) + has(F.length(address) > 20, 3) + has(present(phone), 1) + has(present(email), 1) + has(activity_ != "Office", 1)


def shown_score() -> Column:
    """The score, or 20 for each of five essentials where there is none."""
    has = lambda c: F.when(c, 20).otherwise(0)
    parts = [present(F.col("location_name")), present(F.col("location_address")), present(F.col("latitude")) & present(F.col("longitude")), present(F.col("postcode")), present(F.col("country_iso3"))]
    return F.coalesce(F.col("quality_score"), reduce(add, map(has, parts)))
