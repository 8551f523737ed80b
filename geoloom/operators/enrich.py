"""Defaults, derived columns and quality columns of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo, quality
from geoloom.functions.text import first_filled

#: Confidence of rows by the way they were found, where they bring none.
CONFIDENCE = {"json-ld": 0.95, "microdata": 0.90, "dom-blocks": 0.80, "heuristics": 0.75, "maps": 0.90, "xhr": 0.85}


def default_confidence(way: str, column: str = "confidence") -> Column:
    return F.coalesce(F.col(column), F.lit(CONFIDENCE[way]))


def enrich(locations: DataFrame) -> DataFrame:
    """Names, activities and source types where they are missing; heights by activity; footprints by place. Other columns stay."""
    c = F.col
    out = locations.withColumns({
        "location_name": first_filled(c("location_name"), default="Unknown Location"),
        "activity": first_filled(c("activity"), default="Office"),
        "usage_share": first_filled(c("usage_share"), default="Exclusive"),
        "source_type": first_filled(c("source_type"), default="Company Website"),
    })
    return out.withColumns({"height": quality.height(c("activity")), "footprint": geo.footprint(c("latitude"), c("longitude"))})


def with_quality(locations: DataFrame) -> DataFrame:
    out = locations.withColumn("quality_score", quality.score())
    s = F.col("quality_score")
    return out.withColumns({"quality_level": quality.level(s), "quality_color": quality.colour(s), "missing_fields": quality.missing_fields(), "completeness": quality.completeness(s)})
