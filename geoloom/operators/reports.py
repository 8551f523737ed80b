"""Counts and shares of locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import quality
from geoloom.functions.address import coordinate
from geoloom.functions.text import filled


def quality_report(scored: DataFrame, *by: str) -> DataFrame:
    """Rows, rows of each level, mean score; null mean without rows."""
    levels = [F.count_if(F.col("quality_level") == name).alias(name.lower()) for _, name, _ in quality.LEVELS]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *levels, F.round(F.avg("quality_score"), 6).alias("average_score"))


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value with their share in whole percents; the window is over the few groups."""
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 0))


def placed(rows: DataFrame) -> DataFrame:
    return rows.where(coordinate(F.col("latitude")).isNotNull() & coordinate(F.col("longitude")).isNotNull())


def bounds(rows: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return placed(rows).agg(F.count(F.lit(1)).alias("markers"), r(F.min("latitude")).alias("south"), r(F.max("latitude")).alias("north"), r(F.min("longitude")).alias("west"), r(F.max("longitude")).alias("east"))


def markers(scored: DataFrame) -> DataFrame:
    """Rows with a place, with the colour and the text of their marker."""
    card = F.concat_ws(" | ", filled(F.col("location_name")), filled(F.col("location_address")), filled(F.col("activity")))
    return placed(scored).withColumns({"color": F.col("quality_color"), "card": card})


def crawl_stats(results: DataFrame) -> DataFrame:
    """Requests, those answered by structured data (and their share), by text, and failures; results has kind and found."""
    n = F.count(F.lit(1))
    structured = F.count_if((F.col("kind") == "structured") & (F.col("found") > 0))
    share = F.when(n > 0, F.round(100.0 * structured / n, 1))
    return results.agg(n.alias("requests"), structured.alias("structured"), share.alias("structured_percent"), F.count_if((F.col("kind") == "html") & (F.col("found") > 0)).alias("html"), F.count_if(F.col("kind") == "error").alias("errors"))


def recall(rows: DataFrame, wanted: int) -> DataFrame:
    """Rows found and their share of what is wanted, in percent."""
    return rows.agg(F.count(F.lit(1)).alias("found"), F.round(100.0 * F.count(F.lit(1)) / wanted, 1).alias("percent"))


def one_table(*strategies: DataFrame) -> DataFrame:
    """The rows of all strategies, columns that one lacks as null."""
    out = strategies[0]
    for s in strategies[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def with_details(rows: DataFrame, details: DataFrame, key: str = "place_id") -> DataFrame:
    """rows with what is known of their place; their own values first."""
    own = [c for c in details.columns if c != key]
    known = details.select(key, *(F.col(c).alias(f"_{c}") for c in own))
    out = rows.join(known, key, "left")
    return out.select(*(c for c in rows.columns if c not in own), *(F.coalesce(*([F.col(c)] if c in rows.columns else []), F.col(f"_{c}")).alias(c) for c in own))
