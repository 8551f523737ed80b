"""Functions of the engine by name in SQL: expressions that the optimizer sees through, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(arguments) -> type: expression.
FUNCTIONS = {
    "geo_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": "CASE WHEN lat1 + lon1 + lat2 + lon2 IS NOT NULL THEN 2 * 6371.0D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) END",
    "text_similarity(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END",
    "text_squeezed(x STRING) RETURNS STRING": "trim(regexp_replace(x, '(?U)\\\\s+', ' '))",
    "postal_plain(x STRING) RETURNS STRING": "regexp_replace(upper(coalesce(x, '')), '[\\\\s-]', '')",
    "phone_plain(x STRING) RETURNS STRING": "CASE WHEN length(regexp_replace(regexp_replace(x, '[-.\\\\s()]', ''), '^\\\\+', '')) >= 10 THEN '+' || regexp_replace(regexp_replace(x, '[-.\\\\s()]', ''), '^\\\\+', '') END",
    "address_compared(x STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[^\\\\w\\\\s]', ''), '\\\\s+', ' '), '\\\\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd)\\\\b', ''))",
    "url_origin(x STRING) RETURNS STRING": "regexp_extract(x, '^(https?://[^/?#]+)', 1)",
    "coordinate(x STRING) RETURNS DOUBLE": "CASE WHEN NOT isnan(try_cast(x AS DOUBLE)) AND try_cast(x AS DOUBLE) <> 0 THEN try_cast(x AS DOUBLE) END",
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions for a session; returns their names. Null arguments give null, but for postal_plain ('')."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
