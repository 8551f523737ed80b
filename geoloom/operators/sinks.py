"""What leaves the engine: envelopes, report sheets, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import quality
from geoloom.functions.text import present

#: Rows that one response may hold; larger results are written as files.
MAX_ENVELOPE = 10_000


def envelope(rows: DataFrame, cached: bool = False, mode: str = "single-page", job_id: str | None = None, at: Column | None = None) -> DataFrame:
    """One row, body: a JSON answer with the rows, how they were got and when. For single responses; raises beyond MAX_ENVELOPE rows."""
    if rows.limit(MAX_ENVELOPE + 1).count() > MAX_ENVELOPE:
        raise ValueError(f"more than {MAX_ENVELOPE} rows: write them as JSON files")
    data = F.collect_list(F.struct(*rows.columns))
    return rows.agg(F.to_json(F.struct(F.lit(True).alias("success"), F.count(F.lit(1)).alias("totalRecords"), data.alias("data"), F.lit(cached).alias("cached"), F.lit(mode).alias("mode"), F.lit(job_id).alias("jobId"), (F.current_timestamp() if at is None else at).alias("crawledAt"))).alias("body"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def bulk_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("found").alias("locations"))


def report_summary(results: DataFrame) -> DataFrame:
    """The summary sheet: a row for each address asked for, with the fill of its status."""
    fill = F.when(F.col("status") == "success", "FF90EE90").otherwise("FFFFCCCB")
    return results.select("company", "url", "status", F.col("found").alias("locations"), F.coalesce("error", F.lit("")).alias("error"), fill.alias("fill"))


#: Headers of the sheet of locations, and fills of its quality column by least score.
SHEET = {"Company": "company", "Location Name": "location_name", "Address": "location_address", "City": "street_or_city", "State": "state", "Postcode": "postcode", "Country": "country_iso3", "Latitude": "latitude", "Longitude": "longitude", "Phone": "phone", "Email": "email", "Hours": "hours", "Quality Score": "quality_score", "Source URL": "source_url"}
FILLS = ((90, "FF90EE90"), (70, "FF87CEEB"), (50, "FFFFA500"))
#: Columns of the printed table.
PRINTED = ("location_name", "location_address", "activity", "latitude", "longitude", "country_iso3", "postcode", "state", "street_or_city", "footprint", "height", "usage_share", "source_url", "confidence")


def report_locations(scored: DataFrame) -> DataFrame:
    """The sheet of all locations: 14 columns as text, lists joined, the score as a percentage, and its fill; columns that scored lacks are empty."""
    types = dict(scored.dtypes)

    def shown(n: str) -> Column:
        if n not in types:
            return F.lit("")
        joined = F.array_join(n, "; " if n == "hours" else ", ") if types[n].startswith("array") else F.col(n).cast("string")
        return F.when(F.col(n) > 0, quality.completeness(F.round(n))).otherwise("") if n == "quality_score" else F.coalesce(joined, F.lit(""))

    fill = F.coalesce(*(F.when(F.col("quality_score") >= least, argb) for least, argb in FILLS), F.lit(""))
    kept = ["id"] if "id" in types else []
    return scored.select(*kept, *(shown(n).alias(header) for header, n in SHEET.items()), fill.alias("fill"))


def printed(rows: DataFrame) -> DataFrame:
    """The 14 columns of the printed table as text; what is missing or counts as nothing is empty."""
    kept = ["id"] if "id" in rows.columns else []
    return rows.select(*kept, *(F.when(present(F.col(n)), F.col(n).cast("string")).otherwise("").alias(n) if n in rows.columns else F.lit("").alias(n) for n in PRINTED))


def write_report(results: DataFrame, scored: DataFrame, path: str) -> None:
    """Both sheets as CSV folders."""
    report_summary(results).write.option("header", True).csv(f"{path}/summary")
    report_locations(scored).write.option("header", True).csv(f"{path}/locations")
