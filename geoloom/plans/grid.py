"""Filters, sorts, pages, facets and exports of the location table."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import enrich, grid, sinks
from geoloom.plans.catalog import Catalog
from geoloom.plans.columns import _PLACED, SCORED, _given
from geoloom.plans.fixtures import LOC, Rows, locations

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql


@_C.add(f"SELECT id, location_name, state FROM ({LOC}) l WHERE contains(lower(coalesce(location_name, '')), 'store') AND contains(lower(coalesce(state, '')), 'an')")
def grid_filter(spark, sf_dir):
    return locations(spark, sf_dir).where(grid.contains({"location_name": "Store", "state": "AN", "postcode": ""})).select("id", "location_name", "state")


@_C.add(f"SELECT id FROM ({LOC}) l WHERE contains(lower(postcode), '10') AND contains(lower(source_url), 'asia')")
def grid_filter_strict(spark, sf_dir):
    return locations(spark, sf_dir).where(grid.contains({"postcode": "10", "source_url": "asia"}, missing_as_empty=False)).select("id")


@_C.add(f"SELECT id, quality_score BETWEEN 70 AND 89 AS good, quality_score >= 90 AS excellent FROM {SCORED} s")
def grid_quality_ranges(spark, sf_dir):
    return enrich.with_quality(locations(spark, sf_dir)).select("id", grid.in_range("quality_score", "70-89").alias("good"), grid.in_range("quality_score", "90").alias("excellent"))


@_C.add(f"SELECT id FROM ({LOC}) l WHERE coalesce(confidence, 0) >= 0.7 AND NOT (coalesce(method, '') = 'heuristic' AND coalesce(confidence, 0) < 0.75)")
def confidence_filter(spark, sf_dir):
    rows = locations(spark, sf_dir)
    return rows.where(grid.confident(0.70) & ((F.coalesce("method", F.lit("")) != "heuristic") | grid.confident(0.75))).select("id")


@_C.add(f"SELECT id, ({_PLACED}) OR ({_given('location_name')} AND ({_given('location_address')} OR {_given('street_or_city')})) OR ({_given('location_address')} AND {_given('street_or_city')}) AS valid FROM ({LOC}) l")
def location_valid(spark, sf_dir):
    return locations(spark, sf_dir).select("id", grid.valid().alias("valid"))


@_C.add(f"SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY postcode DESC NULLS LAST, id) AS rank FROM ({LOC}) l) WHERE rank <= 100")
def grid_sort_nulls_last(spark, sf_dir):
    return _ranked(grid.ordered(locations(spark, sf_dir), "postcode", descending=True).limit(100))


@_C.add(f"SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY postcode DESC NULLS FIRST, id) AS rank FROM ({LOC}) l) WHERE rank <= 100")
def grid_sort_reversed(spark, sf_dir):
    return _ranked(grid.ordered(locations(spark, sf_dir), "postcode", descending=True, nulls_last=False).limit(100))


def _ranked(top):
    """Ranks of a hundred rows that a sort with a limit has left."""
    rows = top.agg(F.collect_list("id").alias("ids"))
    return rows.select(F.posexplode("ids").alias("rank", "id")).select("id", (F.col("rank") + 1).cast("bigint").alias("rank"))


@_C.add(f"SELECT id, location_name, state FROM ({LOC}) l ORDER BY location_name NULLS LAST, id LIMIT 20 OFFSET 40")
def grid_page(spark, sf_dir):
    return grid.page(grid.ordered(locations(spark, sf_dir), "location_name"), 3, 20).select("id", "location_name", "state")


@_C.add(f"SELECT count(*) AS rows, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM ({LOC}) l")
def grid_pages(spark, sf_dir):
    return grid.pages(locations(spark, sf_dir), 20)


@_C.add(f"SELECT DISTINCT source_type AS value FROM ({LOC}) l WHERE source_type <> '' UNION ALL SELECT DISTINCT street_or_city FROM ({LOC}) l WHERE street_or_city <> '' UNION ALL SELECT DISTINCT usage_share FROM ({LOC}) l WHERE usage_share NOT IN ('', 'Exclusive', 'Shared')")
def grid_facets(spark, sf_dir):
    rows = locations(spark, sf_dir)
    return grid.facet(rows, "source_type").unionByName(grid.facet(rows, "street_or_city")).unionByName(grid.facet(rows, "usage_share", ("Exclusive", "Shared")))


@_C.add(f"SELECT DISTINCT source_url AS value FROM ({LOC}) l WHERE contains(source_url, 'europe')")
def url_autocomplete(spark, sf_dir):
    rows = locations(spark, sf_dir)
    return grid.facet(rows.where(F.col("source_url").contains("europe")), "source_url")


@_C.add(f"SELECT {', '.join(c for c in grid.COLUMNS if c not in grid.HIDDEN)} FROM ({LOC}) l")
def grid_columns(spark, sf_dir):
    return grid.visible(locations(spark, sf_dir))


_CSV = ("location_name", "location_address", "postcode", "height")


def _line(strict: bool) -> str:
    value = (lambda n: f"coalesce(CAST({n} AS VARCHAR), '')") if strict else (lambda n: f"CASE WHEN {_given(n)} THEN CAST({n} AS VARCHAR) ELSE '' END")
    return " || ',' || ".join(f"'\"' || replace({value(n)}, '\"', '\"\"') || '\"'" for n in _CSV)


@_C.add(f"SELECT id, {_line(False)} AS line FROM ({LOC}) l")
def grid_csv_rows(spark, sf_dir):
    return grid.csv_rows(locations(spark, sf_dir), _CSV)


@_C.add(f"SELECT id, {_line(True)} AS line FROM ({LOC}) l")
def grid_csv_rows_strict(spark, sf_dir):
    return grid.csv_rows(locations(spark, sf_dir), _CSV, "strict")


@_C.add(f"SELECT id, quality_score FROM {SCORED} s ORDER BY quality_score DESC, id LIMIT 50")
def top_quality(spark, sf_dir):
    return enrich.with_quality(locations(spark, sf_dir)).orderBy(F.col("quality_score").desc(), "id").limit(50).select("id", "quality_score")


@_C.add(f"SELECT id FROM ({LOC}) l WHERE id IN (3, 5, 8, 13, 21)")
def grid_selection(spark, sf_dir):
    return locations(spark, sf_dir).where(F.col("id").isin(3, 5, 8, 13, 21)).select("id")


_BULK = Rows("company string, url string, status string, error string, found bigint", ("A", "https://a.test", "success", None, 3), ("B", "https://b.test", "failed", "timeout", 0), ("C", "https://c.test", "success", None, 0))


@_C.add(f"SELECT count(*) AS urls, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(found) AS BIGINT) AS locations FROM {_BULK.sql} t")
def bulk_summary(spark, sf_dir):
    return sinks.bulk_totals(_BULK.frame(spark))


@_C.add(f"SELECT company, url, status, found AS locations, coalesce(error, '') AS error, CASE status WHEN 'success' THEN 'FF90EE90' ELSE 'FFFFCCCB' END AS fill FROM {_BULK.sql} t")
def bulk_report_summary(spark, sf_dir):
    return sinks.report_summary(_BULK.frame(spark))


def _shown(header: str, n: str) -> str:
    if n in ("company", "hours"):
        return f"'' AS \"{header}\""
    if n == "quality_score":
        return f"CASE WHEN quality_score > 0 THEN CAST(quality_score AS VARCHAR) || '%' ELSE '' END AS \"{header}\""
    return f"coalesce(CAST({n} AS VARCHAR), '') AS \"{header}\""


@_C.add(f"SELECT id, {', '.join(_shown(h, n) for h, n in sinks.SHEET.items())}, CASE {' '.join(f'WHEN quality_score >= {a} THEN {chr(39)}{c}{chr(39)}' for a, c in sinks.FILLS)} ELSE '' END AS fill FROM {SCORED} s")
def bulk_report_locations(spark, sf_dir):
    return sinks.report_locations(enrich.with_quality(locations(spark, sf_dir)))


_EMPTY = "CASE WHEN {0} IS NULL OR CAST({0} AS VARCHAR) IN ('', '0', '0.0', 'NaN', 'false') THEN '' ELSE CAST({0} AS VARCHAR) END AS {0}"


@_C.add(f"SELECT id, {', '.join(_EMPTY.format(n) for n in sinks.PRINTED)} FROM (SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({LOC}) l) l")
def printed_table(spark, sf_dir):
    return sinks.printed(locations(spark, sf_dir))


@_C.add(f"SELECT true AS success, count(*) AS total_records, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, false AS cached, 'site-wide' AS mode, 'job-7' AS job_id, '2024-01-29T00:00:00.000Z' AS at FROM (SELECT id FROM ({LOC}) l ORDER BY id LIMIT 25) p")
def json_envelope(spark, sf_dir):
    at = F.lit("2024-01-29T00:00:00.000Z")
    one = sinks.envelope(grid.page(grid.ordered(locations(spark, sf_dir), "id"), 1, 25).select("id", "location_name"), mode="site-wide", job_id="job-7", at=at)
    parsed = F.from_json("body", "success boolean, totalRecords bigint, data array<struct<id:bigint,location_name:string>>, cached boolean, mode string, jobId string, crawledAt string")
    ids = F.array_join(F.array_sort(F.col("b.data.id")).cast("array<string>"), ",")
    return one.select(parsed.alias("b")).select(F.col("b.success").alias("success"), F.col("b.totalRecords").alias("total_records"), ids.alias("ids"), F.col("b.cached").alias("cached"), F.col("b.mode").alias("mode"), F.col("b.jobId").alias("job_id"), F.col("b.crawledAt").alias("at"))
