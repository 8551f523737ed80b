"""Links, schemas, ids, statistics, unions and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import text, urls
from geoloom.operators import dom_extract, enrich, grid, html, json_extract, reports
from geoloom.plans.catalog import Catalog
from geoloom.plans.columns import _PLACED, SCORED
from geoloom.plans.fixtures import LOC, Rows, locations, read
from geoloom.streaming import jobs

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql

_LINKS = Rows("id bigint, href string, text string", (1, "/contact", "x"), (2, "/a", "Our Offices"), (3, "/a", "b"), (4, "/World/Region", ""), (5, "/shop", "Find us here"))
_HIT = " OR ".join(f"contains(lower(href), '{w}') OR contains(lower(text), '{w}')" for w in urls.LINK_WORDS)


@_C.add(f"SELECT id, {_HIT} AS hit FROM {_LINKS.sql} t")
def location_links(spark, sf_dir):
    return _LINKS.frame(spark).select("id", urls.is_location_link(F.col("href"), F.col("text")).alias("hit"))


_IDS = Rows("id bigint, x string", (1, "abc"), (2, ""), (3, "a longer address, 12 Main Street"), (4, "zzzzzzzzzzzz"))


@_C.add("SELECT CAST(id AS BIGINT) AS id, h FROM (VALUES (1, '22ci'), (2, '0'), (3, 'frtsd7'), (4, 'i5eqo0')) v(id, h)")
def string_hash(spark, sf_dir):
    return _IDS.frame(spark).select("id", text.hash31(F.col("x")).alias("h"))


@_C.add(f"SELECT 'loc_' || substr(sha256(concat_ws('|', location_name, location_address)), 1, 16) AS key, count(*) AS n FROM ({LOC}) l GROUP BY 1")
def stable_ids(spark, sf_dir):
    return locations(spark, sf_dir).groupBy(text.stable_id(F.col("location_name"), F.col("location_address")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


_XHR = Rows(
    "page_id bigint, body string",
    (1, '{"a": {"b": [{"name": "Deep", "address": "1 Deep St", "c": {"title": "Pin", "lat": 1.5, "lon": 2.5}}]}}'),
    (2, '{"name": "no address"}'),
    (3, "[" * 16 + '{"name": "Too deep", "address": "9 St"}' + "]" * 16),
    (4, "oops"),
)


@_C.add("SELECT CAST(page_id AS BIGINT) AS page_id, name, address, latitude, longitude, CAST(0.85 AS DOUBLE) AS confidence FROM (VALUES (1, 'Deep', '1 Deep St', NULL, NULL), (1, 'Pin', '', 1.5::DOUBLE, 2.5::DOUBLE)) v(page_id, name, address, latitude, longitude)")
def xhr_locations(spark, sf_dir):
    return json_extract.captured(_XHR.frame(spark), "page_id", "body").select("page_id", "name", "address", "latitude", "longitude", "confidence")


_PAGE = """<meta name="description" content="d"><meta property="og:title" content="t"><meta charset="x"><div class="wrap office"><div class="office-card">HQ building, 12 Long Main Street, Springfield IL 62704 USA</div></div>
<div id="contact-block">Call us at our office: 5 Short Road, Dover, phone: 555 0100, weekdays</div><section class="office">short 1 St</section>"""
_PAGES = Rows("page_id bigint, html string", (1, _PAGE))


@_C.add("SELECT CAST(page_id AS BIGINT) AS page_id, address FROM (VALUES (1, 'HQ building, 12 Long Main Street, Springfield IL 62704 USA'), (1, 'Call us at our office: 5 Short Road, Dover, phone: 555 0100, weekdays')) v(page_id, address)")
def section_blocks(spark, sf_dir):
    return dom_extract.sections(html.nodes(_PAGES.frame(spark))).select("page_id", "address")


@_C.add("SELECT CAST(page_id AS BIGINT) AS page_id, name, content FROM (VALUES (1, 'description', 'd'), (1, 'og:title', 't')) v(page_id, name, content)")
def page_metadata(spark, sf_dir):
    return dom_extract.metadata(html.nodes(_PAGES.frame(spark)))


_KIND = "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'structured' ELSE 'html' END"


@_C.add(f"SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'click' AND value > 0) AS structured, round(100.0 * count(*) FILTER (WHERE event_type = 'click' AND value > 0) / count(*), 1) AS structured_percent, count(*) FILTER (WHERE {_KIND} = 'html' AND value > 0) AS html, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def crawl_stats(spark, sf_dir):
    return reports.crawl_stats(read(spark, sf_dir, "events").selectExpr(f"{_KIND} AS kind", "value AS found"))


@_C.add(f"SELECT count(*) AS found, round(100.0 * count(*) / 2000, 1) AS percent FROM ({LOC}) l WHERE {_PLACED}")
def extraction_recall(spark, sf_dir):
    return reports.recall(reports.placed(locations(spark, sf_dir)), 2000)


@_C.add(f"SELECT count(*) AS shown, (SELECT count(*) FROM ({LOC}) l) AS total, CAST(2 AS BIGINT) AS filters FROM ({LOC}) l WHERE contains(lower(coalesce(location_name, '')), 'store') AND contains(lower(coalesce(state, '')), 'a')")
def filter_summary(spark, sf_dir):
    filters = {"location_name": "store", "state": "a", "postcode": ""}
    rows = locations(spark, sf_dir)
    hit = grid.contains(filters)
    return rows.agg(F.count_if(hit).alias("shown"), F.count(F.lit(1)).alias("total")).withColumn("filters", F.lit(sum(map(bool, filters.values()))).cast("bigint"))


@_C.add(f"SELECT method, count(*) AS n, count(confidence) AS confident FROM (SELECT 'placed' AS method, confidence FROM ({LOC}) l WHERE {_PLACED} UNION ALL SELECT 'named', NULL FROM ({LOC}) l WHERE location_name <> '') u GROUP BY method")
def union_strategies(spark, sf_dir):
    rows = locations(spark, sf_dir)
    one = reports.one_table(reports.placed(rows).select(F.lit("placed").alias("method"), "confidence"), rows.where("location_name <> ''").select(F.lit("named").alias("method")))
    return one.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("confident"))


@_C.add(f"SELECT id, CASE WHEN {_PLACED} THEN 'kept' ELSE 'geocoded' END AS way FROM ({LOC}) l")
def split_and_merge(spark, sf_dir):
    rows = locations(spark, sf_dir)
    have = reports.placed(rows)
    rest = rows.join(have.select("id"), "id", "left_anti")
    return have.select("id", F.lit("kept").alias("way")).unionByName(rest.select("id", F.lit("geocoded").alias("way")))


_DETAILS = Rows("place_id string, phone string, rating double", ("p1", "111", 4.5), ("p2", "222", 3.0))
_OWN = Rows("id bigint, place_id string, phone string", (1, "p1", None), (2, "p2", "999"), (3, "p3", None))


@_C.add(f"SELECT o.id, o.place_id, coalesce(o.phone, d.phone) AS phone, d.rating FROM {_OWN.sql} o LEFT JOIN {_DETAILS.sql} d USING (place_id)")
def place_details(spark, sf_dir):
    return reports.with_details(_OWN.frame(spark), _DETAILS.frame(spark))


@_C.add("SELECT DISTINCT user_id AS job_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def unvisited(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id")).distinct().join(e.where("event_type = 'error'").select(F.col("user_id").alias("job_id")), "job_id", "left_anti")


@_C.add("SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY user_id")
def job_latest(spark, sf_dir):
    r = jobs.job_events(read(spark, sf_dir, "events"))
    return r.groupBy("job_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@_C.add("SELECT user_id AS job_id, CAST(CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE event_type IN ('view', 'click')) / count(*)) ELSE 0 END AS INT) AS percent FROM events GROUP BY user_id")
def job_percent(spark, sf_dir):
    s = jobs.progress(jobs.job_events(read(spark, sf_dir, "events")))
    return s.select("job_id", jobs.percent(F.col("pages"), F.col("reports")).alias("percent"))


@_C.add(f"SELECT id, CAST(quality_score AS INT) AS quality_score FROM {SCORED} s WHERE quality_score >= 70 ORDER BY id LIMIT 50")
def early_stop(spark, sf_dir):
    return enrich.with_quality(locations(spark, sf_dir)).where("quality_score >= 70").orderBy("id").limit(50).select("id", "quality_score")


@_C.add(f"SELECT id, coalesce(nullif(location_address, ''), nullif(street_or_city, ''), 'Not available') AS address, coalesce(nullif(phone, ''), '-') AS phone FROM ({LOC}) l")
def detail_view(spark, sf_dir):
    c = F.col
    return locations(spark, sf_dir).select("id", text.first_filled(c("location_address"), c("street_or_city"), default="Not available").alias("address"), text.first_filled(c("phone"), default="-").alias("phone"))


_SCHEMAS = Rows("id bigint, x string", (1, '{"@type": "LocalBusiness", "name": "A", "address": "1 A St"}'), (2, '{"@type": ["Thing", "BranchOffice"], "name": "B", "geo": {"latitude": 3, "longitude": 4}}'), (3, '{"@type": "Article", "name": "C", "address": "x"}'), (4, '[{"@type": "Store", "legalName": "D", "address": {"streetAddress": "4 D St", "addressCountry": "FR"}, "telephone": "77"}]'))


@_C.add("SELECT CAST(id AS BIGINT) AS id, name, address, phone FROM (VALUES (1, 'A', '1 A St', NULL), (2, 'B', '', NULL), (4, 'D', '4 D St, FR', '77')) v(id, name, address, phone)")
def jsonld_types(spark, sf_dir):
    return json_extract.linked(json_extract.objects(_SCHEMAS.frame(spark), "id", "x"), "id").select("id", "name", "address", "phone")
