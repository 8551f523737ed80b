"""Duplicates, merging and geocoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import address, geo, text
from geoloom.operators import dedup, enrich, geocode
from geoloom.plans.catalog import Catalog
from geoloom.plans.columns import _A, _B, _PLACED, SCORED, _given
from geoloom.plans.fixtures import LOC, Rows, locations

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql

#: All rows and a copy of each with a short street word, moved by about 60 metres.
_COLUMNS = "location_name, location_address, latitude, longitude, country_iso3, postcode, state, street_or_city, activity, footprint, height, usage_share, source_url, phone, email"
_MOVED = "location_name, replace(location_address, ' Street', ' St') AS location_address, latitude + 0.0005 AS latitude, longitude, country_iso3, postcode, state, street_or_city, activity, footprint, height, usage_share, source_url, phone, email"
#: Rows of a state whose addresses begin with the same number are compared, and rows with equal postcodes or names.
_BLOCK = "state || '|' || nullif(regexp_extract(location_address, '^([0-9]+)', 1), '')"
DOUBLED = f"(SELECT *, {_BLOCK} AS block FROM (SELECT id, {_COLUMNS} FROM ({LOC}) l UNION ALL SELECT id + 100000000, {_MOVED} FROM ({LOC}) l) u)"


def doubled(spark, sf_dir):
    rows = locations(spark, sf_dir)
    both = rows.selectExpr("id", *_COLUMNS.split(", ")).unionByName(rows.selectExpr("id + 100000000 AS id", *_split(_MOVED)))
    return both.withColumn("block", F.expr(_BLOCK))


def _split(columns: str) -> list[str]:
    return [c.replace("|", ", ") for c in columns.replace("replace(location_address, ' Street', ' St')", "replace(location_address| ' Street'| ' St')").split(", ")]


_KM = "2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h}))".format(h="(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))")


@_C.add(f"SELECT a.id AS id, round({_KM}, 6) AS km FROM ({LOC}) a JOIN ({LOC}) b ON b.id = a.id + 1 WHERE a.latitude IS NOT NULL AND a.longitude IS NOT NULL AND b.latitude IS NOT NULL AND b.longitude IS NOT NULL")
def haversine_pairs(spark, sf_dir):
    rows = locations(spark, sf_dir).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    a, b = rows.select("id", "latitude", "longitude"), rows.select((F.col("id") - 1).alias("id"), F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    return a.join(b, "id").select("id", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("y"), F.col("x")), 6).alias("km"))


def _compared(t: str) -> str:
    return "trim(regexp_replace(" + _A.replace("location_address", f"{t}.location_address") + ", '\\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd)\\b', '', 'g'))"


def _both(n: str) -> str:
    return f"({_given('a.' + n)} AND {_given('b.' + n)})"


def _ratio(x: str, y: str) -> str:
    return f"CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y})) END"


_PARTS = (
    (0.4, _both("location_address"), _ratio(_compared("a"), _compared("b"))),
    (0.3, f"({_both('latitude')} AND {_both('longitude')})", f"CASE WHEN {_KM} < 0.1 THEN 1.0 ELSE greatest(0.0, 1 - {_KM} / 5) END"),
    (0.2, _both("location_name"), _ratio("lower(a.location_name)", "lower(b.location_name)")),
    (0.1, _both("postcode"), "CASE WHEN a.postcode = b.postcode THEN 1.0 ELSE 0.0 END"),
)
_WEIGHT = " + ".join(f"CASE WHEN {has} THEN {w} ELSE 0.0 END" for w, has, _ in _PARTS)
_TOTAL = " + ".join(f"CASE WHEN {has} THEN {w} * ({s}) ELSE 0.0 END" for w, has, s in _PARTS)
_PAIRS = f"SELECT a.id AS id_a, b.id AS id_b, round(CAST(({_TOTAL}) AS DOUBLE) / CAST(({_WEIGHT}) AS DOUBLE), 9) AS score FROM {DOUBLED} a JOIN {DOUBLED} b ON (a.block = b.block OR nullif(a.postcode, '') = nullif(b.postcode, '') OR lower(nullif(a.location_name, '')) = lower(nullif(b.location_name, ''))) AND a.id < b.id WHERE ({_WEIGHT}) > 0"


@_C.add(f"SELECT id_a, id_b, round(score, 6) AS score FROM ({_PAIRS}) p WHERE score >= 0.85")
def similarity_pairs(spark, sf_dir):
    return _similar(doubled(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _similar(rows):
    return dedup.blocked_pairs(rows, [F.col("block"), text.filled(F.col("postcode")), F.lower(text.filled(F.col("location_name")))])


#: The walk itself, a row a step.
_WALK = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM ({{pairs}}) p WHERE score >= 0.85),
    n AS MATERIALIZED (SELECT d.id, row_number() OVER (ORDER BY d.id) AS i, coalesce(list(p.id_a) FILTER (WHERE p.id_a IS NOT NULL), []) AS near FROM {DOUBLED} d LEFT JOIN p ON p.id_b = d.id GROUP BY d.id),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS l UNION ALL SELECT n.i, CASE WHEN list_has_any(n.near, w.l) THEN w.l ELSE list_append(w.l, n.id) END FROM w JOIN n ON n.i = w.i + 1),
    led AS (SELECT id, coalesce(list_min(list_intersect(near, l)), id) AS leader FROM n, (SELECT arg_max(l, i) AS l FROM w) x)"""
_LED = _WALK.format(pairs=_PAIRS)


@_C.add(f"{_LED} SELECT id, leader FROM led")
def fuzzy_leaders(spark, sf_dir):
    rows = doubled(spark, sf_dir)
    return dedup.leaders(_similar(rows), rows.select("id"))


#: Within a block only, as a page's or a site's rows are compared.
_OR = _PAIRS[_PAIRS.index("ON (") : _PAIRS.index(" AND a.id < b.id")]


@_C.add(f"{_WALK.format(pairs=_PAIRS.replace(_OR, 'ON a.block = b.block'))} SELECT id, leader FROM led")
def fuzzy_leaders_grouped(spark, sf_dir):
    return dedup.leaders_in_groups(doubled(spark, sf_dir), "block")


#: The same without a block: each row is compared with each.
_WHOLE = _PAIRS.replace(_OR + " AND a.id < b.id", "ON a.id < b.id")
_WALKED = _WALK.format(pairs=_WHOLE)


@_C.add(f"SELECT id_a, id_b, round(score, 6) AS score FROM ({_WHOLE}) p WHERE score >= 0.85")
def similarity_pairs_whole(spark, sf_dir):
    return dedup.whole_pairs(doubled(spark, sf_dir)).withColumn("score", F.round("score", 6))


@_C.add(f"{_WALKED} SELECT id, leader FROM led")
def fuzzy_leaders_whole(spark, sf_dir):
    return dedup.whole_leaders(doubled(spark, sf_dir))


_EDGES = Rows("id_a bigint, id_b bigint", (1, 2), (2, 3), (3, 4), (1, 5), (4, 6), (5, 6), (7, 8))
_NODES = Rows("id bigint", (1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,))


@_C.add("SELECT CAST(id AS BIGINT) AS id, CAST(leader AS BIGINT) AS leader FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 3), (5, 1), (6, 6), (7, 7), (8, 7), (9, 9)) v(id, leader)")
def leaders_chain(spark, sf_dir):
    return dedup.leaders(_EDGES.frame(spark), _NODES.frame(spark))


@_C.add(f"{_LED} SELECT leader, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM led GROUP BY leader HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return _groups(fuzzy_leaders(spark, sf_dir))


def _groups(led):
    groups = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return groups.where("n > 1")


@_C.add(f"{_WALKED} SELECT leader, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM led GROUP BY leader HAVING count(*) > 1")
def duplicate_groups_whole(spark, sf_dir):
    return _groups(fuzzy_leaders_whole(spark, sf_dir))


def _longest(n: str) -> str:
    return f"arg_max({n}, [length(CAST({n} AS VARCHAR)), -id]) FILTER (WHERE {n} IS NOT NULL) AS {n}"


_LISTED = "string_agg(DISTINCT {n}, ',' ORDER BY {n}) FILTER (WHERE {n} <> '') AS {n}"


@_C.add(f"""{_LED} SELECT leader, {', '.join(_longest(n) for n in ('location_name', 'location_address', 'postcode', 'latitude', 'activity'))}, {_LISTED.format(n='phone')}, {_LISTED.format(n='email')}, {_LISTED.format(n='source_url')}, count(*) AS merged_from
    FROM (SELECT l.leader, d.* FROM led l JOIN {DOUBLED} d ON d.id = l.id) m GROUP BY leader""")
def merge_duplicates(spark, sf_dir):
    """The locations themselves: similar rows made one, with the longest values and all contacts."""
    rows = doubled(spark, sf_dir)
    merged = dedup.merge_similar(rows, _similar(rows))
    listed = (F.nullif(F.array_join(n, ","), F.lit("")).alias(n) for n in ("phone", "email", "source_url"))
    return merged.select("leader", "location_name", "location_address", "postcode", "latitude", "activity", *listed, "merged_from")


@_C.add(f"SELECT state, {_longest('location_name')}, {_longest('location_address')}, {_longest('postcode')}, string_agg(DISTINCT phone, ',' ORDER BY phone) FILTER (WHERE phone <> '') AS phone, CAST(max(quality_score) AS INT) AS quality_score, count(*) AS merged_from FROM {SCORED} s GROUP BY state")
def merge_longest(spark, sf_dir):
    rows = enrich.with_quality(locations(spark, sf_dir)).drop("footprint")
    merged = dedup.merge(rows.withColumn("_state", F.col("state")), "_state", lists=("phone",))
    return merged.select(F.col("_state").alias("state"), "location_name", "location_address", "postcode", F.nullif(F.array_join("phone", ","), F.lit("")).alias("phone"), "quality_score", "merged_from")


_KEY = "trim(regexp_replace(regexp_replace(" + _B + ", '\\b(street|st|avenue|ave|road|rd|boulevard|blvd|suite|ste|unit|apt)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_INFO = f"(CASE WHEN length(location_name) > 5 THEN 2 ELSE 0 END) + (CASE WHEN length(location_address) > 20 THEN 3 ELSE 0 END) + (CASE WHEN {_given('phone')} THEN 1 ELSE 0 END) + (CASE WHEN {_given('email')} THEN 1 ELSE 0 END) + (CASE WHEN activity <> 'Office' THEN 1 ELSE 0 END)"


def _first(key: str, order: str, where: str = "true", table: str = "") -> str:
    return f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY {order}) AS r FROM (SELECT *, {key} AS k FROM {table or DOUBLED} d) d WHERE k IS NOT NULL AND {where}) WHERE r = 1"


@_C.add(_first(_KEY, f"{_INFO} DESC, id"))
def dedup_best_info(spark, sf_dir):
    from geoloom.functions import quality

    c = F.col
    info = quality.info_score(c("location_name"), c("location_address"), c("phone"), c("email"), c("activity"))
    return dedup.best_of(doubled(spark, sf_dir), address.key_address(c("location_address")), -info, c("id")).select("id")


_FILLED = " + ".join(f"(CASE WHEN {_given(n)} THEN 1 ELSE 0 END)" for n in dedup.FIELDS)


@_C.add(_first("regexp_replace(lower(location_address), '[\\s.,-]', '', 'g')", f"({_FILLED}) DESC, id", "length(k) >= 10"))
def dedup_most_fields(spark, sf_dir):
    fields = sum((F.when(text.present(F.col(n)), 1).otherwise(0) for n in dedup.FIELDS), F.lit(0))
    key = F.regexp_replace(F.lower("location_address"), r"[\s.,-]", "")
    return dedup.best_of(doubled(spark, sf_dir), key, -fields, F.col("id"), where=F.length("_key") >= 10).select("id")


@_C.add(_first("substr(regexp_replace(regexp_replace(lower(location_address), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g'), 1, 100)", "id", "length(k) > 10"))
def dedup_first_line(spark, sf_dir):
    key = F.substring(F.regexp_replace(F.regexp_replace(F.lower("location_address"), r"\s+", " "), r"[^\w\s]", ""), 1, 100)
    return dedup.best_of(doubled(spark, sf_dir), key, F.col("id"), where=F.length("_key") > 10).select("id")


@_C.add(_first("lower(coalesce(location_address, '') || '|' || coalesce(street_or_city, '') || '|' || coalesce(postcode, ''))", "id"))
def dedup_parts(spark, sf_dir):
    key = F.lower(F.concat_ws("|", *(F.coalesce(n, F.lit("")) for n in ("location_address", "street_or_city", "postcode"))))
    return dedup.best_of(doubled(spark, sf_dir), key, F.col("id")).select("id")


@_C.add(_first("regexp_replace(location_address, '\\s', '', 'g')", "id", "length(k) > 5"))
def dedup_unspaced(spark, sf_dir):
    return dedup.best_of(doubled(spark, sf_dir), F.regexp_replace("location_address", r"\s", ""), F.col("id"), where=F.length("_key") > 5).select("id")


@_C.add(_first("lower(trim(location_address))", "id"))
def dedup_trimmed(spark, sf_dir):
    return dedup.best_of(doubled(spark, sf_dir), F.lower(F.trim("location_address")), F.col("id")).select("id")


_CANON = f"CASE WHEN concat_ws('|', nullif(location_name, ''), nullif(street_or_city, ''), nullif(postcode, '')) <> '' THEN regexp_replace(lower(concat_ws('|', nullif(location_name, ''), nullif(street_or_city, ''), nullif(postcode, ''))), '[^a-z0-9|]', '', 'g') WHEN {_PLACED} THEN 'coord_' || CAST(latitude AS VARCHAR) || '_' || CAST(longitude AS VARCHAR) END"


@_C.add(f"SELECT key, arg_min(location_address, id) FILTER (WHERE location_address <> '') AS location_address, arg_min(activity, id) FILTER (WHERE activity <> '') AS activity, bool_or(id % 3 = 0) AS verified, max(id * 7 % 1000) AS last_seen, count(*) AS merged_from FROM (SELECT *, {_CANON} AS key FROM {DOUBLED} d) d WHERE key IS NOT NULL GROUP BY key")
def canonical_merge(spark, sf_dir):
    c = F.col
    key = address.canonical_key(c("location_name"), F.lit(None).cast("string"), c("street_or_city"), c("postcode"), c("latitude"), c("longitude"))
    rows = doubled(spark, sf_dir).withColumns({"verified": F.col("id") % 3 == 0, "last_seen": F.col("id") * 7 % 1000})
    return dedup.coalesce_merge(rows, key).select("key", "location_address", "activity", "verified", "last_seen", "merged_from")


_WORDS = Rows("id bigint, a string, b string", (1, "12 main st 90210", "12 other rd 90210"), (2, "alpha beta gamma delta", "alpha beta gamma epsilon"), (3, "alpha beta gamma delta", "alpha beta gamma delta"), (4, "1 x", "1 y"), (5, "north gate park lane one", "north gate park lane two"))


@_C.add(f"""SELECT id, coalesce(len(regexp_extract_all(a, '\\d+')) >= 2 AND len(regexp_extract_all(b, '\\d+')) >= 2 AND regexp_extract_all(a, '\\d+')[1] = regexp_extract_all(b, '\\d+')[1] AND regexp_extract_all(a, '\\d+')[-1] = regexp_extract_all(b, '\\d+')[-1], false)
    OR len(list_filter(string_split(a, ' '), lambda w: list_contains(string_split(b, ' '), w))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) > 0.7 AS similar FROM {_WORDS.sql} t""")
def word_overlap_pairs(spark, sf_dir):
    return _WORDS.frame(spark).select("id", dedup.similar_by_words(F.col("a"), F.col("b")).alias("similar"))


_PLACES = Rows("query string, lat double, lon double", ("1 Automobile Avenue", 10.0, 20.0), ("2 MACHINERY street", 11.0, 21.0), ("23 BUILDING Avenue", 12.5, 22.5))
_MORE = Rows("query string, lat double, lon double", ("23 building ave", 1.0, 1.0), ("46 HOUSEHOLD St", 2.0, 2.0), ("46 FURNITURE St", 3.0, 3.0), ("46 BUILDING St", 4.0, 4.0), ("46 MACHINERY St", 5.0, 5.0), ("46 AUTOMOBILE St", 6.0, 6.0))


def _known(rows: Rows) -> str:
    return f"(SELECT {_compared('q')} AS q, min([lat, lon]) AS p FROM (SELECT query AS location_address, lat, lon FROM {rows.sql} r) q GROUP BY 1)"


@_C.add(f"SELECT l.id, CASE WHEN {_PLACED} THEN latitude ELSE coalesce(x.p, y.p)[1] END AS latitude, CASE WHEN {_PLACED} THEN longitude ELSE coalesce(x.p, y.p)[2] END AS longitude, CAST(CASE WHEN {_PLACED} THEN 0 WHEN x.p IS NOT NULL THEN 1 WHEN y.p IS NOT NULL THEN 2 END AS INT) AS geocoded_by FROM ({LOC}) l LEFT JOIN {_known(_PLACES)} x ON x.q = {_compared('l')} LEFT JOIN {_known(_MORE)} y ON y.q = {_compared('l')}")
def geocode_fallback(spark, sf_dir):
    return geocode.geocode(locations(spark, sf_dir), _PLACES.frame(spark), _MORE.frame(spark)).select("id", "latitude", "longitude", "geocoded_by")


@_C.add(f"""SELECT id, arg_min(name, (km, name)) AS name, min(km) AS km FROM (
    SELECT a.id, 'place' || b.id AS name, round({_KM}, 6) AS km FROM ({LOC}) a JOIN (SELECT id, latitude + 0.01 AS latitude, longitude FROM ({LOC}) l WHERE latitude IS NOT NULL AND longitude IS NOT NULL) b ON abs(a.latitude - b.latitude) < 1) p
    WHERE km <= 25 GROUP BY id""")
def reverse_geocode(spark, sf_dir):
    rows = locations(spark, sf_dir)
    places = rows.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.concat(F.lit("place"), F.col("id").cast("string")).alias("name"), (F.col("latitude") + 0.01).alias("lat"), F.col("longitude").alias("lon"))
    return geocode.reverse(rows, places, 25.0)


_PARTS_ROWS = Rows("id bigint, kind string, long_name string, short_name string", (1, "locality", "Paris", "Paris"), (1, "country", "France", "FR"), (1, "postal_code", "75001", "75001"), (2, "postal_town", "Leeds", "Leeds"), (2, "administrative_area_level_1", "England", "ENG"), (2, "country", "United Kingdom", "GB"), (3, "route", "Main", "Main"))


@_C.add(f"SELECT id, coalesce(max(long_name) FILTER (WHERE kind = 'locality'), max(long_name) FILTER (WHERE kind = 'postal_town'), max(long_name) FILTER (WHERE kind = 'administrative_area_level_2')) AS city, max(long_name) FILTER (WHERE kind = 'administrative_area_level_1') AS state, max(long_name) FILTER (WHERE kind = 'postal_code') AS postcode, max(short_name) FILTER (WHERE kind = 'country') AS country FROM {_PARTS_ROWS.sql} t GROUP BY id")
def geocode_components(spark, sf_dir):
    part = F.struct(F.array("kind").alias("types"), "long_name", "short_name")
    return geocode.components(_PARTS_ROWS.frame(spark).groupBy("id").agg(F.collect_list(part).alias("components")))
