"""Row-wise operators: normal forms, enrichment, scores and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import address, geo, quality, text
from geoloom.operators import enrich, reports
from geoloom.plans.catalog import Catalog
from geoloom.plans.fixtures import LOC, Rows, locations

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql

_GIVEN = "coalesce(CAST({0} AS VARCHAR) NOT IN ('', '0', '0.0', 'NaN', 'nan', 'false'), false)"


def _given(c: str) -> str:
    return _GIVEN.format(c)


_PLACED = "(coalesce(latitude, 0) <> 0 AND coalesce(longitude, 0) <> 0)"
_SCORE = (
    "greatest(0, least(100, "
    + " + ".join(f"CASE WHEN {_given(n)} THEN {w} ELSE 0 END" for n, w in quality.WEIGHTS.items())
    + f" + CASE WHEN {_PLACED} THEN 5 ELSE 0 END - CASE WHEN {_given('location_address')} AND length(location_address) < 10 THEN 10 ELSE 0 END"
    + " - CASE WHEN lower(coalesce(location_address, '')) IN ('unknown', 'n/a') THEN 20 ELSE 0 END))"
)
SCORED = f"(SELECT *, {_SCORE} AS quality_score FROM ({LOC}) l)"
_LEVEL = "CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Good' WHEN quality_score >= 50 THEN 'Fair' ELSE 'Poor' END"


@_C.add(
    f"""SELECT id, CAST(quality_score AS INT) AS quality_score, {_LEVEL} AS quality_level,
    CASE WHEN quality_score >= 90 THEN '#10b981' WHEN quality_score >= 70 THEN '#3b82f6' WHEN quality_score >= 50 THEN '#f59e0b' ELSE '#ef4444' END AS quality_color,
    concat_ws(',', {", ".join(f"CASE WHEN NOT {_given(n)} THEN '{n}' END" for n in quality.REQUIRED)}) AS missing_fields,
    CAST(quality_score AS VARCHAR) || '%' AS completeness FROM {SCORED} s"""
)
def quality_score(spark, sf_dir):
    return enrich.with_quality(locations(spark, sf_dir)).select("id", "quality_score", "quality_level", "quality_color", F.array_join("missing_fields", ",").alias("missing_fields"), "completeness")


_REPORT = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {_LEVEL} = '{n}') AS {n.lower()}" for _, n, _ in quality.LEVELS) + ", round(avg(quality_score), 6) AS average_score"


@_C.add(f"SELECT region, {_REPORT} FROM {SCORED} s GROUP BY region")
def quality_report(spark, sf_dir):
    return flagship(spark, sf_dir)


@_C.add(f"SELECT {_REPORT} FROM {SCORED} s")
def quality_report_all(spark, sf_dir):
    return reports.quality_report(enrich.with_quality(locations(spark, sf_dir)))


def flagship(spark, sf_dir) -> DataFrame:
    return reports.quality_report(enrich.with_quality(locations(spark, sf_dir)), "region")


_TEXT = Rows("id bigint, x string", (1, "  a   b \t c "), (2, None), (3, ""), (4, "12  Main Street, "), (5, "9 St. James Road;"), (6, "Suite 101 - 102, 5 Park Avenue"), (7, "1 Elm Boulevard Floor 3"), (8, "7 Building Lane Apartment 2"), (9, "Plain"))


@_C.add(f"SELECT id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS norm FROM {_TEXT.sql} t")
def norm_text(spark, sf_dir):
    return _TEXT.frame(spark).select("id", text.squeezed(F.col("x")).alias("norm"))


def _street_sql(c: str) -> str:
    out = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    for word, short in address.STREET_WORDS.items():
        # RE2 has no look-ahead: what follows is taken and put back
        pattern = f"(?i)\\b{word.rstrip('.')}\\.(\\W|$)" if word.endswith(".") else f"(?i)\\b{word}\\b([^.]|$)"
        out = f"regexp_replace({out}, '{pattern}', '{short}\\1', 'g')"
    return f"regexp_replace(regexp_replace({out}, '[,;]+$', ''), '(\\d)\\s*-\\s*(\\d)', '\\1-\\2')"


@_C.add(f"SELECT id, {_street_sql('x')} AS norm FROM {_TEXT.sql} t UNION ALL SELECT id, {_street_sql('location_address')} FROM ({LOC}) l")
def norm_address(spark, sf_dir):
    rows = _TEXT.frame(spark).unionByName(locations(spark, sf_dir).select("id", F.col("location_address").alias("x")))
    return rows.select("id", address.street(F.col("x")).alias("norm"))


_CODES = Rows("id bigint, st string, zip string, country string", (1, "california", "123456789", "usa"), (2, " New York ", "12345-6789", "uk"), (3, "TX", "k1a 0b1", "Deutschland"), (4, None, None, None), (5, "Bavaria", "sw1a 1aa", "DE"), (6, "", "", ""), (7, "ohio", "1234 ab", "FRA"), (8, "utah", "02139", "Holland"), (9, "guam", "123", "XX"))


def _cases(c: str, table: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_ZIP = "regexp_replace(upper(coalesce(zip, '')), '[\\s-]', '', 'g')"


@_C.add(
    f"""SELECT id, coalesce({_cases("upper(trim(coalesce(st, '')))", address.STATES)}, upper(trim(coalesce(st, '')))) AS st,
    CASE WHEN regexp_full_match({_ZIP}, '\\d{{9}}') THEN substr({_ZIP}, 1, 5) || '-' || substr({_ZIP}, 6) WHEN regexp_full_match({_ZIP}, '[A-Z]\\d[A-Z]\\d[A-Z]\\d') THEN substr({_ZIP}, 1, 3) || ' ' || substr({_ZIP}, 4) ELSE {_ZIP} END AS zip,
    coalesce({_cases("lower(trim(coalesce(country, '')))", address.COUNTRIES)}, upper(trim(coalesce(country, '')))) AS country,
    CASE length(trim(coalesce(country, ''))) WHEN 3 THEN upper(trim(country)) WHEN 2 THEN coalesce({_cases("upper(trim(country))", address.ISO3)}, upper(trim(country))) ELSE '' END AS iso3 FROM {_CODES.sql} t"""
)
def norm_codes(spark, sf_dir):
    return _CODES.frame(spark).select("id", address.state(F.col("st")).alias("st"), address.postal_code(F.col("zip")).alias("zip"), address.country_alpha2(F.col("country")).alias("country"), address.country_alpha3(F.col("country")).alias("iso3"))


_PHONES = Rows("id bigint, x string", (1, "555 123-4567"), (2, "1 (555) 123 4567"), (3, "+44 20 7946 0958"), (4, "123"), (5, None), (6, ""), (7, "+1 555 123 4567"), (8, "(030) 123456"), (9, "5551234567"))
_DIGITS = "regexp_replace(coalesce(x, ''), '[^0-9]', '', 'g')"
_BARE = "regexp_replace(regexp_replace(x, '[-.\\s()]', '', 'g'), '^\\+', '')"


@_C.add(
    f"""SELECT id, CASE WHEN trim(coalesce(x, '')) LIKE '+%' THEN '+' || {_DIGITS} WHEN length({_DIGITS}) = 10 THEN '(' || substr({_DIGITS}, 1, 3) || ') ' || substr({_DIGITS}, 4, 3) || '-' || substr({_DIGITS}, 7)
    WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN '+1-' || substr({_DIGITS}, 2, 3) || '-' || substr({_DIGITS}, 5, 3) || '-' || substr({_DIGITS}, 8) ELSE {_DIGITS} END AS display,
    CASE WHEN length({_BARE}) >= 10 THEN '+' || {_BARE} END AS plain, length({_DIGITS}) BETWEEN 7 AND 15 AS plausible FROM {_PHONES.sql} t"""
)
def norm_phone(spark, sf_dir):
    x = F.col("x")
    return _PHONES.frame(spark).select("id", address.phone_display(x).alias("display"), address.phone_plain(x).alias("plain"), F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")).between(7, 15).alias("plausible"))


_NUMBERS = Rows("id bigint, x string", (1, "12.5"), (2, "0"), (3, "abc"), (4, None), (5, "-0.0001"), (6, "NaN"), (7, ""))


@_C.add(f"SELECT id, CASE WHEN isnan(TRY_CAST(x AS DOUBLE)) THEN NULL ELSE nullif(TRY_CAST(x AS DOUBLE), 0) END AS value, CASE WHEN coalesce(TRY_CAST(x AS DOUBLE), 0) = 0 OR isnan(TRY_CAST(x AS DOUBLE)) THEN '-' ELSE printf('%.6f', TRY_CAST(x AS DOUBLE)) END AS shown FROM {_NUMBERS.sql} t")
def norm_coordinate(spark, sf_dir):
    return _NUMBERS.frame(spark).select("id", address.coordinate(F.col("x")).alias("value"), geo.shown_coordinate(F.col("x")).alias("shown"))


_A = "regexp_replace(regexp_replace(lower(location_address), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')"
_B = "regexp_replace(regexp_replace(lower(location_address), '[.,\\-#]', ' ', 'g'), '\\s+', ' ', 'g')"


@_C.add(
    f"""SELECT id, trim(regexp_replace({_A}, '\\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd)\\b', '', 'g')) AS compared,
    trim(regexp_replace(regexp_replace({_B}, '\\b(street|st|avenue|ave|road|rd|boulevard|blvd|suite|ste|unit|apt)\\b', '', 'g'), '\\s+', ' ', 'g')) AS keyed,
    regexp_replace(upper(postcode), '\\W', '', 'g') AS postcode,
    CASE WHEN concat_ws('|', nullif(location_name, ''), nullif(location_address, ''), nullif(street_or_city, ''), nullif(postcode, '')) <> ''
      THEN regexp_replace(lower(concat_ws('|', nullif(location_name, ''), nullif(location_address, ''), nullif(street_or_city, ''), nullif(postcode, ''))), '[^a-z0-9|]', '', 'g')
      WHEN {_PLACED} THEN 'coord_' || CAST(latitude AS VARCHAR) || '_' || CAST(longitude AS VARCHAR) END AS canonical FROM ({LOC}) l"""
)
def comparison_keys(spark, sf_dir):
    c = F.col
    return locations(spark, sf_dir).select("id", address.comparison_address(c("location_address")).alias("compared"), address.key_address(c("location_address")).alias("keyed"), address.comparison_postcode(c("postcode")).alias("postcode"), address.canonical_key(c("location_name"), c("location_address"), c("street_or_city"), c("postcode"), c("latitude"), c("longitude")).alias("canonical"))


@_C.add(f"SELECT id, concat_ws(', ', nullif(location_address, ''), nullif(street_or_city, ''), nullif(state, ''), nullif(postcode, ''), nullif(country_iso3, '')) AS formatted, coalesce(nullif(location_address, ''), nullif(street_or_city, ''), '') AS first_given FROM ({LOC}) l")
def format_address(spark, sf_dir):
    parts = [F.col(n) for n in ("location_address", "street_or_city", "state", "postcode", "country_iso3")]
    return locations(spark, sf_dir).select("id", address.joined_address(*parts).alias("formatted"), text.first_filled(parts[0], parts[1]).alias("first_given"))


def _activity_sql(c: str, rules) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules) + " ELSE 'Office' END"


@_C.add(f"SELECT id, {_activity_sql('location_name', quality.ACTIVITIES)} AS activity, {_activity_sql('location_name', quality.PATTERN_ACTIVITIES)} AS pattern_activity FROM ({LOC}) l")
def activity_guess(spark, sf_dir):
    n = F.col("location_name")
    return locations(spark, sf_dir).select("id", quality.activity(n).alias("activity"), quality.activity(n, quality.PATTERN_ACTIVITIES).alias("pattern_activity"))


_HEIGHT = "CASE coalesce(activity, 'Office') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.HEIGHTS.items()) + " ELSE 25 END"
_CORNER = "printf('%.6f %.6f', longitude + {0}, latitude + {1})"
_RING = " || ', ' || ".join(_CORNER.format(x, y) for x, y in (("-0.0001", "-0.0001"), ("0.0001", "-0.0001"), ("0.0001", "0.0001"), ("-0.0001", "0.0001"), ("-0.0001", "-0.0001")))


@_C.add(
    f"""SELECT id, coalesce(nullif(location_name, ''), 'Unknown Location') AS location_name, coalesce(activity, 'Office') AS activity, usage_share, source_type,
    CAST({_HEIGHT} AS INT) AS height, CASE WHEN {_PLACED} THEN 'MULTIPOLYGON(((' || {_RING} || ')))' END AS footprint FROM ({LOC}) l"""
)
def enrich_locations(spark, sf_dir):
    return enrich.enrich(locations(spark, sf_dir)).select("id", "location_name", "activity", "usage_share", "source_type", "height", "footprint")


@_C.add(
    f"""SELECT id, CAST((CASE WHEN length(location_name) > 5 THEN 2 ELSE 0 END) + (CASE WHEN length(location_address) > 20 THEN 3 ELSE 0 END) + (CASE WHEN {_given("phone")} THEN 1 ELSE 0 END) + (CASE WHEN {_given("email")} THEN 1 ELSE 0 END) + (CASE WHEN activity <> 'Office' THEN 1 ELSE 0 END) AS INT) AS info,
    CAST(20 * (CAST({_given("location_name")} AS INT) + CAST({_given("location_address")} AS INT) + CAST({_given("latitude")} AND {_given("longitude")} AS INT) + CAST({_given("postcode")} AS INT) + CAST({_given("country_iso3")} AS INT)) AS INT) AS shown FROM ({LOC}) l"""
)
def info_scores(spark, sf_dir):
    c = F.col
    rows = locations(spark, sf_dir).withColumn("quality_score", F.lit(None).cast("int"))
    return rows.select("id", quality.info_score(c("location_name"), c("location_address"), c("phone"), c("email"), c("activity")).cast("int").alias("info"), quality.shown_score().cast("int").alias("shown"))


_BAND = "CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.75 THEN 'MEDIUM-HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END"


@_C.add(f"SELECT id, {_BAND} AS band, coalesce({_cases('method', quality.METHODS)}, method, 'unknown') AS label, CAST(coalesce(confidence, 0.8) AS DOUBLE) AS defaulted FROM ({LOC}) l")
def confidence_labels(spark, sf_dir):
    return locations(spark, sf_dir).select("id", quality.band(F.col("confidence")).alias("band"), quality.method_label(F.col("method")).alias("label"), enrich.default_confidence("dom-blocks").alias("defaulted"))


@_C.add(f"SELECT {_BAND} AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 0) AS percent FROM ({LOC}) l GROUP BY 1")
def confidence_hist(spark, sf_dir):
    return reports.histogram(locations(spark, sf_dir).select(quality.band(F.col("confidence")).alias("band")), "band")


@_C.add(f"SELECT coalesce(method, 'unknown') AS method, count(*) AS n FROM ({LOC}) l GROUP BY 1")
def method_counts(spark, sf_dir):
    return reports.counts(locations(spark, sf_dir), "method")


@_C.add(f"SELECT id, {_LEVEL} AS level, CASE WHEN quality_score >= 90 THEN '#10b981' WHEN quality_score >= 70 THEN '#3b82f6' WHEN quality_score >= 50 THEN '#f59e0b' ELSE '#ef4444' END AS color, concat_ws(' | ', nullif(location_name, ''), nullif(location_address, ''), nullif(activity, '')) AS card FROM {SCORED} s WHERE {_PLACED}")
def map_markers(spark, sf_dir):
    return reports.markers(enrich.with_quality(locations(spark, sf_dir))).select("id", F.col("quality_level").alias("level"), "color", "card")


@_C.add(f"SELECT count(*) AS markers, round(min(latitude), 6) AS south, round(max(latitude), 6) AS north, round(min(longitude), 6) AS west, round(max(longitude), 6) AS east FROM ({LOC}) l WHERE {_PLACED}")
def bbox(spark, sf_dir):
    return reports.bounds(locations(spark, sf_dir))
