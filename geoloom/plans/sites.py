"""Extraction from pages that are derived from the tables, so that SQL can work out what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import sql, urls
from geoloom.operators import dedup, html, site_extract
from geoloom.operators import text_extract as x
from geoloom.plans.catalog import Catalog
from geoloom.plans.extraction import PARSED
from geoloom.plans.fixtures import LOC, Rows, locations, read
from geoloom.sources import readers

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql

#: A site for each customer; valid in Spark and in DuckDB.
_SITE = """SELECT CAST(c_custkey AS BIGINT) AS page_id, 'Site ' || CAST(c_custkey AS STRING) AS name,
  CAST(c_custkey % 900 + 1 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ' Oak Street' ELSE ' Elm Avenue' END AS street,
  CASE c_custkey % 4 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Denver' WHEN 2 THEN 'Boston' ELSE 'Seattle' END AS city,
  CASE c_custkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'CO' WHEN 2 THEN 'MA' ELSE 'WA' END AS st,
  CAST(10000 + c_custkey % 90000 AS STRING) AS zip,
  CASE c_custkey % 5 WHEN 0 THEN 'Organization' WHEN 1 THEN 'LocalBusiness' WHEN 2 THEN 'Place' WHEN 3 THEN 'PostalAddress' ELSE 'Person' END AS kind,
  CASE c_custkey % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'Germany' ELSE '' END AS country,
  CASE c_custkey % 4 WHEN 0 THEN '+1 555-123-' WHEN 1 THEN '(555) 987-' WHEN 2 THEN '+44 1632 96' ELSE '+91 98765 4' END || CAST(1000 + c_custkey % 9000 AS STRING) AS phone FROM {customer}"""
_SITES = f"({_SITE.format(customer='customer')})"
_LINKED = """'{"@type": "' || kind || '", "name": "' || CASE WHEN page_id % 6 = 0 THEN '' ELSE name END || '", "telephone": "' || phone || '"' || CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN ', "address": "' || street || ' ' || city || '"' ELSE ', "address": {"streetAddress": "' || street || '", "addressLocality": "' || city || '", "addressRegion": "' || st || '", "postalCode": "' || zip || '", "addressCountry": "US"}' END || '}'"""
_MICRO = """'<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">Org ' || CAST(page_id AS STRING) || '</span><div itemscope itemtype="https://schema.org/PostalAddress">' || CASE WHEN page_id % 2 = 0 THEN '<b itemprop="name">Own ' || CAST(page_id AS STRING) || '</b>' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '' ELSE '<span itemprop="streetAddress">' || street || '</span><span itemprop="addressLocality">' || city || '</span>' END || '<span itemprop="addressRegion">' || st || '</span><span itemprop="postalCode">' || zip || '</span></div></div>'"""
_LIST = """'<div class="location-list"><div class="location-item"><h4>' || name || '</h4><p>' || street || ', ' || city || ', ' || st || ' ' || zip || '</p></div><div class="office-item"><p>Near the old mill gate ' || zip || '</p></div><div class="location-item">tiny</div></div>'"""
_CARD = """'<h2>' || CASE WHEN country = '' THEN 'Our places' ELSE country END || '</h2><div class="office-card"><h3>' || city || '</h3> <span>' || street || '</span> <span>' || st || ' ' || zip || '</span> <i>by the reception</i></div>'"""
_ONE = """'<div class="headquarters"><strong>' || name || '</strong> ' || street || ', ' || city || ', ' || st || ' ' || zip || '</div><div class="branch">nothing to see in this one</div>'"""
_DATA = """'<div data-slug="new-' || lower(city) || '"></div><div data-city="' || city || '"></div><div data-office="x"></div><script>var office = [["' || city || ' (' || st || ')", "slug-' || zip || '", [1, 2]]]; var none = [["lower", "slug"]];</script>'"""
_TEXT = "'Visit ' || street || ', ' || city || ', ' || st || ' ' || zip || ' or 1 High Street London SW1A 1AA. Contact: Jane Miller Manager: Tom Baker. Open Monday-Friday Hours: 9am - 5pm. Tel ' || phone || CASE WHEN country = '' THEN '' ELSE ' in ' || country END || ' mail Site' || zip || '@corp.test'"


def _sites(spark, sf_dir):
    return spark.sql(_SITE, customer=read(spark, sf_dir, "customer"))


def _pages(spark, sf_dir, body: str):
    return html.nodes(_sites(spark, sf_dir).select("page_id", F.concat(F.lit("<html><body>"), F.expr(body), F.lit("</body></html>")).alias("html")))


def _linked(spark, sf_dir):
    return _pages(spark, sf_dir, f"""'<script type="application/ld+json">' || {_LINKED} || '</script>'""")


_NAMED = "CASE WHEN page_id % 6 = 0 THEN {0} ELSE name END"
_TEMPLATE = "CASE WHEN page_id % 7 = 1 THEN street || ' ' || city ELSE street || ', ' || city || ', ' || st || ' ' || zip END"


def _types(names) -> str:
    return "kind IN (" + ", ".join(f"'{n}'" for n in names) + ")"


@_C.add(f"SELECT page_id, {_NAMED.format(repr('Office'))} AS name, {_TEMPLATE} AS address, phone FROM {_SITES} s WHERE {_types(site_extract.LISTED_TYPES)} AND page_id % 7 <> 0")
def jsonld_listed(spark, sf_dir):
    return site_extract.linked_listed(_linked(spark, sf_dir)).select("page_id", "name", "address", "phone")


@_C.add(f"SELECT page_id, {_NAMED.format(repr('a.test'))} AS name, {_TEMPLATE} AS address, kind AS activity FROM {_SITES} s WHERE {_types(site_extract.OWNER_TYPES)} AND page_id % 7 <> 0")
def jsonld_owned(spark, sf_dir):
    return site_extract.linked_owned(_linked(spark, sf_dir), F.lit("a.test")).select("page_id", "name", "address", "activity")


@_C.add(f"SELECT page_id, {_NAMED.format(chr(39) * 2)} AS name, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN street || ' ' || city ELSE street || ', ' || city || ', ' || st || ', ' || zip || ', US' END AS address, phone, kind AS type FROM {_SITES} s WHERE {_types(site_extract.STRUCTURED_TYPES)} AND NOT (page_id % 6 = 0 AND page_id % 7 = 0)")
def jsonld_structured(spark, sf_dir):
    return site_extract.linked_structured(_linked(spark, sf_dir)).select("page_id", "name", "address", "phone", "type")


@_C.add(f"SELECT page_id, n AS name, street || ', ' || city || ', ' || st || ' ' || zip AS address FROM (SELECT *, unnest(['Org ' || page_id, CASE WHEN page_id % 2 = 0 THEN 'Own ' ELSE 'Org ' END || page_id]) AS n FROM {_SITES} s WHERE page_id % 3 <> 0) q")
def microdata_named(spark, sf_dir):
    return site_extract.microdata_named(_pages(spark, sf_dir, _MICRO)).select("page_id", "name", "address")


#: An item's text begins with its name, whose number a US address takes in.
_FIRST = f"regexp_extract(name || street || ', ' || city || ', ' || st || ' ' || zip, '{x.FULL_US}', 0)"


@_C.add(f"SELECT page_id, unnest([name, 'Near the old mill gate ' || zip]) AS name, unnest([{_FIRST}, 'Near the old mill gate ' || zip]) AS address FROM {_SITES} s")
def list_locations(spark, sf_dir):
    return site_extract.listed(_pages(spark, sf_dir, _LIST)).select("page_id", "name", "address")


@_C.add(f"SELECT page_id, city AS name, street AS address, st AS state, zip AS postcode, nullif(country, '') AS country FROM {_SITES} s")
def carried_cards(spark, sf_dir):
    return site_extract.carried_cards(_pages(spark, sf_dir, _CARD)).select("page_id", "name", "address", "state", "postcode", "country")


_TEXTS = f"(SELECT page_id, {_TEXT} AS text FROM {_SITES} s)"


def _texts(spark, sf_dir):
    return _sites(spark, sf_dir).select("page_id", F.expr(_TEXT).alias("text"))


@_C.add(f"SELECT page_id, name, nullif(regexp_extract(name || ' ' || street || ', ' || city || ', ' || st || ' ' || zip, '{x.FULL_US}', 0), '') AS address FROM {_SITES} s")
def section_places(spark, sf_dir):
    return site_extract.section_places(_pages(spark, sf_dir, _ONE), F.lit("a.test")).select("page_id", "name", "address")


@_C.add(f"SELECT page_id, unnest(['New ' || city, city]) AS name FROM {_SITES} s")
def named_attributes(spark, sf_dir):
    return site_extract.named_attributes(_pages(spark, sf_dir, _DATA)).select("page_id", "name")


@_C.add(f"SELECT page_id, city || ' (' || st || ')' AS name FROM {_SITES} s")
def slug_arrays(spark, sf_dir):
    return site_extract.slug_arrays(_pages(spark, sf_dir, _DATA)).select("page_id", "name")


@_C.add(" UNION ALL ".join(f"SELECT page_id, CAST({i} AS INT) AS pattern, trim(unnest(regexp_extract_all(text, '{p}'))) AS address FROM {_TEXTS} t" for i, p in enumerate(x.BODY)))
def body_addresses(spark, sf_dir):
    return x.body_addresses(_texts(spark, sf_dir)).select("page_id", "pattern", "address")


@_C.add(f"SELECT page_id, unnest(list_distinct(regexp_extract_all(text, '{x.FULL_US}'))) AS address FROM {_TEXTS} t")
def full_addresses(spark, sf_dir):
    return x.full_addresses(_texts(spark, sf_dir)).select("page_id", "address")


_FIND = f"coalesce(nullif(trim(regexp_extract(text, '{x.FULL_US}', 0)), ''), nullif(trim(regexp_extract(text, '{x.INTERNATIONAL}', 0)), ''), CASE WHEN contains(text, ',') AND length(text) BETWEEN 21 AND 299 THEN trim(text) END)"


@_C.add(f"SELECT page_id, {_FIND} AS address FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Gate two, ' || city || ' Centre, Bayern ' || zip WHEN 2 THEN 'near the ' || city || ' mill, behind the pond' ELSE 'no place' END AS text FROM (SELECT t.*, city, zip FROM {_TEXTS} t JOIN {_SITES} s USING (page_id)) q) r")
def find_address(spark, sf_dir):
    rows = _sites(spark, sf_dir).withColumn("text", F.expr(f"CASE page_id % 4 WHEN 0 THEN {_TEXT} WHEN 1 THEN 'Gate two, ' || city || ' Centre, Bayern ' || zip WHEN 2 THEN 'near the ' || city || ' mill, behind the pond' ELSE 'no place' END"))
    return rows.select("page_id", x.find_address(F.col("text")).alias("address"))


@_C.add(f"SELECT page_id, {PARSED} FROM {_TEXTS} t")
def site_parse_address(spark, sf_dir):
    p = x.parse_address(F.col("text"))
    return _texts(spark, sf_dir).select("page_id", *(p[n].alias(n) for n in ("street", "city", "state", "postal", "country", "email")))


@_C.add(f"SELECT page_id, array_to_string(regexp_extract_all(text, '{x.PERSON}', 1), ',') AS people, array_to_string(list_sort(list_distinct(list_concat({', '.join(f'list_transform(regexp_extract_all(text, {chr(39)}{p}{chr(39)}), lambda h: trim(h))' for p in x.HOURS)}))), ',') AS hours FROM {_TEXTS} t")
def people_and_hours(spark, sf_dir):
    c = F.col("text")
    return _texts(spark, sf_dir).select("page_id", F.array_join(x.people(c), ",").alias("people"), F.array_join(F.array_sort(x.hours(c)), ",").alias("hours"))


def _plain(k: str, p: str) -> str:
    bare = "regexp_replace(regexp_replace(h, '[-.\\s()]', '', 'g'), '^\\+', '')"
    return f"SELECT page_id, '{k}' AS locale, '+' || {bare} AS phone FROM (SELECT page_id, unnest(regexp_extract_all(phone, '{p}')) AS h FROM {_SITES} s) q WHERE length({bare}) >= 10"


@_C.add("SELECT DISTINCT * FROM (" + " UNION ALL ".join(_plain(k, p) for k, p in x.LOCALE_PHONES.items()) + ") u")
def locale_phones(spark, sf_dir):
    return _sites(spark, sf_dir).select("page_id", F.explode(x.locale_phones(F.col("phone"))).alias("p")).select("page_id", "p.locale", "p.phone")


_LINE = "CASE page_id % 6 WHEN 0 THEN 'Learn more' WHEN 1 THEN 'ok' WHEN 2 THEN street WHEN 3 THEN 'More offices' WHEN 4 THEN 'zip ' || zip ELSE 'plain words' END"
_PARTED = " OR ".join(f"regexp_matches(line, '{p.split('(?!')[0]}')" for p in (*x.STREETS, *x.POSTAL, r"\d+\s+[A-Z]"))


@_C.add(f"SELECT page_id, length(line) < 3 OR {' OR '.join(f'contains(lower(line), {chr(39)}{w}{chr(39)})' for w in x.HEADER_WORDS)} OR starts_with(lower(line), 'more') AS header, {_PARTED} AS parts FROM (SELECT page_id, {_LINE} AS line FROM {_SITES} s) q")
def line_kinds(spark, sf_dir):
    c = F.expr(_LINE)
    return _sites(spark, sf_dir).select("page_id", x.is_header_text(c).alias("header"), x.has_address_parts(c).alias("parts"))


_FILES = "'https://a.test/' || CASE page_id % 6 WHEN 0 THEN 'x.DOCX' WHEN 1 THEN 'y.txt' WHEN 2 THEN 'doc_financials/9' WHEN 3 THEN 'z.pdf?a=1' WHEN 4 THEN 'q.rtf' ELSE 'page' END"


@_C.add(f"SELECT page_id, regexp_matches(lower(u), '\\.pdf$|\\.pdf\\?|/pdf/|doc_financials') AS pdf, regexp_matches(lower(u), '\\.(doc|docx|txt|rtf)$') AS document FROM (SELECT page_id, {_FILES} AS u FROM {_SITES} s) q")
def document_urls(spark, sf_dir):
    return _sites(spark, sf_dir).select("page_id", urls.is_pdf(F.expr(_FILES)).alias("pdf"), urls.is_document(F.expr(_FILES)).alias("document"))


@_C.add("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'locations' WHEN 1 THEN 'contact' WHEN 2 THEN 'about' ELSE 'general' END AS type, CAST(CASE page_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.7 WHEN 2 THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence, CAST(CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS INT) AS priority FROM " + _SITES + " s")
def combined_class(spark, sf_dir):
    """By address, by headings, by both (the address's class, the headings' greater confidence), by neither."""
    url = F.expr("'https://a.test/' || CASE page_id % 4 WHEN 0 THEN 'offices/x' WHEN 2 THEN 'about/' ELSE 'x' END")
    heads = F.expr("CASE page_id % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Get in touch' WHEN 2 THEN 'Contact us to reach us' ELSE 'News' END")
    c = urls.combined_class(url, heads)
    return _sites(spark, sf_dir).select("page_id", c["type"].alias("type"), F.round(c["confidence"], 6).alias("confidence"), c["priority"].alias("priority"))


@_C.add(f"SELECT id, round(CASE WHEN latitude IS NULL OR longitude IS NULL THEN NULL ELSE 2 * 6371.0 * asin(sqrt(pow(sin(radians(10 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(10)) * pow(sin(radians(20 - longitude) / 2), 2))) END, 6) AS km, upper(replace(coalesce(postcode, ''), '-', '')) AS postal, regexp_extract(source_url, '^(https?://[^/?#]+)', 1) AS origin FROM ({LOC}) l")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT id, round(geo_km(latitude, longitude, 10, 20), 6) AS km, postal_plain(postcode) AS postal, url_origin(source_url) AS origin FROM {rows}", rows=locations(spark, sf_dir))


@_C.add("SELECT CAST(c_custkey AS BIGINT) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'kept ' WHEN c_custkey % 3 = 1 THEN 'new ' ELSE 'new ' END || c_custkey AS value FROM customer")
def memoised(spark, sf_dir):
    """Every third key has a valid entry and every third one that is too old."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    cache = keys.where("key % 3 < 2").select("key", F.concat(F.lit("kept "), F.col("key").cast("string")).alias("value"), F.when(F.col("key") % 3 == 0, 9_000.0).otherwise(100.0).alias("stored_at"))
    answers, _ = readers.memoised(keys, cache, lambda d: d.withColumn("value", F.concat(F.lit("new "), F.col("key").cast("string"))), F.lit(10_000.0))
    return answers


_SAMPLE = "SELECT CAST(i AS BIGINT) AS id, (100 + i * 7) || ' ' || ['Mill', 'Canal', 'Orchard'][CAST(i % 3 + 1 AS INT)] || ' Road' AS location_address, round(-60 + i * 4.75::DOUBLE, 4) AS latitude, CAST(10000 + i * 37 AS VARCHAR) AS postcode FROM (SELECT unnest(range(1, 26)) AS i) r"


@_C.add(_SAMPLE)
def sample_table(spark, sf_dir):
    return readers.sample(spark).select("id", "location_address", "latitude", "postcode")


_UPLOADS = Rows("id bigint, name string, mime string, bytes bigint", (1, "a.csv", "text/csv", 10), (2, "b.CSV", None, 10), (3, "c.xlsx", "application/x", 10), (4, "d.csv", "text/csv", 20_000_000), (5, None, None, None))


@_C.add(f"SELECT id, CASE WHEN NOT (coalesce(mime IN ('text/csv', 'application/vnd.ms-excel'), false) OR coalesce(lower(name) LIKE '%.csv', false)) THEN 'not a CSV file' WHEN bytes > 10485760 THEN 'too large' END AS reason FROM {_UPLOADS.sql} t")
def upload_validation(spark, sf_dir):
    return readers.rejected_uploads(_UPLOADS.frame(spark))


@_C.add(f"SELECT page_id, street || ', ' || city || ', ' || st || ' ' || zip AS b, street || ', ' || city || ', ' || st || ' ' || zip || CASE WHEN country = '' THEN '' ELSE ', ' || country END AS c FROM {_SITES} s")
def templated_address(spark, sf_dir):
    from geoloom.functions.address import templated_address

    parts = [F.col(n) for n in ("street", "city", "st", "zip")]
    return _sites(spark, sf_dir).select("page_id", templated_address(*parts).alias("b"), templated_address(*parts, F.col("country")).alias("c"))


@_C.add(f"SELECT page_id AS id, page_id // 4 * 4 AS kept FROM {_SITES} s WHERE page_id < 400 AND page_id % 4 < 2")
def word_leaders(spark, sf_dir):
    """Two rows of four share all words but one, and of each two the longer one is kept."""
    rows = _sites(spark, sf_dir).where("page_id < 400 AND page_id % 4 < 2").selectExpr("page_id AS id", "page_id DIV 4 AS g", "'suite ' || CAST(page_id DIV 4 AS STRING) || ' north gate park lane end block' || CASE WHEN page_id % 4 = 0 THEN ' annexe' ELSE '' END AS location_address")
    a, b = rows.select("g", F.col("id").alias("id_a"), F.col("location_address").alias("x")), rows.select("g", F.col("id").alias("id_b"), F.col("location_address").alias("y"))
    pairs = a.join(b, "g").where("id_a < id_b").where(dedup.similar_by_words(F.col("x"), F.col("y"))).select("id_a", "id_b")
    return dedup.word_leaders(pairs, rows)
