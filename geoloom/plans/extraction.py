"""Extraction from document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import address
from geoloom.operators import text_extract as x
from geoloom.plans.catalog import Catalog
from geoloom.plans.fixtures import Rows, read

_C = Catalog()
QUERIES, SQL = _C.queries, _C.sql

_TEXTS = Rows(
    "doc_id bigint, text string",
    (1, "Acme GmbH\nHead Office\n12 Main Street\nSpringfield, IL 62704\nTel: 555-123-4567\nFax: +1 555 987 6543\nsales@acme.test\nEnd"),
    (2, "Our Offices\nLondon\n1 High Street\nLondon SW1A 1AA\nParis\nno address\nnowhere\nUtrecht\nDam 3\nUtrecht 3511 AB\nlast"),
    (3, "nothing here"),
    (4, ""),
    (5, "Contact Information\nBerlin office\n5 Unter den Linden\n10117 Berlin\nHours: 9am - 5pm\nMon-Fri 9am-5pm\nlogo@x.png a@b.co A@B.co"),
    (6, "Branch\nonly two"),
    (7, "Address\nSuite 5, 77 Oak Avenue\nAustin, TX 78701-1234\nUSA\n9:00 AM - 5:00 PM\nfoo@example.com"),
)


def _sorted(a: str) -> str:
    return f"array_to_string(list_sort({a}), ',')"


_EMAILS = f"list_distinct(list_transform(regexp_extract_all(text, '{x.EMAIL}'), lambda e: lower(e)))"
_NOT_ASSET = "list_filter({0}, lambda e: NOT regexp_matches(e, '(\\.png|\\.jpg|\\.gif|\\.css|\\.js|\\.woff)$'))".format(_EMAILS)


@_C.add(f"SELECT doc_id, {_sorted(_NOT_ASSET)} AS emails FROM documents WHERE contains(text, '@') AND len({_NOT_ASSET}) > 0")
def doc_emails(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    found = docs.select("doc_id", x.emails(F.col("text")).alias("e"))
    return found.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


@_C.add(f"SELECT doc_id, {_sorted(_NOT_ASSET)} AS emails, array_to_string(list_sort(list_filter({_NOT_ASSET}, lambda e: NOT contains(e, 'example.com') AND NOT contains(e, 'domain.com') AND NOT contains(e, '.png') AND NOT contains(e, '.jpg'))), ',') AS contacts FROM {_TEXTS.sql} t")
def text_emails(spark, sf_dir):
    c = F.col("text")
    return _TEXTS.frame(spark).select("doc_id", F.array_join(x.emails(c), ",").alias("emails"), F.array_join(x.contact_emails(c), ",").alias("contacts"))


def _phones_sql() -> str:
    us = x.US_PHONE
    both = f"list_distinct(list_concat(list_transform(regexp_extract_all(text, '{us}'), lambda p: trim(p)), list_transform(regexp_extract_all(text, '{x.WORLD_PHONE}'), lambda p: trim(p))))"
    return f"list_filter({both}, lambda p: length(regexp_replace(p, '\\D', '', 'g')) BETWEEN 7 AND 15)"


@_C.add(f"SELECT doc_id, {_sorted(_phones_sql())} AS phones FROM documents WHERE len({_phones_sql()}) > 0")
def doc_phones(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d"))
    found = docs.select("doc_id", x.phones(F.col("text")).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("phones"))


_PINS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS country, unnest(regexp_extract_all(text, '{p}')) AS code FROM @t@" for k, p in address.PIN_PATTERNS.items())


@_C.add(f"SELECT country, code, count(*) AS n FROM ({_PINS.replace('@t@', 'documents')}) p GROUP BY country, code")
def doc_pins(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d"))
    rows = docs.select(F.inline(address.pins(F.col("text"))))
    return rows.groupBy("country", "code").agg(F.count(F.lit(1)).alias("n"))


@_C.add(f"SELECT doc_id, country, code FROM ({_PINS.replace('@t@', _TEXTS.sql + ' t')}) p")
def text_pins(spark, sf_dir):
    return _TEXTS.frame(spark).select("doc_id", F.inline(address.pins(F.col("text")))).select("doc_id", "country", "code")


_LINES = "(SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, l[i] AS line, len(l) AS n, l FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '') AS l FROM @t@) a) b)"
_LOOKS = "(" + " OR ".join(f"regexp_matches(line, '{p}')" for p in address.INDICATORS) + ") AND regexp_matches(line, '\\d') AND length(line) BETWEEN 20 AND 400"
_ADDRESS_LINES = f"SELECT doc_id, CAST(pos AS INT) AS pos, regexp_replace(line, '\\s+', ' ', 'g') AS street FROM {_LINES} s WHERE pos < 1000 AND length(line) BETWEEN 20 AND 300 AND ({' OR '.join(f'regexp_matches(line, {chr(39)}{p}{chr(39)})' for p in address.LINE_PATTERNS)}) AND {_LOOKS}"


@_C.add(_ADDRESS_LINES.replace("@t@", "documents"))
def doc_address_lines(spark, sf_dir):
    return x.pattern_lines(read(spark, sf_dir, "documents"))


@_C.add(_ADDRESS_LINES.replace("@t@", _TEXTS.sql + " t"))
def text_address_lines(spark, sf_dir):
    return x.pattern_lines(_TEXTS.frame(spark))


@_C.add(f"SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM {_LINES.replace('@t@', 'documents')} s GROUP BY doc_id")
def doc_lines(spark, sf_dir):
    return x.lines(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_BLOCK = "array_to_string(l[pos + 2 : pos + 5], ', ')"
_LIKE_BLOCK = f"(regexp_matches({_BLOCK}, '{address.STREET_LINE}') OR " + " OR ".join(f"regexp_matches({_BLOCK}, '{p}')" for p in address.PIN_PATTERNS.values()) + f") AND len(string_split({_BLOCK}, ',')) >= 2 AND length({_BLOCK}) >= 20"


@_C.add(f"SELECT doc_id, CAST(pos AS INT) AS pos, line AS label, {_BLOCK} AS text FROM {_LINES.replace('@t@', _TEXTS.sql + ' t')} s WHERE pos < n - 1 AND {_any('line', x.LABELS)} AND {_LIKE_BLOCK}")
def text_label_blocks(spark, sf_dir):
    return x.label_blocks(_TEXTS.frame(spark))


def _components(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in x.INDICATORS) + ")"


_KEYWORD = f"SELECT doc_id, CAST(pos AS INT) AS pos, line AS name, {_BLOCK} AS address FROM {_LINES} s WHERE pos <= n - 4 AND {_any('line', x.BLOCK_WORDS)} AND {_components('array_to_string(l[pos + 1 : pos + 6], chr(10))')}"


@_C.add(_KEYWORD.replace("@t@", _TEXTS.sql + " t"))
def text_keyword_blocks(spark, sf_dir):
    return x.keyword_blocks(_TEXTS.frame(spark))


@_C.add(_KEYWORD.replace("@t@", "documents"))
def doc_keyword_blocks(spark, sf_dir):
    return x.keyword_blocks(read(spark, sf_dir, "documents"))


@_C.add(f"SELECT doc_id, CAST(pos + 1 + i AS INT) AS pos, t[1] AS name, array_to_string(t[2 : 3], ', ') AS address FROM (SELECT doc_id, pos, i, l[pos + 2 + i : least(pos + 4 + i, pos + 21)] AS t FROM {_LINES.replace('@t@', _TEXTS.sql + ' t')} s, (SELECT unnest(range(0, 19, 3)) AS i) k WHERE regexp_matches(line, '{x.SECTIONS}')) q WHERE len(t) = 3 AND {_components(chr(97) + 'rray_to_string(t, ' + chr(39) + ', ' + chr(39) + ')')}")
def text_sections(spark, sf_dir):
    return x.section_triples(_TEXTS.frame(spark))


def _places(country: str, p: str, state: bool) -> str:
    g = lambda n: f"regexp_extract_all(text, '{p}', {n})"
    return f"SELECT doc_id, '{country}' AS country, CAST(i - 1 AS INT) AS n, {g(1)}[i] AS city, {g(2) + '[i]' if state else chr(39) * 2} AS state, {g(3 if state else 2)}[i] AS postcode FROM (SELECT doc_id, text, unnest(range(1, len({g(0)}) + 1)) AS i FROM {_TEXTS.sql} t) q"


@_C.add(" UNION ALL ".join((_places("USA", x.CITY_STATE, True), _places("GBR", x.UK_PLACE, False), _places("NLD", x.NL_PLACE, False))))
def text_places(spark, sf_dir):
    return x.places(_TEXTS.frame(spark))


@_C.add(f"SELECT doc_id, CAST(i - 1 AS INT) AS n, m[i] AS match FROM (SELECT doc_id, regexp_extract_all(text, '{x.STREET}') AS m, unnest(range(1, len(regexp_extract_all(text, '{x.STREET}')) + 1)) AS i FROM {_TEXTS.sql} t) q")
def text_streets(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    return x.street_spans(_TEXTS.frame(spark)).select("doc_id", n.alias("n"), "match")


_FAX = f"list_filter(list_transform(regexp_extract_all(text, '{x.FAX}', 1), lambda f: trim(regexp_replace(f, '\\s+$', ''))), lambda f: length(regexp_replace(f, '\\D', '', 'g')) >= 7)"


@_C.add(f"SELECT doc_id, array_to_string({_FAX}, ',') AS fax, {' OR '.join(f"len(regexp_extract_all(text, '{p}')) > 0" for p in x.HOURS)} AS has_hours FROM {_TEXTS.sql} t")
def text_contacts(spark, sf_dir):
    c = F.col("text")
    return _TEXTS.frame(spark).select("doc_id", F.array_join(F.transform(x.faxes(c), lambda f: F.regexp_replace(f, r"\s+$", "")), ",").alias("fax"), (F.size(x.hours(c)) > 0).alias("has_hours"))


def _null(e: str) -> str:
    return f"nullif({e}, '')"


_COUNTRY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{n}\\b') THEN '{n}' END" for n in sorted(x.COUNTRIES, key=lambda n: (-len(n), n))) + ")"


def _found(patterns, group: int = 0) -> str:
    """The first match of the first pattern that has one; DuckDB's patterns look nowhere ahead."""
    return "coalesce(" + ", ".join(_null(f"trim(regexp_extract(text, '{p.split('(?!')[0]}', {group}))") for p in patterns) + ")"


_CITY = f"coalesce({_found((x.CITY,), 1)}, {', '.join(f'CASE WHEN contains(text, {chr(39)}{n}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for n in x.CITIES)})"
PARSED = f"{_found(x.STREETS)} AS street, {_CITY} AS city, {_found(x.REGIONS)} AS state, {_found(x.POSTAL)} AS postal, {_COUNTRY} AS country, lower({_found((x.EMAIL,))}) AS email"


@_C.add(f"SELECT doc_id, {PARSED} FROM {_TEXTS.sql} t")
def text_parse_address(spark, sf_dir):
    p = x.parse_address(F.col("text"))
    return _TEXTS.frame(spark).select("doc_id", *(p[n].alias(n) for n in ("street", "city", "state", "postal", "country", "email")))


_LOOK = Rows("id bigint, line string", (1, "12 Main Street, Springfield 62704"), (2, "short 1 St"), (3, "Suite 500 in a tall building"), (4, "P.O. Box 123 somewhere far"), (5, "no numbers but a Street here"), (6, "K1A 0B1 is a postal code of Canada"), (7, "the year 2024 was long and dull"), (8, None))


@_C.add(f"SELECT id, coalesce({_LOOKS}, false) AS looks, coalesce({_components('line')}, false) AS components FROM {_LOOK.sql} t")
def looks_like_address(spark, sf_dir):
    c = F.col("line")
    return _LOOK.frame(spark).select("id", F.coalesce(address.looks_like_address(c), F.lit(False)).alias("looks"), F.coalesce(x.has_components(c), F.lit(False)).alias("components"))
