"""Locations and contacts from text: lines of documents, label blocks, patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import address
from geoloom.functions.text import ascii_bounds, contains_any, matches_any

#: Patterns of contacts, and words that mark addresses.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
US_PHONE = r"\b1?[-.\s]?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b"
WORLD_PHONE = r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
FAX = r"(?i)(?:Fax|F)[\s:]+(\+?[\d\s\-().]+)"
HOURS = (
    r"(?i)\d{1,2}:\d{2}\s*[AP]M[\s-]+\d{1,2}:\d{2}\s*[AP]M", r"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)-+(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{1,2}[ap]m[-–]\d{1,2}[ap]m", r"(?i)Hours?[\s:]+\d{1,2}[ap]m[\s-]+\d{1,2}[ap]m",
    r"(?i)(?:Monday|Mon|Tuesday|Tue|Wednesday|Wed|Thursday|Thu|Friday|Fri|Saturday|Sat|Sunday|Sun)[\s-]+(?:to|through|thru|-)[\s]+(?:Monday|Mon|Tuesday|Tue|Wednesday|Wed|Thursday|Thu|Friday|Fri|Saturday|Sat|Sunday|Sun)[\s:]+\d{1,2}:\d{2}\s*[AP]M[\s-]+\d{1,2}:\d{2}\s*[AP]M",
    r"(?i)Open\s+(?:Monday|Mon|Tuesday|Tue|Wednesday|Wed|Thursday|Thu|Friday|Fri|Saturday|Sat|Sunday|Sun)[\s-]+(?:Monday|Mon|Tuesday|Tue|Wednesday|Wed|Thursday|Thu|Friday|Fri|Saturday|Sat|Sunday|Sun)")
ASSETS = (".png", ".jpg", ".gif", ".css", ".js", ".woff")
LABELS = ("address", "head office", "branch", "office", "showroom", "store", "location", "pincode", "postal code", "zip code", "city", "state", "country", "headquarters", "hq", "contact", "reach us", "visit us", "find us", "corporate office", "regional office", "odc", "delivery center")
BLOCK_WORDS = ("office", "headquarters", "location", "address", "branch", "oficina", "sede", "dirección", "sucursal", "bureau", "adres", "vestiging", "kantoor", "büro", "adresse", "niederlassung", "siège")
SECTIONS = r"(?i)our\s+offices?|our\s+locations?|branch\s+offices?|contact\s+information|global\s+presence|office\s+locations?"
INDICATORS = (r"(?i)\d{1,5}\s+[A-Z]", r"\d{5}(?:-\d{4})?", r"(?i)\d{4}\s*[A-Z]{2}", r"(?i)[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}", r"(?i)tel:?|phone:?|fax:?", r"(?i)(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln)")
CITY_STATE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)"
UK_PLACE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),?\s*([A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2})"
NL_PLACE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),?\s*(\d{4}\s*[A-Z]{2})"
STREET = r"(?i)\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Way|Lane|Ln|Court|Ct|Place|Pl|Plaza|Parkway|Pkwy|Circle|Cir|Terrace|Ter|Trail|Square|Suite|Floor|Level)\b"
REGION = r"\b(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|QLD|NSW|VIC|ACT|SA|TAS|NT|ON|BC|AB|MB|SK|NS|NB|PE|NL|YT|NU)\b"
COUNTRIES = ("United States", "USA", "US", "United Kingdom", "UK", "Canada", "Australia", "Germany", "France", "India", "China", "Japan", "Singapore", "Brazil", "Mexico", "Italy", "Spain", "Netherlands", "Switzerland", "Sweden", "Norway", "Denmark", "Finland", "Ireland", "Belgium", "Austria", "Poland", "Russia", "South Korea", "Taiwan", "Hong Kong", "Thailand", "Malaysia", "Indonesia", "Philippines", "Vietnam", "UAE", "Saudi Arabia", "Israel", "Egypt", "South Africa")
POSTAL = (r"\b\d{5}(?:-\d{4})?\b", r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b", r"\b[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}\b", r"\b\d{4}\b(?!\s*(?:Street|St|Avenue|Ave|Road|Rd))")
STREETS = (STREET, r"(?i)(?:Level|Suite|Floor|Unit)\s+\d+", r"(?i)\d+[-\s]\d+\s+[A-Z][a-z]+\s+(?:Street|Road|Avenue)")
REGIONS = (REGION, r"(?i)\b(Queensland|New South Wales|Victoria|Australian Capital Territory|South Australia|Western Australia|Tasmania|Northern Territory)\b", r"(?i)\b(Ontario|British Columbia|Alberta|Manitoba|Saskatchewan|Nova Scotia|New Brunswick)\b")
CITY = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*,\s*([A-Z]{2,3}|\d{5})"
CITIES = ("New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia", "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "San Francisco", "Seattle", "Denver", "Washington", "Boston", "Portland", "Las Vegas", "Miami", "Atlanta", "London", "Paris", "Berlin", "Tokyo", "Singapore", "Sydney", "Melbourne", "Brisbane", "Canberra", "Perth", "Adelaide", "Mumbai", "Bangalore", "Delhi", "Hyderabad", "Chennai", "Kolkata", "Pune")
#: Addresses in running text, by country, and what an address in one block of text is, first match first.
BODY = (
    r"(?i)\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Parkway|Pkwy|Plaza|Plz|Terrace|Ter|Highway|Hwy)[.,]?\s*(?:Suite|Ste|Unit|Apt|#)?\s*[\w\d-]*[.,]?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*[.,]?\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?",
    r"(?i)\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*[.,]?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*[.,]?\s*[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}",
    r"(?i)\d{4}\s*[A-Z]{2}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
    r"(?i)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+\d+[a-z]?\s*,?\s*\d{4}\s*[A-Z]{2}\s+[A-Z][a-z]+",
    r"(?i)\d+\s+[\w\s]+,\s*[\w\s]+,\s*[A-Z]{2}\s+\d{5}",
)
FULL_US = r"(?i)\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Parkway|Pkwy|Plaza|Plz|Terrace|Ter)[.,]?\s*(?:Suite|Ste|Unit|#)?\s*[\w\d-]*[.,]?\s*[\w\s]+[.,]?\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?"
INTERNATIONAL = r"(?i)[\w\s]+,\s*[\w\s]+,\s*[\w\s]+\s+\d{3,6}"
SHORTER = (r"(?i)\d+[\s\w,.-]+,\s*[\w\s]+,\s*[A-Z]{2}", r"(?i)\d+[\s\w,.-]+\d{5}")
HEADER_WORDS = ("click", "learn more", "view all")
PERSON = r"(?:Contact|Manager|Director|Coordinator)[\s:]+([A-Z][a-z]+\s+[A-Z][a-z]+)"
#: Phones by locale.
LOCALE_PHONES = {
    "india": r"(?:\+91|0)?[\s-]?\d{5}[\s-]?\d{5}|\d{3}[\s-]\d{3}[\s-]\d{4}",
    "us": r"(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "uk": r"(?:\+44|0)\s?\d{4}\s?\d{6}|\+44\s?\d{3}\s?\d{3}\s?\d{4}",
    "international": r"\+?\d{1,4}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
}


def all_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def emails(c: Column, junk: bool = True) -> Column:
    """Distinct addresses in lower case, sorted; without those that end as an asset does."""
    found = F.array_distinct(F.transform(all_of(c, EMAIL), F.lower))
    keep = F.filter(found, lambda e: ~_ends(e, ASSETS)) if junk else found
    return F.array_sort(keep)


def contact_emails(c: Column) -> Column:
    """Without addresses of example and placeholder domains."""
    return F.filter(emails(c), lambda e: ~contains_any(e, ("example.com", "domain.com", ".png", ".jpg")))


def _ends(c: Column, ends) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | c.endswith(e)
    return out


def phones(c: Column) -> Column:
    """Distinct numbers of either pattern with 7 to 15 digits, sorted."""
    both = F.array_union(F.transform(all_of(c, US_PHONE), lambda p: F.trim(p)), F.transform(all_of(c, WORLD_PHONE), lambda p: F.trim(p)))
    return F.array_sort(F.filter(both, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15)))


def hours(c: Column) -> Column:
    out = None
    for p in HOURS:
        found = F.transform(all_of(c, p), lambda p: F.trim(p))
        out = found if out is None else F.array_union(out, found)
    return F.array_distinct(out)


def faxes(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(FAX), F.lit(1)), lambda p: F.trim(p)), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 7)


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, pos (from 0) and line of the lines that have more than white space, trimmed."""
    return docs.select(key, F.posexplode(_line_array(F.col(text))).alias("pos", "line"))


def _line_array(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def _marked(docs: DataFrame, k: int, mark) -> DataFrame:
    """doc_id, pos, line, next (the k lines after it) and last (the document's last position) of lines that mark() picks, within each document's array of lines: nothing is shuffled."""
    rows = docs.select("doc_id", _line_array(F.col("text")).alias("l"))
    hits = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda s: mark(s["line"]))
    found = F.transform(hits, lambda s: F.struct(s["pos"].alias("pos"), s["line"].alias("line"), F.slice("l", s["pos"] + 2, F.lit(k)).alias("next"), (F.size("l") - 1).alias("last")))
    return rows.select("doc_id", F.inline(found))


def pattern_lines(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, pos and street of lines of 20 to 300 characters that match an address pattern and look like one.

    most: look at so many lines of a document only (the reference stops at 1,000); None: at all."""
    rows = lines(docs).where(F.length("line").between(20, 300))
    rows = rows if most is None else rows.where(F.col("pos") < most)
    return rows.where(matches_any(F.col("line"), map(ascii_bounds, address.LINE_PATTERNS)) & address.looks_like_address(F.col("line"))).select("doc_id", "pos", F.regexp_replace("line", r"\s+", " ").alias("street"))


def label_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, label and text of up to four lines after a line with a label, if they look like an address."""
    rows = _marked(docs, 4, lambda x: F.lower(x).rlike("|".join(LABELS))).withColumn("block", F.array_join("next", ", "))
    return rows.where(address.looks_like_block(F.col("block"))).select("doc_id", "pos", F.col("line").alias("label"), F.col("block").alias("text"))


def has_components(c: Column) -> Column:
    return matches_any(c, INDICATORS)


def keyword_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, name and address: lines with an office word and the four lines after, if the six from there look like an address. The last three lines begin no block."""
    rows = _marked(docs, 5, lambda x: F.lower(x).rlike("|".join(BLOCK_WORDS)))
    block = F.array_join(F.concat(F.array("line"), F.col("next")), "\n")
    rows = rows.where((F.col("pos") <= F.col("last") - 3) & has_components(block))
    return rows.select("doc_id", "pos", F.col("line").alias("name"), F.array_join(F.slice("next", 1, 4), ", ").alias("address"))


def section_triples(docs: DataFrame) -> DataFrame:
    """doc_id, pos, name and address: the 20 lines after a section's header, three at a time, those that look like an address."""
    rows = _marked(docs, 20, lambda x: x.rlike(SECTIONS))
    triples = F.transform(F.sequence(F.lit(0), F.lit(18), F.lit(3)), lambda i: F.slice("next", i + 1, F.lit(3)))
    rows = rows.select("doc_id", "pos", F.posexplode(triples).alias("n", "t")).where(F.size("t") == 3).where(has_components(F.array_join("t", ", ")))
    return rows.select("doc_id", (F.col("pos") + 1 + F.col("n") * 3).alias("pos"), F.col("t")[0].alias("name"), F.array_join(F.slice("t", 2, 2), ", ").alias("address"))


def places(docs: DataFrame) -> DataFrame:
    """doc_id, country, n, city, state, postcode of the city-and-code patterns of three countries in text."""

    def of(country: str, pattern: str, state: bool) -> DataFrame:
        c = F.col("text")
        whole, city, code = all_of(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(3 if state else 2))
        st = F.regexp_extract_all(c, F.lit(pattern), F.lit(2)) if state else F.transform(whole, lambda x: F.lit(""))
        rows = docs.select("doc_id", F.posexplode(F.arrays_zip(whole.alias("a"), city.alias("b"), st.alias("c"), code.alias("d"))).alias("n", "m"))
        return rows.select("doc_id", F.lit(country).alias("country"), "n", F.col("m.b").alias("city"), F.col("m.c").alias("state"), F.col("m.d").alias("postcode"))

    return of("USA", CITY_STATE, True).unionByName(of("GBR", UK_PLACE, False)).unionByName(of("NLD", NL_PLACE, False))


def street_spans(docs: DataFrame, pattern: str = STREET, context: int = 300) -> DataFrame:
    """doc_id, start, match and context (half before, half after its start) of every match: positions need Python, one call a batch."""
    import re

    finder = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, m.start(), m[0], (t[max(0, m.start() - context // 2) : m.start() + context // 2])) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in finder.finditer(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "start", "match", "context"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, match string, context string")


def first_of(c: Column, patterns, group: int = 0) -> Column:
    """The first match of the first pattern that has one, trimmed; null without any."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(c, p, group)), F.lit("")) for p in patterns))


def country_in(c: Column) -> Column:
    """The longest country name that stands in a text as whole words."""
    return F.coalesce(*(F.when(c.rlike(rf"(?i)\b{n}\b"), n) for n in sorted(COUNTRIES, key=lambda n: (-len(n), n))))


def state_in(c: Column) -> Column:
    """A state or province by code, else by name."""
    return first_of(c, REGIONS)


def city_in(c: Column) -> Column:
    """What stands before a comma and a code, else the first known city in the text."""
    return F.coalesce(first_of(c, (CITY,), 1), *(F.when(c.contains(n), n) for n in CITIES))


def parse_address(c: Column) -> Column:
    """struct<street, city, state, postal, country, phone, email> by the first pattern that matches; the longest country name as a whole word."""
    first = lambda p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return F.struct(first_of(c, STREETS).alias("street"), city_in(c).alias("city"), state_in(c).alias("state"), first_of(c, POSTAL).alias("postal"), country_in(c).alias("country"), first(US_PHONE).alias("phone"), F.lower(first(EMAIL)).alias("email"))


def has_address_parts(c: Column) -> Column:
    """A street, a postal code, or a number before a capital."""
    return matches_any(c, (*STREETS, *POSTAL, r"\d+\s+[A-Z]"))


def is_header_text(c: Column) -> Column:
    """Too short, or words of navigation."""
    low = F.lower(c)
    return (F.length(low) < 3) | contains_any(low, HEADER_WORDS) | low.startswith("more")


def find_address(c: Column) -> Column:
    """A US address, else city, region and code between commas, else the text itself if it is short and has a comma; null otherwise."""
    bare = F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    return F.coalesce(first_of(c, (FULL_US, INTERNATIONAL)), F.when(c.contains(",") & F.length(c).between(21, 299) & bare.contains(","), bare))


def address_of(c: Column) -> Column:
    """The first match of 16 to 199 characters of three patterns, from a whole US address to a number and a code."""
    out = [F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in (FULL_US, *SHORTER)]
    return F.coalesce(*(F.when(F.length(m).between(16, 199), F.trim(m)) for m in out))


def body_addresses(docs: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, pattern, n and address of all matches of the countries' patterns in texts."""
    found = F.array(*(F.transform(all_of(F.col(text), p), lambda m: F.trim(m)) for p in BODY))
    return docs.select(key, F.posexplode(found).alias("pattern", "m")).select(key, "pattern", F.posexplode("m").alias("n", "address"))


def full_addresses(docs: DataFrame, key: str = "page_id", text: str = "text", most: int = 50) -> DataFrame:
    """key, n and address of the first `most` different whole US addresses in texts."""
    return docs.select(key, F.posexplode(F.slice(F.array_distinct(all_of(F.col(text), FULL_US)), 1, most)).alias("n", "address"))


def people(c: Column) -> Column:
    """Names after Contact, Manager, Director or Coordinator."""
    return F.regexp_extract_all(c, F.lit(PERSON), F.lit(1))


def locale_phones(c: Column) -> Column:
    """array<struct<locale, phone>>: matches of each locale's pattern in their plain form, those of ten digits or more."""

    def plain(locale: str, pattern: str) -> Column:
        given = F.filter(F.transform(all_of(c, pattern), address.phone_plain), lambda p: p.isNotNull())
        return F.transform(given, lambda p: F.struct(F.lit(locale).alias("locale"), p.alias("phone")))

    return F.array_distinct(F.concat(*(plain(k, p) for k, p in LOCALE_PHONES.items())))
