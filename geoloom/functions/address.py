"""Normal forms of addresses, states, postal codes, countries, phones; keys that are compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.text import ascii_bounds, filled, matches_any, squeezed

#: Street words and their short forms.
STREET_WORDS = {
    "street": "St", "st.": "St", "str": "St", "avenue": "Ave", "ave.": "Ave", "av": "Ave", "road": "Rd", "rd.": "Rd",
    "boulevard": "Blvd", "blvd.": "Blvd", "drive": "Dr", "dr.": "Dr", "lane": "Ln", "ln.": "Ln", "court": "Ct", "ct.": "Ct",
    "place": "Pl", "pl.": "Pl", "square": "Sq", "sq.": "Sq", "terrace": "Ter", "ter.": "Ter", "parkway": "Pkwy", "pkwy.": "Pkwy",
    "highway": "Hwy", "hwy.": "Hwy", "building": "Bldg", "bldg.": "Bldg", "suite": "Ste", "ste.": "Ste", "floor": "Fl", "fl.": "Fl",
    "flr": "Fl", "apartment": "Apt", "apt.": "Apt",
}
#: States by name.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT",
    "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI",
    "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH",
    "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD",
    "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY",
}
#: Countries by name, two and three letters.
COUNTRIES = {
    "usa": "US", "united states": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "uk": "GB", "united kingdom": "GB",
    "great britain": "GB", "england": "GB", "australia": "AU", "aus": "AU", "canada": "CA", "can": "CA", "germany": "DE",
    "deutschland": "DE", "france": "FR", "spain": "ES", "españa": "ES", "italy": "IT", "italia": "IT", "netherlands": "NL",
    "holland": "NL", "switzerland": "CH", "schweiz": "CH", "india": "IN", "china": "CN", "japan": "JP", "singapore": "SG",
}
ISO3 = {
    "US": "USA", "GB": "GBR", "CA": "CAN", "AU": "AUS", "DE": "DEU", "FR": "FRA", "IT": "ITA", "ES": "ESP", "NL": "NLD", "BE": "BEL",
    "CH": "CHE", "AT": "AUT", "SE": "SWE", "NO": "NOR", "DK": "DNK", "FI": "FIN", "PL": "POL", "CZ": "CZE", "IE": "IRL", "PT": "PRT",
    "GR": "GRC", "HU": "HUN", "RO": "ROU", "BG": "BGR", "HR": "HRV", "SI": "SVN", "SK": "SVK", "LT": "LTU", "LV": "LVA", "EE": "EST",
    "IS": "ISL", "LU": "LUX", "MT": "MLT", "CY": "CYP", "JP": "JPN", "CN": "CHN", "IN": "IND", "KR": "KOR", "SG": "SGP", "MY": "MYS",
    "TH": "THA", "ID": "IDN", "PH": "PHL", "VN": "VNM", "NZ": "NZL", "MX": "MEX", "BR": "BRA", "AR": "ARG", "CL": "CHL", "CO": "COL",
    "PE": "PER", "VE": "VEN", "ZA": "ZAF", "NG": "NGA", "EG": "EGY", "KE": "KEN", "SA": "SAU", "AE": "ARE", "IL": "ISR", "TR": "TUR",
    "RU": "RUS", "UA": "UKR", "BY": "BLR", "KZ": "KAZ", "UZ": "UZB",
}


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def street(c: Column) -> Column:
    """White space squeezed, street words shortened, commas at the end and spaces in '101 - 102' gone; null is ''."""
    out = squeezed(F.coalesce(c, F.lit("")))
    for word, short in STREET_WORDS.items():
        stem = word.rstrip(".")
        out = F.regexp_replace(out, rf"(?i)\b{stem}\.(?!\w)" if word.endswith(".") else rf"(?i)\b{stem}\b(?!\.)", short)
    out = F.regexp_replace(out, "[,;]+$", "")
    return F.regexp_replace(out, r"^(.*?\d)\s*-\s*(\d)", "$1-$2")


def state(c: Column) -> Column:
    upper = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.element_at(lookup(STATES), upper), upper)


def postal_code(c: Column) -> Column:
    code = F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), r"[\s-]", "")
    zip9 = F.concat(F.substring(code, 1, 5), F.lit("-"), F.substring(code, 6, 4))
    return F.when(code.rlike(r"^\d{9}$"), zip9).when(code.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"), F.concat(F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 3))).otherwise(code)


def country_alpha2(c: Column) -> Column:
    """Two letters: by name first, so that 'uk' is GB; what is unknown in upper case."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.element_at(lookup(COUNTRIES), low), F.upper(low))


def country_alpha3(c: Column) -> Column:
    """Three letters stay, two are looked up (unknown: as they are), others are ''."""
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.length(up) == 3, up).when(F.length(up) == 2, F.coalesce(F.element_at(lookup(ISO3), up), up)).otherwise("")


def phone_display(c: Column) -> Column:
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    plus = text.startswith("+")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    part = lambda a, n: F.substring(digits, a, n)
    ten = F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))
    eleven = F.concat(F.lit("+"), part(1, 1), F.lit("-"), part(2, 3), F.lit("-"), part(5, 3), F.lit("-"), part(8, 4))
    return F.when(~plus & (F.length(digits) == 10), ten).when(~plus & (F.length(digits) == 11) & digits.startswith("1"), eleven).when(plus, F.concat(F.lit("+"), digits)).otherwise(digits)


def phone_plain(c: Column) -> Column:
    """+ and the digits, null under ten characters."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[-.\s()]", ""), r"^\+", "")
    return F.when(F.length(bare) >= 10, F.concat(F.lit("+"), bare))


def coordinate(c: Column) -> Column:
    """A number; null for text that is none, 0 and NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (x != 0), x)


def plain_number(c: Column) -> Column:
    """A number as text, with decimals from 0.0001 to 10^16 where Spark writes an exponent (5.0E-4 is 0.0005); beyond that as 1e-05."""
    s = c.cast("string")
    part = lambda i: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
    sign, first, rest, e = part(1), part(2), F.when(part(3) == "0", "").otherwise(part(3)), F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(first, rest)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    whole, after = F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, "0"), F.substring(digits, e + 2, F.lit(20))
    large = F.concat(sign, whole, F.lit("."), F.when(after == "", "0").otherwise(after))
    other = F.concat(sign, first, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    return F.when(~s.contains("E") | (part(4) == ""), s).when((e < 0) & (e >= -4), small).when((e >= 0) & (e < 16), large).otherwise(other)


def comparison_address(c: Column) -> Column:
    """Lower case, punctuation and street words gone: what similarity looks at."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd)\b", ""))


def key_address(c: Column) -> Column:
    """Lower case, punctuation as space, street and suite words gone: what exact duplicates share."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,\-#]", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\b(street|st|avenue|ave|road|rd|boulevard|blvd|suite|ste|unit|apt)\b", ""), r"\s+", " "))


def comparison_postcode(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"\W", "")


def canonical_key(name: Column, street_: Column, city: Column, postal: Column, lat: Column, lon: Column) -> Column:
    """The fields given, joined by |, lower case, letters and digits only; else the coordinates; else null."""
    joined = F.concat_ws("|", filled(name), filled(street_), filled(city), filled(postal))
    place = F.when(coordinate(lat).isNotNull() & coordinate(lon).isNotNull(), F.concat(F.lit("coord_"), plain_number(lat), F.lit("_"), plain_number(lon)))
    return F.when(joined != "", F.regexp_replace(F.lower(joined), r"[^a-z0-9|]", "")).otherwise(place)


def joined_address(*parts: Column) -> Column:
    """The parts given, joined by ', '."""
    return F.array_join(F.array_compact(F.array(*(filled(p) for p in parts))), ", ")


def templated_address(street_: Column, city: Column, region: Column, postal: Column, country: Column | None = None) -> Column:
    """'street, city, region postal', missing parts empty, and the country after another comma if there is one."""
    part = lambda c: F.coalesce(c, F.lit(""))
    out = F.trim(F.concat(part(street_), F.lit(", "), part(city), F.lit(", "), part(region), F.lit(" "), part(postal)))
    return out if country is None else F.when(filled(country).isNotNull(), F.concat(out, F.lit(", "), country)).otherwise(out)


#: Street words.
STREET_SUFFIX = r"(Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Square|Sq|Parkway|Pkwy)"
#: What makes a line look like an address.
INDICATORS = (
    rf"(?i)\b{STREET_SUFFIX}\b",
    r"(?i)\b(Suite|Ste|Floor|Fl|Building|Bldg|Unit|Apt|#)\s*\d+",
    r"\b\d{5}(-\d{4})?\b",
    r"\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b",
    r"\b[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}\b",
    r"(?i)P\.?O\.?\s*Box\s+\d+",
    r"(?i)\b(city|town|village|state|province|county|zip|postal|code)\b",
)
#: Patterns of address lines, of postal codes by country, and of streets in blocks.
LINE_PATTERNS = (rf"(?i)\d{{1,5}}\s+\w+\s+{STREET_SUFFIX}", INDICATORS[1], INDICATORS[5], r"\d{1,5}\s+[\w\s,]+\d{5}(-\d{4})?")
PIN_PATTERNS = {"india": r"\b\d{6}\b", "us": r"\b\d{5}(?:-\d{4})?\b", "uk": r"(?i)\b[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}\b", "canada": r"(?i)\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"}
STREET_LINE = r"(?i)\d+\s+[\w\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|place|pl)\b"


def looks_like_address(c: Column) -> Column:
    """An indicator, a digit and 20 to 400 characters."""
    return matches_any(c, map(ascii_bounds, INDICATORS)) & c.rlike(r"\d") & F.length(c).between(20, 400)


def looks_like_block(c: Column) -> Column:
    """A street or a postal code, at least two parts between commas, 20 characters."""
    return (c.rlike(STREET_LINE) | matches_any(c, PIN_PATTERNS.values())) & (F.size(F.split(c, ",")) >= 2) & (F.length(c) >= 20)


def pins(c: Column) -> Column:
    """array<struct<code, country>> of postal codes by country's pattern."""
    found = (F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), _coded(k)) for k, p in PIN_PATTERNS.items())
    return reduce(F.concat, found)


def _coded(country: str):
    return lambda x: F.struct(x.alias("code"), F.lit(country).alias("country"))
