"""Locations from JSON: linked data, answers of services, values assigned in scripts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import address
from geoloom.functions.text import first_filled

DEPTH = 15
#: Types of linked data that are locations; keys of lists in answers; other names of fields.
TYPES = ("LocalBusiness", "Organization", "Place", "PostalAddress", "Store", "OfficeLocation", "CorporateHeadquarters", "BusinessPlace", "BranchOffice")
LISTS = ("locations", "stores", "offices", "branches", "data", "results", "items", "features")
ALIASES = {
    "name": ("name", "title", "storeName", "locationName", "officeName", "branchName", "store_name"),
    "address": ("address", "fullAddress", "street_address", "streetAddress", "location", "addr"),
    "city": ("city", "town", "locality", "street_city"),
    "state": ("state", "region", "province", "stateProvince"),
    "postcode": ("postcode", "zipCode", "zip", "postalCode", "postal_code", "zip_code"),
    "latitude": ("latitude", "lat", "y"),
    "longitude": ("longitude", "lng", "lon", "x"),
    "phone": ("phone", "telephone", "tel", "phoneNumber", "phone_number"),
    "email": ("email", "mail", "emailAddress"),
    "country": ("country", "countryCode", "country_code"),
}
STREETS = ("street", "street1", "address1", "line1")


def _objects(value, depth: int = 0):
    if depth > DEPTH:
        return
    if isinstance(value, dict):
        yield depth, value
        for v in value.values():
            yield from _objects(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            yield from _objects(v, depth + 1)


def _lists(value, path: str = "$", depth: int = 0):
    if isinstance(value, list):
        yield path, len(value), depth
    if depth < 5:
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            yield from _lists(v, f"{path}.{k}", depth + 1)


def _each(rows: DataFrame, key: str, text: str, schema: str, types: list, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(t or "")
                except (ValueError, RecursionError):
                    continue
                out += [(k, *x) for x in make(value)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), *types))], names=names)

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)


def objects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, depth and obj (JSON) of every object in JSON texts, down to DEPTH; broken texts have none."""
    make = lambda v: [(i, d, json.dumps(o, ensure_ascii=False)) for i, (d, o) in enumerate(_objects(v))]
    return _each(rows, key, text, f"{key} long, seq long, depth long, obj string", [pa.int64(), pa.int64(), pa.string()], make)


def top_objects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq and obj (JSON) of the object that a JSON text is, or of the objects in the list that it is."""
    make = lambda v: [(i, json.dumps(o, ensure_ascii=False)) for i, o in enumerate(v if isinstance(v, list) else [v]) if isinstance(o, dict)]
    return _each(rows, key, text, f"{key} long, seq long, obj string", [pa.int64(), pa.string()], make)


def list_census(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, length and depth of the lists in JSON texts, down to depth 5."""
    return _each(rows, key, text, f"{key} long, path string, length long, depth long", [pa.string(), pa.int64(), pa.int64()], _lists)


def field(name: str, obj: str = "obj") -> Column:
    return F.get_json_object(F.col(obj), f"$['{name}']")


def _plain(c: Column) -> Column:
    """Text only: not of an object or list."""
    return F.when(~c.startswith("{") & ~c.startswith("["), c)


def any_of(names) -> Column:
    return first_filled(*(_plain(field(n)) for n in names))


def linked(found: DataFrame, key: str) -> DataFrame:
    """Locations among objects by @type, with an address or a place."""
    kind = F.coalesce(field("@type"), F.lit(""))
    hit = F.lit(False)
    for t in TYPES:
        hit = hit | kind.contains(t)
    part = lambda n: first_filled(_plain(F.get_json_object("obj", f"$.address.{n}")))
    country = F.coalesce(F.get_json_object("obj", "$.address.addressCountry.name"), _plain(F.get_json_object("obj", "$.address.addressCountry")))
    parts = [part("streetAddress"), part("addressLocality"), part("addressRegion"), part("postalCode"), F.coalesce(country, F.lit(""))]
    text = F.when(field("address").startswith("{"), address.joined_address(*parts)).otherwise(first_filled(field("address")))
    first = lambda n: F.coalesce(F.get_json_object("obj", f"$.{n}[0]"), F.get_json_object("obj", f"$.{n}"))
    rows = found.where(hit & (kind != "PostalAddress")).select(key, "seq", first_filled(field("name"), field("legalName")).alias("name"), text.alias("address"), address.coordinate(F.get_json_object("obj", "$.geo.latitude")).alias("latitude"), address.coordinate(F.get_json_object("obj", "$.geo.longitude")).alias("longitude"), first("telephone").alias("phone"), F.lit(0.95).alias("confidence"))
    return rows.where((F.col("address") != "") | F.col("latitude").isNotNull())


def answers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Locations in answers of services: a list, or the first known list of an object; features of GeoJSON have theirs in properties."""

    def items(value):
        if isinstance(value, dict):
            value = next((value[k] for k in LISTS if isinstance(value.get(k), list)), [])
        if not isinstance(value, list):
            return
        for i, x in enumerate(value):
            if not isinstance(x, dict):
                continue
            if x.get("type") == "Feature":
                g, p = x.get("geometry"), x.get("properties")
                if not isinstance(g, dict) or not isinstance(p, dict):
                    continue
                lon, lat = (list(g.get("coordinates") or []) + [None, None])[:2]
                x = p | {"latitude": lat, "longitude": lon}
            yield i, json.dumps(x, ensure_ascii=False)

    found = _each(rows, key, text, f"{key} long, seq long, obj string", [pa.int64(), pa.string()], items)
    return located(found, key)


def located(found: DataFrame, key: str) -> DataFrame:
    """Objects with a name or an address, by any of the known names of fields."""
    street = F.coalesce(*(F.nullif(_plain(field(n)), F.lit("")) for n in ALIASES["address"]), address.joined_address(any_of(STREETS), any_of(ALIASES["city"]), any_of(ALIASES["state"]), any_of(ALIASES["postcode"])))
    place = lambda n: address.coordinate(F.coalesce(*(field(a) for a in ALIASES[n])))
    out = found.select(key, "seq", any_of(ALIASES["name"]).alias("name"), street.alias("address"), any_of(ALIASES["city"]).alias("city"), any_of(ALIASES["state"]).alias("state"), any_of(ALIASES["postcode"]).alias("postcode"), address.country_alpha3(any_of(ALIASES["country"])).alias("country_iso3"), place("latitude").alias("latitude"), place("longitude").alias("longitude"), any_of(ALIASES["phone"]).alias("phone"), any_of(ALIASES["email"]).alias("email"))
    return out.where((F.col("name") != "") | (F.col("address") != ""))


def captured(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Locations anywhere in captured answers: objects with a name and an address, or with a place."""
    out = located(objects(rows, key, text), key)
    return out.where(((F.col("name") != "") & (F.col("address") != "")) | (F.col("latitude").isNotNull() & F.col("longitude").isNotNull())).withColumn("confidence", F.lit(0.85))


def assigned(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """key and json: what scripts assign to variables, window members and plain names, up to the semicolon."""
    pattern = r"(?s)(?:var|let|const)?\s*(?:window\.)?[A-Za-z_$][\w$.]*\s*=\s*(\[.*?\]|\{.*?\})\s*;"
    return scripts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("json"))
