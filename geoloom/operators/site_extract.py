"""More extraction strategies over the node table: exact types of linked data, lists in containers, carried headers, sections by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import address
from geoloom.functions.text import contains_any, first_filled
from geoloom.operators import text_extract
from geoloom.operators.html import attr, inside
from geoloom.operators.json_extract import field, top_objects

#: Types of linked data that three readers of it accept.
LISTED_TYPES = ("Organization", "LocalBusiness", "Place", "PostalAddress")
OWNER_TYPES = ("Organization", "LocalBusiness")
STRUCTURED_TYPES = ("Organization", "LocalBusiness", "Place")
#: Classes and parts of classes and ids of containers of places, and of the items in them.
CONTAINERS = ("locations-list", "location-list", "office-list", "offices-list", "locations-grid", "location-grid", "offices-grid", "grid-contacts", "addresses-section", "addresses-col", "addresses-box", "addresses-2", "wp-block-group", "elementor-widget-container")
CONTAINER_PARTS, CONTAINER_IDS = ("location-list", "office-list", "contact", "address"), ("locations", "offices", "map", "address")
ITEMS = ("location-item", "office-item", "location", "office", "contact-in-grid", "address-item", "address-box", "address-text", "address-map", "card", "box")
ITEM_PARTS, ITEM_TAGS = ("location-", "office-", "contact-", "address-"), ("li", "article", "address")
#: Sections that hold one place.
SECTIONS = ("location", "office", "address", "contact-info", "contact", "headquarters", "branch", "store-location", "office-location", "location-item")
SECTION_PARTS, SECTION_IDS, SECTION_ID_PARTS = ("location", "office"), ("contact", "location", "address"), ("location",)
#: Classes of cards.
CARDS, CARD_PARTS = ("card", "location-card", "office-card", "address-card", "item", "box", "panel"), ("card", "location", "office")


def _heading() -> Column:
    return F.col("tag").rlike("^(h[1-6]|strong|b)$")


def _classed(names: tuple[str, ...], parts: tuple[str, ...] = ()) -> Column:
    """A class is one of names, or the class attribute has one of the parts."""
    whole = F.array_join("classes", " ")
    out = F.arrays_overlap("classes", F.array(*map(F.lit, names)))
    return out | contains_any(whole, parts) if parts else out


def _id_has(parts: tuple[str, ...]) -> Column:
    return F.coalesce(contains_any(F.col("elem_id"), parts), F.lit(False))


def _part(name: str) -> Column:
    return F.coalesce(F.get_json_object("obj", f"$.address.{name}"), F.lit(""))


def _address(obj: str = "address") -> Column:
    """An address that is text, or 'street, city, region postal' of one that has parts."""
    parts = F.trim(F.concat(_part("streetAddress"), F.lit(", "), _part("addressLocality"), F.lit(", "), _part("addressRegion"), F.lit(" "), _part("postalCode")))
    return F.when(field(obj).startswith("{"), parts).otherwise(field(obj))


def _scripts(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("tag") == "script") & (F.lower(attr("type")) == "application/ld+json"))


def linked_listed(nodes: DataFrame) -> DataFrame:
    """Objects at the top of linked data whose type is just one of four, with an address of over 10 characters (their own or their location's)."""
    rows = top_objects(_scripts(nodes), "page_id", "text").where(field("@type").isin(*LISTED_TYPES))
    inner = rows.where(field("address").isNull()).withColumn("name", F.coalesce(field("name"), F.get_json_object("obj", "$.location.name"))).withColumn("obj", F.get_json_object("obj", "$.location"))
    both = rows.withColumn("name", field("name")).unionByName(inner.select("page_id", "seq", "obj", "name"), allowMissingColumns=True)
    out = both.select("page_id", "seq", first_filled(F.col("name"), default="Office").alias("name"), _address().alias("address"), first_filled(field("telephone")).alias("phone"), first_filled(field("email")).alias("email"))
    return out.where(F.length("address") > 10)


def linked_owned(nodes: DataFrame, host: Column) -> DataFrame:
    """Objects of two types that have an address; the type is the activity, the site's host the name where there is none."""
    rows = top_objects(_scripts(nodes), "page_id", "text").where(field("@type").isin(*OWNER_TYPES) & field("address").isNotNull())
    return rows.select("page_id", "seq", F.coalesce(F.nullif(field("name"), F.lit("")), host).alias("name"), _address().alias("address"), field("@type").alias("activity"))


def linked_structured(nodes: DataFrame) -> DataFrame:
    """Objects of three types with a name or an address, whose given parts (the country too) are joined by commas."""
    rows = top_objects(_scripts(nodes), "page_id", "text").where(field("@type").isin(*STRUCTURED_TYPES))
    parts = address.joined_address(*(_part(n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")))
    text = F.when(field("address").startswith("{"), parts).otherwise(F.coalesce(field("address"), F.lit("")))
    out = rows.select("page_id", "seq", first_filled(field("name")).alias("name"), text.alias("address"), first_filled(field("telephone")).alias("phone"), field("@type").alias("type"))
    return out.where((F.col("name") != "") | (F.col("address") != ""))


def microdata_named(nodes: DataFrame) -> DataFrame:
    """Items of three types with a street or city: the texts of their properties, and the name of the organisation around them where they have none."""
    kind = attr("itemtype")
    items = nodes.where(kind.contains("PostalAddress") | kind.contains("Organization") | kind.contains("LocalBusiness"))
    props = nodes.where(attr("itemprop").isNotNull()).withColumn("prop", attr("itemprop"))
    pairs = inside(items, props)
    texts = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("prop") == n, F.struct("node_id", "text")))), lambda x: x["text"]), "").alias(n)
    first = F.min_by(F.when(F.col("prop") == "name", F.col("text")), F.when(F.col("prop") == "name", F.col("node_id"))).alias("own")
    rows = pairs.groupBy("page_id", "o_node").agg(*(texts(n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "telephone")), first)
    around = inside(items.where(kind.contains("Organization")), items.select("page_id", "node_id")).select("page_id", "node_id", F.col("o_node").alias("org"))
    nearest = around.groupBy("page_id", F.col("node_id").alias("o_node")).agg(F.max("org").alias("org"))
    names = rows.select("page_id", F.col("o_node").alias("org"), F.col("own").alias("org_name"))
    rows = rows.join(nearest, ["page_id", "o_node"], "left").join(names, ["page_id", "org"], "left").where("streetAddress <> '' OR addressLocality <> ''")
    text = F.trim(F.concat("streetAddress", F.lit(", "), "addressLocality", F.lit(", "), "addressRegion", F.lit(" "), "postalCode"))
    return rows.select("page_id", F.col("o_node").alias("seq"), first_filled(F.col("own"), F.col("org_name"), default="Office").alias("name"), text.alias("address"), F.col("telephone").alias("phone"))


def listed(nodes: DataFrame) -> DataFrame:
    """Items in containers of places: an address found in the text, else the text of address elements and paragraphs; named by a heading, a title or the address's first part."""
    containers = nodes.where(_classed(CONTAINERS, CONTAINER_PARTS) | _id_has(CONTAINER_IDS))
    item = (_classed(ITEMS, ITEM_PARTS) | F.col("tag").isin(*ITEM_TAGS)) & (F.length("text") >= 20)
    items = inside(containers, nodes.where(item)).select("page_id", "node_id", "end_id", "text", "attrs").dropDuplicates(["page_id", "node_id"])
    named = inside(items, nodes.where(_heading())).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.min_by("text", "node_id").alias("head"))
    titled = inside(items, nodes.where(_classed(("title",), ("title", "name")))).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.min_by("text", "node_id").alias("title"))
    inner = nodes.where(_classed(("address", "location-address"), ("address",)) | (F.col("tag") == "p"))
    texts = inside(items, inner).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ").alias("inner"))
    rows = items
    for other in (named, titled, texts):
        rows = rows.join(other, ["page_id", "node_id"], "left")
    found = F.coalesce(text_extract.find_address(F.col("text")), F.trim("inner"))
    rows = rows.withColumn("address", found).where(F.length("address") > 15)
    name = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("head"), F.col("title"), F.get(F.split("address", ","), F.lit(0)))))
    return rows.select("page_id", F.col("node_id").alias("seq"), F.substring(name, 1, 100).alias("name"), "address")


def carried_cards(nodes: DataFrame) -> DataFrame:
    """Cards with a street, postal code or state, and a city (their heading) or a country; the page's last heading with a country or region gives those that a card lacks."""
    heads = nodes.where(_heading() | _classed(("country", "region"), ("country", "region"))).withColumn("up", F.upper("text"))
    country, region = text_extract.country_in(F.col("up")), F.when(text_extract.state_in(F.col("up")).isNotNull(), F.col("up"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("node_id")))
    carried = heads.groupBy("page_id").agg(last(country).alias("c_country"), last(region).alias("c_region"))
    cards = nodes.where((_classed(CARDS, CARD_PARTS) | (F.col("tag") == "article")) & (F.length("text") >= 30))
    titles = nodes.where(_heading() | _classed(("city", "title"), ("city", "title")))
    named = inside(cards, titles).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.min_by("text", "node_id").alias("city"))
    own = nodes.where((F.length("own_text") > 5) & ~text_extract.is_header_text(F.col("own_text")) & (text_extract.has_address_parts(F.col("own_text")) | F.col("own_text").rlike(r"\d")))
    lines = inside(cards, own).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "own_text"))), lambda x: x["own_text"]), ", ").alias("lines"))
    rows = cards.join(named, ["page_id", "node_id"], "left").join(lines, ["page_id", "node_id"], "left").join(carried, "page_id", "left")
    p = text_extract.parse_address(F.col("text"))
    rows = rows.select("page_id", F.col("node_id").alias("seq"), F.coalesce("city", F.lit("")).alias("city"), p.alias("p"), F.coalesce("c_country", text_extract.country_in(F.col("text"))).alias("country"), "c_region", "lines")
    rows = rows.where((F.col("p.street").isNotNull() | F.col("p.postal").isNotNull() | F.col("p.state").isNotNull()) & ((F.col("city") != "") | F.col("country").isNotNull()))
    name = F.when(F.col("city") != "", F.col("city")).otherwise(F.concat("country", F.lit(" Office")))
    return rows.select("page_id", "seq", name.alias("name"), F.coalesce("p.street", "lines", F.lit("")).alias("address"), F.coalesce("p.state", "c_region").alias("state"), F.col("p.postal").alias("postcode"), "country")


def section_places(nodes: DataFrame, host: Column) -> DataFrame:
    """Elements classed as one place, with the address in their text; named by a heading inside, a heading beside, or the host."""
    hit = _classed(SECTIONS, SECTION_PARTS) | F.coalesce(F.col("elem_id").isin(*SECTION_IDS), F.lit(False)) | _id_has(SECTION_ID_PARTS) | F.coalesce(attr("itemprop") == "address", F.lit(False))
    rows = nodes.where(hit).withColumn("address", text_extract.address_of(F.col("text"))).where("address IS NOT NULL")
    titles = nodes.where(_heading() | _classed(("title", "name", "location-name")))
    named = inside(rows, titles).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.min_by("text", "node_id").alias("head"))
    parents = rows.select("page_id", F.col("node_id").alias("child"), F.col("parent_id").alias("node_id")).join(nodes.select("page_id", "node_id", "end_id", "text", "attrs"), ["page_id", "node_id"])
    beside = inside(parents.dropDuplicates(["page_id", "node_id"]), nodes.where(F.col("tag").rlike("^h[1-6]$"))).groupBy("page_id", F.col("o_node").alias("parent_id")).agg(F.min_by("text", "node_id").alias("beside"))
    rows = rows.join(named, ["page_id", "node_id"], "left").join(beside, ["page_id", "parent_id"], "left")
    name = F.coalesce(F.nullif("head", F.lit("")), F.nullif("beside", F.lit("")), host)
    return rows.select("page_id", F.col("node_id").alias("seq"), F.substring(name, 1, 100).alias("name"), "address")


def named_attributes(nodes: DataFrame) -> DataFrame:
    """Names of places from elements with data-slug, data-location, data-city or data-office: their text, an attribute, or the slug in capitals."""
    slug, place, city, office = (attr(f"data-{n}") for n in ("slug", "location", "city", "office"))
    rows = nodes.where(slug.isNotNull() | place.isNotNull() | city.isNotNull() | office.isNotNull())
    titled = F.initcap(F.regexp_replace(slug, "-", " "))
    name = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("text"), place, city, office, titled)))
    return rows.select("page_id", F.col("node_id").alias("seq"), name.alias("name")).where(F.length("name").between(3, 99))


def slug_arrays(nodes: DataFrame) -> DataFrame:
    """Names of places in scripts' arrays of the form [["City", "slug", ...: the first capitalised text of each."""
    scripts = nodes.where((F.col("tag") == "script") & contains_any(F.col("text"), ("location", "office", "address")))
    heads = F.regexp_extract_all("text", F.lit(r"""\[\s*\[["'][^"']+["'],\s*["'][^"']+["']"""), F.lit(0))
    rows = scripts.select("page_id", F.col("node_id").alias("seq"), F.posexplode(heads).alias("n", "m"))
    name = F.regexp_extract("m", r"""["']([A-Z][a-zA-Z\s&/\-().]+)["']""", 1)
    return rows.select("page_id", "seq", "n", name.alias("name")).where(F.length("name").between(3, 99) & ~F.col("name").contains("http"))
