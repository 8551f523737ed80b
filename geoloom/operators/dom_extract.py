"""Extraction strategies over the node table; each gives rows of page_id and what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import address
from geoloom.functions.text import contains_any
from geoloom.operators.html import attr, inside
from geoloom.operators.json_extract import assigned, captured, linked, objects
from geoloom.operators.text_extract import CITY_STATE, has_components

#: Maps by their address, and what marks pages that scripts draw.
MAPS = (("google", ("google.com/maps", "maps.google", "goo.gl/maps")), ("openstreetmap", ("openstreetmap.org",)), ("bing", ("bing.com/maps",)), ("mapbox", ("mapbox.com",)), ("here", ("here.com",)), ("apple", ("maps.apple.com",)))
SCRIPTED = ("__NEXT_DATA__", "__NUXT__", "data-reactroot", "ng-app", "ng-version", "data-v-app", 'id="root"', 'id="app"')
SEMANTIC = ("address", "adr", "vcard", "location-address", "office-address")
PLACE_WORDS = ("office", "location", "address", "branch", "headquarter", "contact")


def json_ld(nodes: DataFrame) -> DataFrame:
    scripts = nodes.where((F.col("tag") == "script") & (F.lower(attr("type")) == "application/ld+json"))
    return linked(objects(scripts, "page_id", "text"), "page_id")


def microdata(nodes: DataFrame) -> DataFrame:
    """The first value of each property inside an item of a place's type; content counts before text."""
    items = nodes.where(attr("itemtype").rlike("schema.org/(LocalBusiness|Organization|Place|Store|PostalAddress)"))
    outer = items.where(~attr("itemtype").contains("PostalAddress"))
    props = nodes.where(attr("itemprop").isNotNull()).withColumn("value", F.coalesce(attr("content"), F.col("text"))).withColumn("prop", attr("itemprop"))
    pairs = inside(outer, props)
    first = lambda n: F.min_by(F.when(F.col("prop") == n, F.col("value")), F.when(F.col("prop") == n, F.col("node_id"))).alias(n)
    rows = pairs.groupBy("page_id", "o_node").agg(*(first(n) for n in ("name", "streetAddress", "addressLocality", "addressRegion", "postalCode", "telephone")))
    text = address.joined_address(*(F.col(n) for n in ("streetAddress", "addressLocality", "addressRegion", "postalCode")))
    return rows.select("page_id", F.col("o_node").alias("seq"), "name", text.alias("address"), F.col("telephone").alias("phone"), F.lit(0.90).alias("confidence")).where(F.col("address") != "")


def sequential_headers(nodes: DataFrame) -> DataFrame:
    """h3 in capitals or with a bracket begin a country; others are cities, with the text of the siblings up to the next h3."""
    h = nodes.where((F.col("tag") == "h3") & (F.col("text") != ""))
    w = Window.partitionBy("page_id").orderBy("node_id")
    is_country = (F.col("text") == F.upper("text")) | F.col("text").contains("(")
    h = h.withColumns({"is_country": is_country, "country": F.last(F.when(is_country, F.col("text")), ignorenulls=True).over(w), "next": F.lead("node_id").over(w)})
    cities = h.where(~F.col("is_country") & F.col("country").isNotNull()).select("page_id", "parent_id", F.col("node_id").alias("h"), F.col("text").alias("city"), "country", "next")
    around = nodes.select("page_id", "parent_id", "node_id", F.col("text").alias("t")).where(F.col("t") != "")
    pairs = cities.join(around, ["page_id", "parent_id"]).where((F.col("node_id") > F.col("h")) & (F.col("next").isNull() | (F.col("node_id") < F.col("next"))))
    rows = pairs.groupBy("page_id", "h", "city", "country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda x: x["t"]), " ").alias("all"))
    return rows.where(F.length("all") > 20).select("page_id", F.col("h").alias("seq"), F.concat_ws(", ", "city", "country").alias("name"), F.substring("all", 1, 500).alias("address"))


def tables(nodes: DataFrame) -> DataFrame:
    """Rows with a city, state and code in tables that mention places; the first cell is the name."""
    outer = nodes.where((F.col("tag") == "table") & F.lower("text").rlike("address|location|office"))
    rows = inside(outer, nodes.where(F.col("tag") == "tr")).select("page_id", "node_id", "end_id", "text", "attrs")
    rows = rows.dropDuplicates(["page_id", "node_id"]).where(F.col("text").rlike(CITY_STATE))
    cells = inside(rows, nodes.where(F.col("tag").isin("td", "th"))).groupBy("page_id", "o_node").agg(F.min_by("text", "node_id").alias("name"), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x, i: i > 0), lambda x: x["text"]), ", ").alias("address"))
    return cells.select("page_id", F.col("o_node").alias("seq"), "name", "address")


def blocks(nodes: DataFrame, tags: tuple[str, ...], least: int, most: int, confidence: float) -> DataFrame:
    """Elements of these tags whose text is of a size and looks like an address: list items, sections, semantic elements."""
    rows = nodes.where(F.col("tag").isin(*tags) & F.length("text").between(least, most) & address.looks_like_address(F.col("text")))
    return rows.select("page_id", F.col("node_id").alias("seq"), F.col("text").alias("address"), F.lit(confidence).alias("confidence"))


def semantic(nodes: DataFrame) -> DataFrame:
    """Address elements and elements classed as such."""
    by_class = F.exists("classes", lambda c: F.lower(c).isin(*SEMANTIC))
    rows = nodes.where(((F.col("tag") == "address") | by_class | (attr("itemprop") == "address")) & F.length("text").between(11, 499))
    return rows.select("page_id", F.col("node_id").alias("seq"), F.col("text").alias("address"), F.lit(0.70).alias("confidence"))


def after_headings(nodes: DataFrame, reach: int = 8) -> DataFrame:
    """Siblings up to `reach` places after a heading about places, that look like an address."""
    heads = nodes.where(F.col("tag").rlike("^h[1-6]$") & contains_any(F.lower("text"), PLACE_WORDS)).select("page_id", "parent_id", F.col("sib").alias("h_sib"), F.col("text").alias("name"))
    near = heads.join(nodes, ["page_id", "parent_id"]).where((F.col("sib") > F.col("h_sib")) & (F.col("sib") <= F.col("h_sib") + reach) & address.looks_like_address(F.col("text")))
    return near.groupBy("page_id", "node_id", "text").agg(F.max_by("name", "h_sib").alias("name")).select("page_id", F.col("node_id").alias("seq"), "name", F.col("text").alias("address"), F.lit(0.80).alias("confidence"))


def cards(nodes: DataFrame, pattern: str = r"(?i)location|office|branch|store|card") -> DataFrame:
    """Elements inside a list or grid of places: their first heading (or the first part of the text) and their text, innermost only."""
    item = F.exists("classes", lambda c: c.rlike(pattern)) | (F.col("tag") == "li")
    found = nodes.where(item & F.col("tag").isin("div", "li", "article", "section") & has_components(F.col("text")) & F.length("text").between(20, 500))
    outer = inside(found, found).select("page_id", F.col("o_node").alias("node_id")).distinct()
    found = found.join(outer, ["page_id", "node_id"], "left_anti")
    heads = inside(found, nodes.where(F.col("tag").rlike("^(h[1-6]|strong|b)$"))).groupBy("page_id", F.col("o_node").alias("node_id")).agg(F.min_by("text", "node_id").alias("head"))
    rows = found.join(heads, ["page_id", "node_id"], "left")
    return rows.select("page_id", F.col("node_id").alias("seq"), F.coalesce("head", F.get(F.split("text", ","), F.lit(0))).alias("name"), F.col("text").alias("address"))


def provider(url: Column) -> Column:
    return F.coalesce(*(F.when(contains_any(F.lower(url), words), name) for name, words in MAPS))


def map_coordinates(url: Column) -> Column:
    """struct<lat, lon> from the six forms that maps' addresses have, the first that fits; else null."""
    number = r"(-?\d+\.\d+)"

    def pair(pattern: str) -> Column:
        lat, lon = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
        return F.when(url.rlike(pattern), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))

    arg = lambda n: F.regexp_extract(url, rf"[?&]{n}=([^&#]*)", 1).try_cast("double")
    both = lambda a, b: F.when(arg(a).isNotNull() & arg(b).isNotNull(), F.struct(arg(a).alias("lat"), arg(b).alias("lon")))
    center = r"[?&]center=(-?\d+(?:\.\d+)?)(?:,|%2C)(-?\d+(?:\.\d+)?)(?:[&#]|$)"
    return F.coalesce(pair(rf"@{number},\s*{number}"), pair(rf"!3d{number}!4d{number}"), pair(rf"[?&]q=[^&#]*?{number}(?:,|%2C){number}"), pair(center), both("lat", "lon"), both("lat", "lng"), both("mlat", "mlon"))


def maps(nodes: DataFrame) -> DataFrame:
    """Map frames and links that give coordinates."""
    url = F.when(F.col("tag") == "iframe", attr("src")).when(F.col("tag") == "a", attr("href"))
    rows = nodes.select("page_id", F.col("node_id").alias("seq"), url.alias("url")).where(F.col("url").isNotNull())
    rows = rows.withColumns({"provider": provider(F.col("url")), "at": map_coordinates(F.col("url"))})
    return rows.where(F.col("provider").isNotNull() & F.col("at").isNotNull()).select("page_id", "seq", "provider", F.col("at.lat").alias("latitude"), F.col("at.lon").alias("longitude"))


def data_attributes(nodes: DataFrame) -> DataFrame:
    """Places in data-lat and data-lng (or -lon), or in data-location as JSON or 'lat,lon'."""
    loc = attr("data-location")
    lat = F.coalesce(attr("data-lat"), attr("data-latitude"), F.get_json_object(loc, "$.lat"), F.regexp_extract(loc, r"^\s*(-?\d+\.?\d*)\s*,", 1))
    lon = F.coalesce(attr("data-lng"), attr("data-lon"), attr("data-longitude"), F.get_json_object(loc, "$.lng"), F.get_json_object(loc, "$.lon"), F.regexp_extract(loc, r",\s*(-?\d+\.?\d*)\s*$", 1))
    rows = nodes.select("page_id", F.col("node_id").alias("seq"), address.coordinate(lat).alias("latitude"), address.coordinate(lon).alias("longitude"))
    return rows.where("latitude IS NOT NULL AND longitude IS NOT NULL")


def inline_scripts(nodes: DataFrame) -> DataFrame:
    scripts = nodes.where((F.col("tag") == "script") & ~F.coalesce(F.lower(attr("type")), F.lit("")).contains("json"))
    return captured(assigned(scripts, "page_id", "text"), "page_id", "json")


def contacts(nodes: DataFrame) -> DataFrame:
    """page_id, kind and value: tel: and mailto: links, web origins that are no social network, social links."""
    href = attr("href")
    social = F.regexp_extract(href, r"(facebook|twitter|linkedin|instagram)\.com", 1)
    kind = F.when(href.startswith("tel:"), "phone").when(href.startswith("mailto:"), "email").when(href.startswith("http") & (social != ""), social).when(href.startswith("http"), "website")
    value = F.when(href.startswith("tel:"), F.trim(F.expr("substring(attrs['href'], 5)"))).when(href.startswith("mailto:"), F.lower(F.trim(F.get(F.split(F.expr("substring(attrs['href'], 8)"), r"\?"), F.lit(0))))).when(social != "", href).otherwise(F.regexp_extract(href, r"^(https?://[^/?#]+)", 1))
    return nodes.where(F.col("tag") == "a").select("page_id", kind.alias("kind"), value.alias("value")).where("kind IS NOT NULL AND value <> ''").distinct()


def headings(nodes: DataFrame) -> DataFrame:
    """page_id and the texts of h1 to h3, joined."""
    rows = nodes.where(F.col("tag").isin("h1", "h2", "h3")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("h"))
    return rows.select("page_id", F.array_join(F.transform("h", lambda x: x["text"]), " ").alias("headings"))


def needs_scripts(html: Column) -> Column:
    """A page drawn by scripts: a framework's marker, or hardly any text."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", ""), r"<[^<>]*>", "")
    return contains_any(html, SCRIPTED) | (F.length(F.trim(text)) < 200)


def link_table(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("tag") == "a") & attr("href").isNotNull()).select("page_id", "node_id", attr("href").alias("href"), "text")


def sections(nodes: DataFrame, classes: str = r"(?i)location|office|contact|address|branch", least: int = 50) -> DataFrame:
    """Sections and blocks classed as places whose text has an address; the innermost of those that nest."""
    found = nodes.where((F.exists("classes", lambda c: c.rlike(classes)) | F.coalesce(F.col("elem_id").rlike(classes), F.lit(False))) & F.col("tag").isin("section", "div", "article", "footer"))
    found = found.where((F.length("text") >= least) & has_components(F.col("text")))
    outer = inside(found, found).select("page_id", F.col("o_node").alias("node_id")).distinct()
    return found.join(outer, ["page_id", "node_id"], "left_anti").select("page_id", F.col("node_id").alias("seq"), F.col("text").alias("address"))


def metadata(nodes: DataFrame) -> DataFrame:
    """page_id, name and content of meta elements."""
    name = F.coalesce(attr("name"), attr("property"))
    return nodes.where((F.col("tag") == "meta") & name.isNotNull() & attr("content").isNotNull()).select("page_id", name.alias("name"), attr("content").alias("content"))
