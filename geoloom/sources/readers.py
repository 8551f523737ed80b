"""Where pages and locations come from, without a network: tables, lists of addresses, files about sites, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import urls
from geoloom.functions.text import filled, first_filled

#: Where sites answer with their places, and where sitemaps are.
ENDPOINTS = (
    "/api/locations", "/api/locations.json", "/api/stores", "/api/stores.json", "/api/offices", "/api/offices.json", "/api/branches",
    "/locations.json", "/stores.json", "/offices.json", "/data/locations.json", "/data/stores.json",
    "/wp-json/wp/v2/locations", "/wp-json/store-locator/v1/stores", "/locations-sitemap.xml", "/graphql", "/api/graphql",
    "/store-locator/data", "/store-locator/locations.json", "/storelocator/data.json",
)
PROBES = ("/api/locations", "/api/stores", "/api/offices")
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
ACTIVITIES, SHARES = ("Headquarters", "Office", "Warehouse", "Retail"), ("Own", "Lease", "Joint Venture")


def from_text(rows: DataFrame, text: str = "x") -> DataFrame:
    """Addresses in text, parted by commas, semicolons or new lines; https:// is supplied."""
    parts = F.filter(F.transform(F.split(text, r"[\n,;]+"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    full = F.transform(parts, lambda p: F.when(p.rlike("^https?://"), p).otherwise(F.concat(F.lit("https://"), p)))
    return rows.select("id", F.posexplode(full).alias("seq", "url"))


def from_csv(rows: DataFrame) -> DataFrame:
    """company and url of rows read with a header, by the names the columns may have; rows without an address go."""
    named = lambda *names: [F.col(f"`{n}`") for n in names if n in rows.columns]
    company, url = named("Company Name", "company", "name"), named("URL", "url", "Website", "website")
    out = rows.select(first_filled(*company, default="Unknown").alias("company"), F.trim(F.coalesce(*(filled(c) for c in url))).alias("url"))
    return out.where("url IS NOT NULL")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return from_csv(spark.read.option("header", True).csv(path))


def route(url: Column) -> Column:
    return F.when(urls.is_pdf(url), "pdf").when(F.lower(url).rlike(r"\.json($|\?)|/api/"), "api").otherwise("page")


def endpoints(pages: DataFrame) -> DataFrame:
    """Where each site may answer with its places, once for a site."""
    site = pages.select(urls.origin(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    return site.select("origin", F.posexplode(F.array(*(F.concat("origin", F.lit(p)) for p in ENDPOINTS))).alias("seq", "endpoint"))


def available(sites: DataFrame, responses: DataFrame) -> DataFrame:
    """Sites with an answer of status 200 at one of the probed paths."""
    ok = responses.where("status = 200").select(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), urls.path(F.col("url")).alias("path")).where(F.col("path").isin(*PROBES))
    return sites.join(ok, "origin", "left_semi")


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """url of every location in sitemaps (site, seq, body) that isn't excluded; of a site's files the first that has any."""
    found = maps.withColumn("locs", F.regexp_extract_all("body", F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))).where(F.size("locs") > 0)
    first = found.groupBy("site").agg(F.min_by("locs", "seq").alias("locs"))
    return first.select("site", F.explode("locs").alias("url")).where(~urls.excluded(F.col("url"))).distinct()


def robots_rules(files: DataFrame) -> DataFrame:
    """host, kind (allow, disallow, delay, sitemap) and value from robots files (host, body), of the groups for all agents."""
    lines = files.select("host", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    lines = lines.select("host", "pos", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("line", r":\s*(.*)$", 1), r"\s*#.*$", "")).alias("value")).where("key <> ''")
    from pyspark.sql import Window

    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("host").orderBy("pos"))
    kind = F.when(F.col("key") == "crawl-delay", "delay").otherwise(F.col("key"))
    return lines.withColumn("agent", agent).where("key IN ('sitemap') OR (agent = '*' AND key IN ('allow', 'disallow', 'crawl-delay') AND value <> '')").select("host", kind.alias("kind"), "value")


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url) with allowed: by the longest rule that begins the path, allow before disallow; hosts without rules allow all."""
    paths = rules.where("kind IN ('allow', 'disallow')")
    rows = pages.withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    hit = rows.join(paths, "host").where(F.col("path").startswith(F.col("value")))
    best = hit.groupBy("url").agg(F.max(F.struct(F.length("value").alias("n"), (F.col("kind") == "allow").alias("ok"))).alias("b"))
    return pages.join(best, "url", "left").select(*pages.columns, F.coalesce("b.ok", F.lit(True)).alias("allowed"))


def demo(rows: DataFrame) -> DataFrame:
    """A made-up location for each url, all of it from its number; a source of its own, never a substitute for a failure."""
    i = F.col("i")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    digits = (100 + i).cast("string")
    return rows.select("i", F.concat(F.lit("Location "), (i + 1).cast("string"), F.lit(" from "), urls.host(F.col("url"))).alias("location_name"), F.concat(digits, F.lit(" Business St, Suite "), digits, F.lit(", New York, NY 1000"), i.cast("string")).alias("location_address"), pick(ACTIVITIES, 4).alias("activity"), F.round(40.7128 + i * 0.01, 6).alias("latitude"), F.round(-74.0060 + i * 0.01, 6).alias("longitude"), pick(SHARES, 3).alias("usage_share"), F.col("url").alias("source_url"))


def uncached(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (key) that no cache entry (key, expires_at) answers any more."""
    return requests.join(cache.where(F.col("expires_at") > now), "key", "left_anti")


def memoised(requests: DataFrame, cache: DataFrame, compute, now: Column, ttl: float = 3600, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Answers (key, value) of requests (key), from a cache (key, value, stored_at in seconds) where it has one of the last `ttl`
    seconds and else by compute(misses); and the cache after that: entries still valid and new ones, the last `most` that came in."""
    valid = cache.where(F.col("stored_at") > now - ttl)
    asked = requests.select("key").distinct()
    new = compute(asked.join(valid.select("key"), "key", "left_anti")).select("key", "value")
    answers = asked.join(valid.select("key", "value"), "key").unionByName(new)
    both = valid.select("key", "value", "stored_at").unionByName(new.withColumn("stored_at", now.cast("double")))
    return answers, both.orderBy(F.col("stored_at").desc(), F.col("key").desc()).limit(most)


def sample(spark: SparkSession, n: int = 25) -> DataFrame:
    """A small table of made-up locations with the columns of a report, for trials without pages."""
    i = F.col("id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    number = (100 + i * 7).cast("string")
    return spark.range(1, n + 1).select(
        "id", F.concat(pick("North", "South", "Harbour", "Central", "Park"), F.lit(" "), pick("Office", "Depot", "Lab"), F.lit(" "), i.cast("string")).alias("location_name"),
        F.concat(number, F.lit(" "), pick("Mill", "Canal", "Orchard"), F.lit(" Road")).alias("location_address"), pick("Office", "Warehouse", "Laboratory").alias("activity"),
        F.round(-60 + i * 4.75, 4).alias("latitude"), F.round(-170 + i * 13.25, 4).alias("longitude"), pick("USA", "GBR", "DEU", "IND").alias("country_iso3"), (10000 + i * 37).cast("string").alias("postcode"),
        pick("TX", "England", "Bayern", "Goa").alias("state"), pick("Austin", "Leeds", "Ulm", "Panaji").alias("street_or_city"), (i * 250).cast("string").alias("footprint"), F.when(i % 2 == 0, 30).alias("height"),
        pick("Exclusive", "Shared").alias("usage_share"), F.concat(F.lit("https://sample.test/"), i.cast("string")).alias("source_url"),
    )


def rejected(requests: DataFrame) -> DataFrame:
    """id and reason of crawl requests (id, url, urls, max_pages, max_depth) that break a rule; null where none."""
    n = F.size("urls")
    bad = F.when(F.col("url").isNull() & F.col("urls").isNull(), "no url").when(F.col("url").isNotNull() & F.col("urls").isNotNull(), "url and urls")
    bad = bad.when(F.col("urls").isNotNull() & ~n.between(1, 10), "1 to 10 urls").when(F.col("url").isNotNull() & ~F.coalesce(F.col("url"), F.lit("")).rlike(r"^[a-z][a-z0-9+.-]*:\S+$"), "not an address")
    bad = bad.when(~F.col("max_pages").between(1, 200), "max_pages").when(~F.col("max_depth").between(1, 10), "max_depth")
    return requests.select("id", bad.alias("reason"))


def rejected_uploads(files: DataFrame, most: int = 10 << 20) -> DataFrame:
    """id and reason of uploads (id, name, mime, bytes) that are no CSV file or too large; null where neither."""
    csv = F.coalesce(F.col("mime").isin("text/csv", "application/vnd.ms-excel"), F.lit(False)) | F.coalesce(F.lower("name").endswith(".csv"), F.lit(False))
    return files.select("id", F.when(~csv, "not a CSV file").when(F.col("bytes") > most, "too large").alias("reason"))
