"""Links between pages: discovery, order, and a bounded breadth-first walk."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from geoloom.functions import urls
from geoloom.operators.scratch import cut


@F.pandas_udf(StringType())
def resolve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The absolute address of a link on a page; null if it can't be resolved."""

    def one(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    for base, link in batches:
        yield pd.Series([None if b is None or x is None else one(b, x) for b, x in zip(base, link, strict=True)])


def _targets(links: DataFrame) -> DataFrame:
    """links with target, unless the walk over the pages has given it."""
    return links if "target" in links.columns else links.withColumn("target", resolve("url", "href"))


def internal(links: DataFrame) -> DataFrame:
    """page_id and link: distinct links (url, href) to the page's own site, without query and fragment, not excluded."""
    rows = _targets(links).where(F.col("target").rlike("^https?://"))
    rows = rows.where(urls.same_site(urls.host(F.col("target")), urls.host(F.col("url")))).withColumn("link", urls.clean(F.col("target")))
    return rows.where(~urls.excluded(F.col("link"))).select("page_id", "link").distinct()


def candidates(pages: DataFrame, links: DataFrame, limit: int = 5) -> DataFrame:
    """page_id, rank and link: guessed paths, then links about places on the same host, by priority and order, the first `limit`."""
    guessed = pages.select("page_id", F.posexplode(F.array(*(F.concat(urls.origin(F.col("url")), F.lit(p)) for p in urls.SEEDS))).alias("seq", "link"))
    found = _targets(links.where(urls.is_location_link(F.col("href"), F.col("text")))).withColumn("link", F.col("target"))
    found = found.where(urls.host(F.col("link")) == urls.host(F.col("url"))).select("page_id", (F.col("node_id") + len(urls.SEEDS)).cast("int").alias("seq"), "link")
    both = guessed.unionByName(found).groupBy("page_id", "link").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(urls.link_priority(F.col("link")), "seq"))
    return both.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "rank", "link")


def walk(links: DataFrame, starts: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """url and depth of what can be reached from starts (url) by links (src, dst) within a depth.

    Each round joins the frontier with the links and takes what is new; most bounds the pages of a walk,
    nearest first and then by address.
    """
    frontier = cut(starts.select("url", F.lit(0).alias("depth")).distinct(), "frontier")
    seen = frontier
    for d in range(1, depth + 1):
        new = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = cut(new.join(seen, "url", "left_anti").select("url", F.lit(d).alias("depth")), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)  # each round's table is written once
    return seen if most is None else seen.orderBy("depth", "url").limit(most)
