"""Pages as tables of nodes: one walk over the tag soup, then everything is filters and joins over intervals.

node_id counts elements in the order they open, end_id is the last one inside, so what an element contains is
a range. Only end tags that authors leave out are supplied: of p, li, dt, dd, tr, td, th, option.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends, if it stands open above it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= dict.fromkeys("p div ul ol h1 h2 h3 h4 h5 h6 table article section header footer nav aside blockquote pre form address main".split(), {"p"})
BARRIERS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}
RAW = ("script", "style")

SCHEMA = "page_id long, node_id int, parent_id int, end_id int, depth int, sib int, tag string, elem_id string, classes array<string>, attrs map<string,string>, own_text string, text string"


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ())
        walls = BARRIERS.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[i]]["tag"]
            if name in ends:
                self._close(i)
                if tag == "tr" and name != "tr":  # the cell's row ends with it
                    continue
                break
            if name in walls or name not in ("b", "i", "em", "strong", "span", "a", "u"):
                break
        values = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        sib = 0
        if parent >= 0:
            sib = self.nodes[parent]["children"]
            self.nodes[parent]["children"] += 1
        self.nodes.append({"tag": tag, "attrs": values, "parent": parent, "depth": len(self.open), "sib": sib, "children": 0, "own": [], "all": [], "end": len(self.nodes)})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        if not self.open:
            return
        self.nodes[self.open[-1]]["own"].append(data)
        raw = self.nodes[self.open[-1]]["tag"] in RAW
        for i in self.open[-1:] if raw else self.open:
            self.nodes[i]["all"].append(data)

    def _close(self, at: int) -> None:
        for i in self.open[at:]:
            self.nodes[i]["end"] = len(self.nodes) - 1
        del self.open[at:]


def walk(page: str) -> list[dict]:
    w = _Walk()
    w.feed(page or "")
    w.close()
    w._close(0)
    return w.nodes


def nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """The node table of pages (page_id, html); a null or empty page has no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("page_id", pa.int64()), *[(n, pa.int32()) for n in ("node_id", "parent_id", "end_id", "depth", "sib")], ("tag", pa.string()), ("elem_id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string())])
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = []
                for page_id, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, n in enumerate(walk(page)):
                        a = n["attrs"]
                        rows.append((page_id, i, n["parent"], n["end"], n["depth"], n["sib"], n["tag"], a.get("id"), a.get("class", "").split(), list(a.items()), " ".join("".join(n["own"]).split()), " ".join("".join(n["all"]).split()) if n["tag"] not in RAW else "".join(n["all"])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(run, SCHEMA)


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, node_id, href, text and target (the absolute address, null if there is none) of the links of pages (page_id, url, html): one walk a page."""

    def resolved(base: str | None, link: str) -> str | None:
        try:
            return None if base is None else urljoin(base, link)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, n in enumerate(walk(page)):
                    if n["tag"] == "a" and (href := n["attrs"].get("href")) is not None:
                        rows.append((page_id, url, i, href, " ".join("".join(n["all"]).split()), resolved(url, href)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "url", "node_id", "href", "text", "target"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, node_id int, href string, text string, target string")


def attr(name: str) -> Column:
    return F.element_at("attrs", name)


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of an outer node (columns o_...) and a node inside it."""
    o = outer.select("page_id", F.col("node_id").alias("o_node"), F.col("end_id").alias("o_end"), F.col("text").alias("o_text"), F.col("attrs").alias("o_attrs"))
    return o.join(inner, "page_id").where((F.col("node_id") > F.col("o_node")) & (F.col("node_id") <= F.col("o_end")))
