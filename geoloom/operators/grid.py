"""Verbs of the table view: filters, sorts, pages, facets, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import filled, present

#: Columns of the table in order, and those hidden at first.
COLUMNS = ("location_name", "location_address", "activity", "latitude", "longitude", "country_iso3", "postcode", "state", "street_or_city", "footprint", "height", "usage_share", "source_url", "source_type")
HIDDEN = ("footprint", "height", "usage_share", "source_type")


def visible(rows: DataFrame, hidden=HIDDEN, order=COLUMNS) -> DataFrame:
    return rows.select(*(c for c in order if c not in hidden))


def contains(filters: dict[str, str], missing_as_empty: bool = True) -> Column:
    """All of the columns hold their text, whatever the case; an empty text asks for nothing."""
    terms = []
    for name, wanted in filters.items():
        if wanted:
            c = F.col(name).cast("string")
            terms.append(F.lower(F.coalesce(c, F.lit("")) if missing_as_empty else c).contains(wanted.lower()))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def in_range(column: str, wanted: str) -> Column:
    """'70-89': both included; '90': at least."""
    low, _, high = wanted.partition("-")
    c = F.col(column)
    return c.between(float(low), float(high)) if high else c >= float(low)


def confident(least: float, column: str = "confidence") -> Column:
    return F.coalesce(F.col(column), F.lit(0.0)) >= least


def valid() -> Column:
    """A place, or a name with an address or city, or an address with a city."""
    has = lambda n: present(F.col(n))
    return (has("latitude") & has("longitude")) | (has("location_name") & (has("location_address") | has("street_or_city"))) | (has("location_address") & has("street_or_city"))


def ordered(rows: DataFrame, column: str, descending: bool = False, nulls_last: bool = True, tie: str = "id") -> DataFrame:
    """Sorted by a column, ties by another; nulls last either way, or (nulls_last=False) as a reversed ascending sort has them."""
    c = F.col(column)
    key = (c.desc_nulls_last() if nulls_last else c.desc_nulls_first()) if descending else c.asc_nulls_last()
    return rows.orderBy(key, F.col(tie))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of sorted rows."""
    return rows.offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("pages"))


def facet(rows: DataFrame, column: str, without=()) -> DataFrame:
    value = filled(F.col(column))
    return rows.select(value.alias("value")).where(value.isNotNull() & ~value.isin(*without) if without else value.isNotNull()).distinct().orderBy("value")


def csv_rows(rows: DataFrame, columns, dialect: str = "plain") -> DataFrame:
    """id and line: values quoted, quotes doubled; 'plain' writes 0 and empty values as '', 'strict' only null."""

    def text(n: str) -> Column:
        c = F.col(n).cast("string")
        value = F.when(present(F.col(n)), c).otherwise("") if dialect == "plain" else F.coalesce(c, F.lit(""))
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    return rows.select("id", F.concat_ws(",", *(text(n) for n in columns)).alias("line"))


def write_csv(rows: DataFrame, path: str, columns, dialect: str = "plain") -> None:
    """A header and the lines of csv_rows, as text files."""
    csv_rows(rows, columns, dialect).select(F.col("line").alias("value")).write.text(path, lineSep="\n" if dialect == "plain" else "\r\n")
