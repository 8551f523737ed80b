"""Inputs of the queries: locations derived from the tables, and small tables of rows in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Valid in Spark and in DuckDB; the names in braces are tables.
LOCATIONS = """
SELECT CAST(c.c_custkey AS BIGINT) AS id,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL WHEN c.c_custkey % 7 = 0 THEN 'Head Office hq ' || c.c_name WHEN c.c_custkey % 5 = 0 THEN c.c_name || ' Store' WHEN c.c_custkey % 3 = 0 THEN 'Regional ' || c.c_name ELSE c.c_name END AS location_name,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 17 = 0 THEN 'n/a' WHEN c.c_custkey % 19 = 0 THEN '12 Oak' ELSE CAST(c.c_custkey % 900 + 1 AS STRING) || ' ' || c.c_mktsegment || CASE WHEN c.c_custkey % 2 = 0 THEN ' Street' ELSE ' Avenue' END END AS location_address,
  CASE c.c_custkey % 6 WHEN 0 THEN 'Office' WHEN 1 THEN 'Warehouse' WHEN 2 THEN 'Manufacturing' WHEN 3 THEN 'Data Center' WHEN 4 THEN 'Laboratory' ELSE NULL END AS activity,
  CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE CAST((c.c_custkey * 7919) % 18000 AS DOUBLE) / 100 - 90 END AS latitude,
  CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE CAST((c.c_custkey * 104729) % 36000 AS DOUBLE) / 100 - 180 END AS longitude,
  CASE WHEN c.c_custkey % 31 = 0 THEN '' ELSE substr(n.n_name, 1, 3) END AS country_iso3,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE CAST(10000 + c.c_custkey % 90000 AS STRING) END AS postcode,
  n.n_name AS state,
  CASE WHEN c.c_custkey % 9 = 0 THEN '' ELSE r.r_name END AS street_or_city,
  CAST(NULL AS STRING) AS footprint,
  CASE WHEN c.c_custkey % 2 = 0 THEN 30 ELSE NULL END AS height,
  CASE WHEN c.c_custkey % 8 = 0 THEN '555' || CAST(1000000 + c.c_custkey AS STRING) ELSE NULL END AS phone,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'info' || CAST(c.c_custkey AS STRING) || '@corp.test' ELSE NULL END AS email,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Shared' ELSE 'Exclusive' END AS usage_share,
  'https://' || lower(r.r_name) || '.test/loc/' || CAST(c.c_custkey % 97 AS STRING) AS source_url,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'Public Registry' ELSE 'Company Website' END AS source_type,
  CASE c.c_custkey % 7 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 WHEN 4 THEN 0.7 WHEN 5 THEN 0.6 ELSE NULL END AS confidence,
  CASE c.c_custkey % 5 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'map-iframe' WHEN 3 THEN 'custom' ELSE NULL END AS method,
  r.r_name AS region
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""
LOC = LOCATIONS.format(customer="customer", nation="nation", region="region")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOCATIONS, **{n: read(spark, sf_dir, n) for n in ("customer", "nation", "region")}).withColumn("confidence", _double("confidence"))


def _double(name: str):
    from pyspark.sql import functions as F

    return F.col(name).cast("double")


class Rows:
    """A small table that is the same in both dialects. schema: 'name type, ...' with types string, bigint, double, boolean."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.fields = [f.split() for f in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        values = ", ".join("(" + ", ".join(map(quoted, r if isinstance(r, tuple) else (r,))) + ")" for r in self.rows)
        types = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
        casts = ", ".join(f"CAST({n} AS {types[t]}) AS {n}" for n, t in self.fields)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in self.fields)}))"
