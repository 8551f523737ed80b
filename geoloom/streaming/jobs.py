"""Progress of jobs and limits of requests, over streams and over tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = {"signup": "initializing", "view": "crawling", "click": "processing", "purchase": "completed", "error": "failed"}


def job_events(events: DataFrame) -> DataFrame:
    """Events as progress reports: user as job, type as status."""
    table = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.element_at(table, F.col("event_type")).alias("status"))


def progress(reports: DataFrame) -> DataFrame:
    """The state of each job: latest status, reports, pages (crawling or later), failures, first and last time."""
    at = F.struct("ts", "event_id")
    return reports.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.count(F.lit(1)).alias("reports"), F.count_if(F.col("status").isin("crawling", "processing")).alias("pages"), F.count_if(F.col("status") == "failed").alias("errors"), F.min("ts").alias("started"), F.max("ts").alias("seen"))


def percent(done, total):
    """Whole percents, 0 without a total. Multiplied first: 23 / 40 * 100 is below 57.5."""
    return F.when(total > 0, F.round(done * 100 / total)).otherwise(0).cast("int")


def alive(states: DataFrame, now, hours: int = 1) -> DataFrame:
    """Jobs that haven't ended, or ended within some hours."""
    ended = F.col("status").isin("completed", "failed")
    return states.where(~ended | (F.col("seen") > now - F.expr(f"INTERVAL {hours} HOUR")))


def windows(requests: DataFrame, client: str, seconds: int, limit: int) -> DataFrame:
    """client, window start, requests and those over the limit, by tumbling windows."""
    w = F.window("ts", f"{seconds} seconds")
    n = F.count(F.lit(1))
    return requests.groupBy(client, w.alias("w")).agg(n.alias("n"), F.greatest(F.lit(0).cast("long"), n - limit).alias("refused")).select(client, F.col("w.start").alias("start"), "n", "refused")


def stream_windows(stream: DataFrame, client: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    return windows(stream.withWatermark("ts", late), client, seconds, limit)


def batches(rows: DataFrame, size: int, key: str = "id") -> DataFrame:
    """rows with a batch number, `size` rows of consecutive keys (from 0) in each."""
    return rows.withColumn("batch", F.floor(F.col(key) / size).cast("bigint"))


def sink(stream: DataFrame, name: str):
    """A started query that keeps the latest state in a table in memory."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).start()
