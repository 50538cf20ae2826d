"""Catalogue jobs as streams over a folder's tables, by the names that users deploy them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.plans import traces
from rillflow.sources import tables as S

from . import processors, queries


class Streamed:
    """A session whose tables are streams: what sources.tables makes of them is a stream too."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.options, self.read = spark, options, self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        return queries.table(self.spark, folder, name.removesuffix(".parquet"), **self.options)


def _timed(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return queries.timestamped(df, "ts", delay, "timestamp")


def _closed(s, d: str) -> DataFrame:
    return S.closed_auctions(s, d).withColumn("closed_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _routes(s, d: str) -> DataFrame:
    return traces.routed(S.trips(s, d)).withColumn("route", F.concat_ws("/", F.col("route_id").cast("string"), "vendor"))


def _tasks(s, d: str) -> DataFrame:
    return S.task_events(s, d).withColumn("task", F.concat_ws("/", F.col("job_id").cast("string"), F.col("task_index").cast("string")))


JOBS: dict[str, Callable[[Streamed, str], DataFrame]] = {
    "nexmark_query1": lambda s, d: queries.currency(S.bids(s, d)),
    "nexmark_query2": lambda s, d: queries.selection(S.bids(s, d)),
    "nexmark_query4_modified": lambda s, d: queries.category_average(_closed(s, d)),
    "nexmark_query5": lambda s, d: queries.hot_items(_timed(S.bids(s, d)), "12 hours", "4 hours"),
    "nexmark_query6_modified": lambda s, d: queries.seller_average(_closed(s, d)),
    "nexmark_query7": lambda s, d: queries.highest_bid(_timed(S.bids(s, d)), "6 hours"),
    "taxi": lambda s, d: queries.route_median(_routes(s, d)),
    "azure": lambda s, d: queries.recent_medians(S.cpu_readings(s, d), "vm_id", ["min_cpu", "max_cpu", "avg_cpu"], 8),
    "borg": lambda s, d: queries.recent_medians(_tasks(s, d), "task", ["cpu", "ram", "disk"], 10),
    "twitch": lambda s, d: queries.trend(queries.loyalty(queries.retention(S.viewer_events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))))),
}


def build(spark: SparkSession, name: str, folder: str, **options: str) -> DataFrame:
    """The streaming frame of a job over a folder's tables."""
    if name not in JOBS:
        raise KeyError(f"no job is named {name}; there are {sorted(JOBS)}")
    processors.enable(spark)
    return JOBS[name](Streamed(spark, **options), folder)
