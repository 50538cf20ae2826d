"""The parquet tables of a folder as domain streams; only the columns a query names are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """auction, bidder, price (cents), ts, bid_id, extra, from events."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("auction"), (F.col("event_id") % 97).alias("bidder"), F.round(F.col("value") * 100).cast("long").alias("price"),
        "ts", F.col("event_id").alias("bid_id"), F.col("props").alias("extra"),
    )


def order_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """auction, price (cents), bid_ts, from lineitem."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("auction"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_shipdate").alias("bid_ts"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seller, category, ts, expires (a year later), from orders."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.col("o_orderpriority").alias("category"),
        F.col("o_orderdate").alias("ts"), (F.col("o_orderdate") + F.expr("INTERVAL '365' DAY")).alias("expires"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, city (nation key as text), state (market segment), from customer."""
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("city"), F.col("c_mktsegment").alias("state")
    )


def closed_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seller, final_price, category, ts, a closed-auction source: one row per order with its price."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.round(F.col("o_totalprice") * 100).cast("long").alias("final_price"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderdate").alias("ts"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taxi trips from lineitem: coordinates on and around the grid by exact arithmetic on the keys."""
    x = lambda c, n: (F.col(c) % n).cast("double")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip_order"), F.col("l_linenumber").alias("trip_line"), F.col("l_returnflag").alias("vendor"),
        F.col("l_shipdate").alias("dropoff_ts"), (F.col("l_quantity").cast("long") * 60).alias("trip_time_secs"), (F.col("l_linenumber") % 6 + 1).cast("long").alias("passenger_count"),
        (F.lit(-74.95) + x("l_suppkey", 10) * 0.2).alias("pickup_longitude"), (F.lit(41.45) - x("l_partkey", 5) * 0.3).alias("pickup_latitude"),
        (F.lit(-74.95) + x("l_partkey", 7) * 0.2).alias("dropoff_longitude"), (F.lit(41.45) - x("l_suppkey", 3) * 0.3).alias("dropoff_latitude"),
    )


def viewer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """streamer_id, streamer_name, ts, event_id, entered, secs (event time in seconds), from events."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("streamer_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("streamer_name"), "ts", "event_id",
        F.col("event_type").isin("signup", "click", "view").alias("entered"), _seconds("ts").alias("secs"),
    )


def cpu_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vm_id, ts, event_id, min_cpu, max_cpu, avg_cpu, from events."""
    v = F.col("value")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("vm_id"), "ts", "event_id", (v / 2).alias("min_cpu"), v.alias("max_cpu"), (v * 0.75).alias("avg_cpu"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, task_index, event_type, ts, event_id, cpu, ram, disk, from events."""
    v = F.col("value")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 4).alias("task_index"), "event_type", "ts", "event_id", v.alias("cpu"), (v * 2).alias("ram"), (v / 4).alias("disk")
    )


def _seconds(ts: str):
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")
