"""Kafka topics, replay of trace files, stepped rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow import schemas

# Topic names of the workloads.
TOPICS = {"person": "nexmark-person", "auction": "nexmark-auction", "bid": "nexmark-bid", "closed_auction": "nexmark-closed-auction", "twitch": "twitch", "taxi": "taxi-trip", "borg": "borg-task", "azure": "azure"}


def kafka_options(servers: str, topic: str, per_trigger: int | None = None) -> dict[str, str]:
    """Reads from the earliest offset, at most 10 MB of a partition at once."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "kafka.max.partition.fetch.bytes": str(10 << 20), "failOnDataLoss": "false"}
    return options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def has_kafka(spark: SparkSession) -> bool:
    """Whether the Kafka connector is on the class path."""
    try:
        return spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider") is not None
    except Exception:  # noqa: BLE001  Py4J wraps the class loader's error
        return False


def encoded(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as records: value (JSON) and, if asked for, key (text)."""
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def decoded(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records (value, and timestamp where there is one) as rows, with the record's queueing time in queue_ms."""
    queued = [(F.unix_millis(F.current_timestamp()) - F.unix_millis("timestamp")).alias("queue_ms")] if "timestamp" in records.columns else []
    return records.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), *queued).select("r.*", *[c for c in ("queue_ms",) if queued])


def from_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Rows of a JSON topic, with the record's queueing time in queue_ms."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic, per_trigger)).load()
    return decoded(raw, schema)


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    return encoded(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def azure_readings(spark: SparkSession, path: str) -> DataFrame:
    """A row that can't be read ends the job."""
    return spark.read.schema(schemas.AZURE_EVENT).option("mode", "FAILFAST").csv(path)


def borg_tasks(spark: SparkSession, path: str) -> DataFrame:
    """No header; blank whole numbers are -1, blank fractions 0, a blank constraint false."""
    df = spark.read.schema(schemas.TASK_EVENT).csv(path)
    blank = {T.LongType(): -1, T.DoubleType(): 0.0, T.BooleanType(): False, T.StringType(): ""}
    return df.select(*[F.coalesce(f.name, F.lit(blank[f.dataType])).alias(f.name) for f in schemas.TASK_EVENT.fields])


def taxi_trips(spark: SparkSession, path: str) -> DataFrame:
    """With header; malformed rows are dropped; times are nanoseconds since 2013-01-01."""
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name.endswith("_datetime") else f.dataType) for f in schemas.TAXI_TRIP.fields])
    df = spark.read.schema(text).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    since = F.lit("2013-01-01 00:00:00").cast("timestamp_ntz")
    nanos = lambda c: (F.timestamp_diff("MICROSECOND", since, F.col(c).cast("timestamp_ntz")) * 1000).alias(c)
    return df.select(*[nanos(f.name) if f.name.endswith("_datetime") else f.name for f in schemas.TAXI_TRIP.fields])


def twitch_events(spark: SparkSession, path: str) -> DataFrame:
    """With header; rows without a valid event time are skipped."""
    return spark.read.schema(schemas.TWITCH_EVENT).option("header", True).option("mode", "DROPMALFORMED").csv(path).filter("event_time is not null")


def looped(df: DataFrame, ts: str, times: int) -> DataFrame:
    """The trace again and again, each pass later by the trace's span plus one."""
    span = df.agg((F.max(ts) - F.min(ts) + 1).alias("span"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("pass_")
    return df.crossJoin(F.broadcast(span)).select("*", passes).withColumn(ts, F.col(ts) + F.col("pass_") * F.col("span")).drop("pass_", "span")  # one row


def stepped(n: str, steps: list[tuple[int, int]], interval_ms: int = 200):
    """Emission time (ms) of event number n when `per_tick` events go out each interval for `ticks`
    intervals, step after step, the last step for ever."""
    at, first, out = 0, 0, None
    clauses = []
    for per_tick, ticks in steps:
        clauses.append((first + per_tick * ticks, at + F.floor((F.col(n) - first) / per_tick) * interval_ms))
        first, at = first + per_tick * ticks, at + ticks * interval_ms
    for i, (end, value) in enumerate(clauses[:-1]):
        out = F.when(F.col(n) < end, value) if i == 0 else out.when(F.col(n) < end, value)
    return clauses[-1][1] if out is None else out.otherwise(clauses[-1][1])
