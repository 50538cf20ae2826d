"""Terminal operators of streams, and bounded replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def each_row(df: DataFrame, fn: Callable, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """fn(row) on the executors for every result row."""
    return df.writeStream.foreach(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """fn(frame, batch id): make it idempotent by the batch id for exactly-once results."""
    return df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    return df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def nothing(df: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the query and drops its result, to measure it."""
    return df.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def replayed(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a bounded stream to its end and gives the rows it emitted (for tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
