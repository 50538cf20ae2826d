"""Two-input operators: incremental equi-joins, event-time bounded joins, ledgers and period sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateless import merge


def incremental(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """All matches of all history, whichever side came first; on streams bound the state by watermarks."""
    return left.join(right, on, "inner")


def best_until(left: DataFrame, left_key: str, until: str, right: DataFrame, right_key: str, ts: str, best: Column, name: str) -> DataFrame:
    """For each left row the best of the right rows of its key up to a time of its own, if there is one.

    The right side is cut to the keys' rows by the join; the aggregate runs partially before any shuffle
    that follows.
    """
    joined = left.join(right, (F.col(left_key) == F.col(right_key)) & (F.col(ts) <= F.col(until)))
    return joined.groupBy(*[F.col(c) for c in left.columns]).agg(best.alias(name))


def followed_within(left: DataFrame, left_key: str, left_ts: str, right: DataFrame, right_key: str, right_ts: str, period: str) -> DataFrame:
    """Left rows that some right row of their key follows within the period, both ends included; each once."""
    inside = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL '{period}'"))
    return left.join(right, (F.col(left_key) == F.col(right_key)) & inside, "left_semi")


def ledger(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: what the first stream adds and the second takes, and the reverse."""
    signed = merge(first.select(key, F.col(value).alias("v")), second.select(key, (-F.col(value)).alias("v")))
    return signed.groupBy(key).agg(F.sum("v").alias("state1"), F.sum(-F.col("v")).alias("state2"))


def period_sums(first: DataFrame, second: DataFrame, key: str, ts: str, value: str, period: str) -> DataFrame:
    """Per key and period the sums of both streams: one shuffle for both, no join."""
    both = merge(
        first.select(key, ts, F.col(value).alias("a"), F.lit(0).cast("long").alias("b")),
        second.select(key, ts, F.lit(0).cast("long").alias("a"), F.col(value).alias("b")),
    )
    out = both.groupBy(F.window(ts, period).alias("w"), key).agg(F.sum("a").alias("sum1"), F.sum("b").alias("sum2"))
    return out.select(F.col("w.end").alias("period_end"), key, "sum1", "sum2")
