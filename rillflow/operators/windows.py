"""Event-time windows: tumbling, and sliding by panes.

Windows begin at multiples of their length (slide) since the epoch, end exclusively, and a result's event
time is the window's end. The same frames work on streams with a watermark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, keys: list[str], duration: str, aggs: Mapping[str, Column]) -> DataFrame:
    """window_start, window_end, keys and one column per aggregate."""
    grouped = df.groupBy(F.window(ts, duration).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def sliding(df: DataFrame, ts: str, keys: list[str], panes: int, slide: str, partial: Mapping[str, Column], merged: Mapping[str, Column]) -> DataFrame:
    """Windows of `panes` slides each.

    Rows are aggregated once per pane (a tumbling window of one slide) and only panes are copied into the
    windows that hold them, so the shuffle carries rows per key and pane however long the windows are.
    `merged` combines the columns of `partial`.
    """
    if panes < 1:
        raise ValueError("a window holds one slide at least")
    paned = df.groupBy(F.window(ts, slide).alias("p"), *keys).agg(*[a.alias(n) for n, a in partial.items()])
    step = F.expr(f"INTERVAL '{slide}'") if not slide.upper().startswith("INTERVAL") else F.expr(slide)
    first = F.col("p.start")
    starts = F.explode(F.array(*[first - step * k if k else first for k in range(panes)]))
    placed = paned.select(starts.alias("window_start"), *keys, *partial)
    out = placed.groupBy("window_start", *keys).agg(*[a.alias(n) for n, a in merged.items()])
    return out.withColumn("window_end", F.col("window_start") + step * panes).select("window_start", "window_end", *keys, *merged)


def sliding_stream(df: DataFrame, ts: str, keys: list[str], duration: str, slide: str, aggs: Mapping[str, Column]) -> DataFrame:
    """The streaming form: one aggregation per window, state kept until the watermark passes its end."""
    grouped = df.groupBy(F.window(ts, duration, slide).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def best_per_window(df: DataFrame, window: str, order: list[str]) -> DataFrame:
    """The row of each window that is largest by `order`, in that order: partial maxima, no sort."""
    rest = [c for c in df.columns if c not in order and c != window]
    best = F.max(F.struct(*order, *rest)).alias("b")
    return df.groupBy(window).agg(best).select(window, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts to k before the shuffle as well."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
