"""Keyed state as window frames: running aggregates, last values, last-N statistics, changes, folds.

State of a key evolves in the order of (event time, unique id). Frames over a key sort that key in one
task, which suits many keys. For few or hot keys `running_sums` cuts a key into slices of its order, sums
the slices, and adds to each row what lies before its slice; `last_n` can cut a key into chunks that carry
the rows they need from the chunk before.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def order_of(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    """All rows of the key up to this one."""
    return order_of(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def last_rows(keys: list[str], order: list[str], n: int) -> WindowSpec:
    """This row and the n - 1 before it."""
    return order_of(keys, order).rowsBetween(-(n - 1), 0)


def running_sums(df: DataFrame, keys: list[str], order: list[str], slice_by: Column, sums: Mapping[str, Column]) -> DataFrame:
    """Running sums by key without a task that holds a key.

    slice_by must not decrease along `order` (say, the day of the event time). Only one row per key and
    slice is ordered over the whole key. Null keys and slices are keys and slices of their own. The join is
    null-safe for that, and so that neither side gets filters of its own: what was shuffled to make df is
    then read by both sides instead of being made twice.
    """
    base = df.withColumn("slice_", slice_by).withColumns({f"{n}_v": v for n, v in sums.items()})
    inner = Window.partitionBy(*keys, "slice_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per = base.groupBy(*keys, "slice_").agg(*[F.sum(f"{n}_v").alias(f"{n}_s") for n in sums])
    ahead = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, "slice_"]
    starts = per.select(*[F.col(k).alias(f"{k}_k") for k in on], *[F.coalesce(F.sum(f"{n}_s").over(ahead), F.lit(0)).alias(f"{n}_b") for n in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in on])
    joined = base.withColumns({f"{n}_r": F.sum(f"{n}_v").over(inner) for n in sums}).join(starts, same)
    return joined.select(*df.columns, *[(F.col(f"{n}_r") + F.col(f"{n}_b")).alias(n) for n in sums])


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int, columns: Mapping[str, Column], slice_by: Column | None = None) -> DataFrame:
    """Columns computed over the last n rows of each key: `columns` maps a name to an aggregate.

    With slice_by (not decreasing along `order`) keys are cut into chunks of CHUNK rows; a chunk also gets
    the n - 1 rows before it, which are dropped again after the frame is evaluated.
    """
    if slice_by is None:
        w = last_rows(keys, order, n)
        return df.withColumns({c: a.over(w) for c, a in columns.items()})
    numbered = running_sums(df, keys, order, slice_by, {"row_": F.lit(1).cast("long")})
    chunk = F.floor((F.col("row_") - 1) / CHUNK)
    own = F.struct(chunk.alias("chunk_"), F.lit(True).alias("own_"))
    lent = F.struct((chunk + 1).alias("chunk_"), F.lit(False).alias("own_"))
    in_tail = F.pmod(F.col("row_") - 1, F.lit(CHUNK)) >= CHUNK - (n - 1)
    both = numbered.withColumn("in_", F.explode(F.when(in_tail, F.array(own, lent)).otherwise(F.array(own)))).select("*", "in_.*").drop("in_")
    w = Window.partitionBy(*keys, "chunk_").orderBy("row_").rowsBetween(-(n - 1), 0)
    return both.withColumns({c: a.over(w) for c, a in columns.items()}).filter("own_").drop("row_", "chunk_", "own_")


CHUNK = 100_000


def upper_median(values: Column) -> Column:
    """Item n div 2 (from 0) of the values in ascending order."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def lower_median(values: Column) -> Column:
    """Item n div 2 (from 0) of the values in descending order."""
    ordered = F.sort_array(values, asc=False)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def changed(value: str, keys: list[str], order: list[str]) -> Column:
    """1 for a key's first row and where the value differs from the one before, else 0."""
    before = F.lag(value).over(order_of(keys, order))
    first = F.row_number().over(order_of(keys, order)) == 1
    return F.when(first | ~F.col(value).eqNullSafe(before), 1).otherwise(0)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float, name: str) -> DataFrame:
    """Exponential smoothing s = keep * s + (1 - keep) * value from s = 0, along each key.

    The weighted terms are summed in a frame as value * keep**-i, scaled back by keep**i, within blocks of
    BLOCK rows so that powers stay in range; the block before enters by its last value. Expressions only,
    one sort per key, and no array of a whole key.
    """
    w = order_of(keys, order)
    numbered = df.withColumn("i_", F.row_number().over(w) - 1).withColumn("b_", F.floor(F.col("i_") / BLOCK)).withColumn("j_", F.pmod("i_", F.lit(BLOCK)))
    inner = Window.partitionBy(*keys, "b_").orderBy("i_").rowsBetween(Window.unboundedPreceding, 0)
    term = F.col(value) * F.pow(F.lit(keep), -F.col("j_").cast("double"))
    local = numbered.withColumn("s_", (1 - keep) * F.sum(term).over(inner) * F.pow(F.lit(keep), F.col("j_").cast("double")))
    blocks = local.groupBy(*keys, "b_").agg(F.max_by("s_", "j_").alias("last_"), F.count("*").alias("n_"))
    ahead = Window.partitionBy(*keys).orderBy("b_")
    history = F.collect_list(F.struct("last_", "n_")).over(ahead.rowsBetween(-CARRY, -1))
    carried = blocks.select(*keys, "b_", F.aggregate(history, F.lit(0.0), lambda s, x: s * F.pow(F.lit(keep), x["n_"].cast("double")) + x["last_"]).alias("c_"))
    out = local.join(carried, [*keys, "b_"])
    return out.withColumn(name, F.col("s_") + F.col("c_") * F.pow(F.lit(keep), F.col("j_") + 1.0)).drop("i_", "b_", "j_", "s_", "c_")


#: keep ** BLOCK stays a normal number for keep >= 0.3; two blocks back nothing of a value is left in a double.
BLOCK, CARRY = 256, 3
