"""Row-wise operators: map, filter, flat map, sources joined and edges dealt. All are narrow but the last two."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapper(df: DataFrame, **columns: Column) -> DataFrame:
    """One row to one row; the event time and other columns are inherited."""
    return df.withColumns(columns)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows whose predicate is true; null counts as false."""
    return df.filter(predicate)


def flatmap(df: DataFrame, items: Column, name: str) -> DataFrame:
    """One row to as many as the array has items, none for a null or empty array."""
    return df.withColumn(name, F.explode(items))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One stream of several sources of the same columns."""
    for other in others:
        first = first.unionByName(other)
    return first


def tagged(inputs: Iterable[tuple[str, DataFrame]], column: str = "input") -> DataFrame:
    """Several inputs of a co-process operator as one stream; columns that an input lacks are null."""
    out = None
    for name, df in inputs:
        own = df.withColumn(column, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def round_robin(df: DataFrame, tasks: int) -> DataFrame:
    """Deals rows over tasks regardless of key: only to spread work that follows."""
    return df.repartition(tasks)


def key_by(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Deals rows by hash of the keys. groupBy and joins do so themselves; only for reuse by several of them."""
    return df.repartition(tasks, *keys)


def key_bucket(*keys: str, buckets: int = 128) -> Column:
    """The fixed hash bucket of a key."""
    return F.pmod(F.hash(*keys), F.lit(buckets))
