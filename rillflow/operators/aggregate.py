"""User-defined incremental aggregates: new, add, merge, out, evaluated partially before the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Aggregator:
    """new() -> state; add(state, row) -> state; merge(state, state) -> state; out(state) -> value."""

    new: Callable[[], Any]
    add: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    out: Callable[[Any], Any]


def aggregate(df: DataFrame, keys: list[str], agg: Aggregator, result: T.StructField) -> DataFrame:
    """keys and the aggregate's value. Built-in functions are faster wherever they can say the same.

    Every task folds its rows to one state per key; only states are shuffled, so a hot key arrives as one
    row per task.
    """
    key_fields = [df.schema[k] for k in keys]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                k = tuple(getattr(row, c) for c in keys)
                states[k] = agg.add(states[k] if k in states else agg.new(), row)
            if len(states) > 100_000:
                yield frame(states)
                states = {}
        if states:
            yield frame(states)

    def frame(states: dict[tuple, Any]) -> pd.DataFrame:
        out = pd.DataFrame(list(states), columns=keys)
        out["state_"] = [pickle.dumps(s) for s in states.values()]
        return out

    def final(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = agg.new()
        for s in pdf["state_"]:
            state = agg.merge(state, pickle.loads(s))
        return pd.DataFrame([[*key, agg.out(state)]], columns=[*keys, result.name])

    states = df.mapInPandas(partial, T.StructType([*key_fields, T.StructField("state_", T.BinaryType())]))
    return states.groupBy(*keys).applyInPandas(final, T.StructType([*key_fields, result]))
