"""Keyed operators with state of the user's own making: map, flat map, and map over two states.

A function gets the state (None before a key's first row) and a row, and gives the next state and what to emit.
Rows of a key are taken in the order of `order` within a batch; state is any value that pickles, small, since it
is read and written once a key and batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .processors import keyed


class Stateful(StatefulProcessor):
    """fn(states, row) -> (states, rows): states is a tuple of as many values as there are names."""

    def __init__(self, fn: Callable, names: tuple[str, ...], order: list[str], columns: list[str]):
        self.fn, self.names, self.order, self.columns = fn, names, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = [handle.getValueState(n, "state binary") for n in self.names]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        states = tuple(pickle.loads(bytes(h.get()[0])) if h.exists() else None for h in self.held)
        out = []
        for row in pd.concat(list(rows)).sort_values(self.order).itertuples(index=False):
            states, made = self.fn(states, row)
            out += made
        for h, s in zip(self.held, states, strict=True):
            h.update((pickle.dumps(s),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str, names: tuple[str, ...]) -> DataFrame:
    columns = T._parse_datatype_string(schema).names
    return keyed(df, key, Stateful(fn, names, order, columns), schema)


def stateful_flatmap(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(state, row) -> (state, list of tuples of the schema)."""

    def step(states, row):
        state, made = fn(states[0], row)
        return (state,), made

    return _run(df, key, order, step, schema, ("state",))


def stateful_map(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(state, row) -> (state, tuple of the schema), one for each row."""

    def step(states, row):
        state, made = fn(states[0], row)
        return (state,), [made]

    return _run(df, key, order, step, schema, ("state",))


def stateful_map2(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(first, second, row) -> (first, second, tuple of the schema): two states that are kept apart."""

    def step(states, row):
        first, second, made = fn(*states, row)
        return (first, second), [made]

    return _run(df, key, order, step, schema, ("first", "second"))
