"""Name -> query over a folder of parquet tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import basics, nexmark, traces

QUERIES: dict[str, Callable] = {**basics.QUERIES, **nexmark.QUERIES, **traces.QUERIES}
ORACLES: dict[str, str] = {**basics.ORACLES, **nexmark.ORACLES, **traces.ORACLES}
