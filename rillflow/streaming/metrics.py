"""Progress of streaming queries as rows (operator_id, timestamp, metric_type, metric_value)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "operator_id string, timestamp string, metric_type string, metric_value double"


def rows_of(progress: dict) -> list[tuple[str, str, str, float]]:
    """Rates, latency by phase, and state sizes of one micro-batch."""
    name, at = progress.get("name") or progress["id"], progress["timestamp"]
    found = {"input_rate": progress.get("inputRowsPerSecond"), "processed_rate": progress.get("processedRowsPerSecond"), "input_rows": progress.get("numInputRows")}
    found |= {f"ms_{k}": v for k, v in (progress.get("durationMs") or {}).items()}
    for i, s in enumerate(progress.get("stateOperators") or []):
        found |= {f"state{i}_{k}": s.get(k) for k in ("numRowsTotal", "memoryUsedBytes", "numRowsUpdated", "numRowsDroppedByWatermark")}
    return [(name, at, k, float(v)) for k, v in found.items() if isinstance(v, (int, float)) and v == v]


def _dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    return spark.createDataFrame([r for p in query.recentProgress for r in rows_of(_dict(p))], SCHEMA)


class Collector(StreamingQueryListener):
    """Keeps the rows of every query's progress until they are drained into a sink."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += rows_of(_dict(event.progress))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out
