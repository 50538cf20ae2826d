"""User-written sources: a function of (partition, offset range) as a batch and streaming data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def register(spark: SparkSession, name: str, schema: str, rows: Callable[[int, int, int], Iterator[tuple]], tasks: int, total: int, per_batch: int, progress: str | None = None) -> None:
    """spark.read(Stream).format(name): rows(task, start, end) yields the task's rows of the offsets [start, end).

    Every task is a partition of each batch and runs on the executors. A batch takes per_batch offsets of each task,
    where progress names a file in which the driver keeps how far it got: a reader isn't told where the query stands.
    Without one a batch takes all offsets that are left.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(tasks)]

        def read(self, partition):
            yield from rows(partition.value, 0, total)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:  # noqa: N802
            return {"at": 0}

        def latestOffset(self) -> dict:  # noqa: N802
            done = int(Path(progress).read_text()) if progress and Path(progress).exists() else 0
            return {"at": min(done + per_batch, total) if progress else total}

        def partitions(self, start: dict, end: dict):
            if progress:
                Path(progress).write_text(str(end["at"]))
            return [InputPartition((task, start["at"], end["at"])) for task in range(tasks)]

        def read(self, partition):
            yield from rows(*partition.value)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):  # noqa: N802
            return StreamReader()

    spark.dataSource.register(Source)
