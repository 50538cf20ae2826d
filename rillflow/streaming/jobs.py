"""Deploying, rescaling and stopping streaming jobs by name. A rescale restarts from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from . import sinks


@dataclass
class Jobs:
    """builders: name -> function of a session that gives the streaming frame of the job."""

    spark: SparkSession
    folder: str
    builders: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    running: dict[str, StreamingQuery] = field(default_factory=dict)

    def register(self, name: str, build: Callable[[SparkSession], DataFrame]) -> None:
        if name in self.builders:
            raise ValueError(f"a job is named {name} already")
        self.builders[name] = build

    def deploy(self, name: str, start: Callable[[DataFrame, str], StreamingQuery] = sinks.nothing) -> StreamingQuery:
        if name not in self.builders:
            raise KeyError(f"no job is named {name}; there are {sorted(self.builders)}")
        if name in self.running and self.running[name].isActive:
            raise RuntimeError(f"{name} runs already")
        self.running[name] = start(self.builders[name](self.spark), f"{self.folder}/{name}")
        return self.running[name]

    def rescale(self, name: str, tasks: int, start: Callable[[DataFrame, str], StreamingQuery] = sinks.nothing) -> StreamingQuery:
        """Stops after the current batch and goes on from the checkpoint with the state it holds.

        Stateful operators keep the number of partitions their state was made with; `tasks` holds for
        the stateless parts, and for state from a new checkpoint on.
        """
        self.stop(name)
        self.spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        return self.deploy(name, start)

    def stop(self, name: str) -> None:
        if name in self.running:
            self.running.pop(name).stop()
