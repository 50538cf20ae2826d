"""Queries and streaming jobs of the catalogue from a shell.

    python -m rillflow.cli list
    python -m rillflow.cli run NAME FOLDER [--out PATH]
    python -m rillflow.cli deploy NAME FOLDER --out PATH --checkpoints PATH [--tasks N] [--once]
    python -m rillflow.cli rescale NAME FOLDER --out PATH --checkpoints PATH --tasks N [--once]

deploy starts a job, or goes on from its checkpoint; rescale does so with another number of tasks (state keeps the
number of partitions that it was made with). With --once a job ends when it has read what there is.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rillflow.plans import catalog, registry
from rillflow.streaming import catalog as streams
from rillflow.streaming import jobs, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="rillflow")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted([*registry.JOBS, *catalog.QUERIES]))
    run.add_argument("folder")
    run.add_argument("--out")
    for what in ("deploy", "rescale"):
        job = sub.add_parser(what)
        job.add_argument("name", choices=sorted(streams.JOBS))
        job.add_argument("folder")
        job.add_argument("--out", required=True)
        job.add_argument("--checkpoints", required=True)
        job.add_argument("--tasks", type=int, required=what == "rescale")
        job.add_argument("--once", action="store_true")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.what == "list":
        print("\n".join(sorted([*registry.JOBS, *catalog.QUERIES])))
        return
    spark = SparkSession.builder.appName(f"rillflow {args.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.what == "run":
        df = registry.query(args.name)(spark, args.folder)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(50, truncate=False)
        return
    running = jobs.Jobs(spark, args.checkpoints)
    running.register(args.name, lambda s: streams.build(s, args.name, args.folder))
    start = lambda df, cp: sinks.files(df, args.out, cp, **({"availableNow": True} if args.once else {}))
    query = running.rescale(args.name, args.tasks, start) if args.tasks else running.deploy(args.name, start)
    query.awaitTermination()


if __name__ == "__main__":
    main()
