"""Command line for spark-submit: run a registered query, recompute states, export states, or export timing.

    python -m tidemark query NAME --data DIR --out PATH
    python -m tidemark states --scores PATH --out PATH [--stored PATH] [--days 7] [--reset]
    python -m tidemark export --states PATH --out PATH [--backups DIR]
    python -m tidemark timing --features CSV --out PATH
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sinks
from .operators import models, score
from .sources import files


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, or 1 where there was nothing to do."""
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, options in {"query": ("data", "out"), "states": ("scores", "out", "stored"), "export": ("states", "out", "backups"), "timing": ("features", "out")}.items():
        p = jobs.add_parser(job)
        if job == "query":
            p.add_argument("name")
        for o in options:
            p.add_argument(f"--{o}", required=o not in ("stored", "backups"))
        if job == "states":
            p.add_argument("--days", type=int)
            p.add_argument("--reset", action="store_true")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName(f"tidemark-{a.job}").getOrCreate()
    if a.job == "query":
        from .queries import QUERIES

        QUERIES[a.name](spark, a.data).write.mode("overwrite").parquet(a.out)
    elif a.job == "states":
        scores = spark.read.parquet(a.scores)
        stored = spark.read.parquet(a.stored) if a.stored else None
        if stored is not None and a.days:
            stored = stored.filter(F.col("date") <= F.date_sub(F.lit(scores.agg(F.max("date")).first()[0]), a.days))  # recompute the last days
        score.recompute_states(scores, stored, reset=a.reset).write.mode("overwrite").parquet(a.out)
    elif a.job == "export":
        if a.backups:
            sinks.backup(spark, a.out, a.backups)
        sinks.export_csv(sinks.flat_records(spark.read.parquet(a.states)), a.out, ["as_of_date"])
    else:
        rows = files.read_timing_input(spark, a.features)
        if rows is None:
            return 1
        sinks.export_csv(models.timing(rows), a.out, ["date"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
