"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all tasks run in this
    process (tests); on a cluster a local folder would be lost to the others, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back, so lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*frames: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read any more."""
    for df in frames:
        path, files = hadoop_path(df.sparkSession, df.staged_at)
        files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, which its owner sets by the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of maximal runs of other characters than WHITE; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """rows with `rank`, from 0 in each group by `order`, and `n`, the group's rows. The last column of order tells all rows apart.

    Rows are dealt by ranges of group and order, so a hot group is spread over many tasks; each task numbers its own sorted rows, and the
    counts of the ranges before give the rest: a row a range and group. rows is read twice (ranges are sampled), so stage it before."""
    keys = [group, *order]
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = staged(sorted_.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(group).orderBy("_range")
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(W.partitionBy(group))})
    numbered = placed.join(counts.drop("_n"), [group, "_range"])
    return numbered.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before", "_range")
