"""Exact deduplication with a stateful streaming query.

State, one entry for each distinct digest, kept by the RocksDB state store on the executors' disks and in the streaming
checkpoint, never expires: the digest, the number of rows, and of the row that stays its length, identifier and content
locator (file, and row in it). A state folder can be used again by later calls, whose rows then meet all earlier ones. On
every hit, the bytes of both rows are fetched by their locators and compared; where they differ, the bytes make the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, discard, hadoop_path, new_path, staged, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOCATOR = "struct<file: string, at: bigint>"
SLIM = f"doc_id bigint, digest string, sha string, n_points int, locator {LOCATOR}"
BEST = f"struct<n_points: int, rev_id: bigint, locator: {LOCATOR}>"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def located(files: DataFrame) -> DataFrame:
    """doc_id, norm, the text's length, and the locator of each row of Parquet files."""
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("locator")
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), where)


def best() -> Column:
    """Of equal texts the longest original, then the smallest doc_id (null last), then the last row stays."""
    return F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rev_id"), "locator")).alias("best")


def stream_groups(spark: SparkSession, state: str, files_per_batch: int) -> DataFrame:
    """Runs the digest files that the state has not seen through the stateful query, files_per_batch at a time; one row for each digest.

    A batch writes its changed groups under its number, so a batch that runs again after a failure replaces its own rows."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # each partition of the state is a database of its own on an executor's disk, so their number follows the cores
    session.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(max(8, 2 * spark.sparkContext.defaultParallelism)))
    rows = session.readStream.schema(SLIM).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(f"{state}/digests")
    groups = rows.groupBy("digest").agg(best(), F.count(F.lit(1)).alias("group_size"))
    query = (
        groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{state}/groups/batch={n}")).start()
    )
    query.awaitTermination()
    all_groups = spark.read.schema(f"digest string, best {BEST}, group_size bigint, batch int").parquet(f"{state}/groups")
    return all_groups.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max("group_size").alias("group_size"))


def exact_dedup(spark: SparkSession, docs: DataFrame, digits: int = 64, files_per_batch: int = 512, state: str | None = None, run: str = "first", in_files: bool = False) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays).

    Texts are equal when identical without the characters of WHITE; null counts as empty and empty texts are one group.
    Of equal texts the longest original (code points), then the smallest doc_id stays; a null doc_id comes last. Of
    repeated rows with one doc_id exactly one stays. digits: hexadecimal digits of the digest that keys the state; rows
    that share it without sharing all bytes are grouped by the bytes. An empty table gives no rows; other columns are
    not read.

    state: a shared folder to keep; a later call with it and another `run` looks at its own rows, and counts and keeps among all rows
    so far (a call that failed is repeated with its `run`). Without it the state is new. in_files: docs is read from Parquet
    files without joins or unions, so their rows can be located; other rows are written to the state's folder first."""
    folder = state or new_path(spark, "dedup-state")
    if state or not in_files:
        write_once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f"{folder}/content/run={run}")
        content, own = spark.read.parquet(f"{folder}/content"), located(spark.read.parquet(f"{folder}/content/run={run}"))
    else:
        content, own = docs, located(docs)
    digests = f"{folder}/digests/run={run}"
    write_once(own.withColumn("sha", F.sha2("norm", 256)).select("doc_id", F.substring("sha", 1, digits).alias("digest"), "sha", "n_points", "locator"), digests)
    slim = spark.read.schema(SLIM).parquet(digests)
    if slim.isEmpty():
        return slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "locator")
    # staged, so that the join below deals both sides itself and Spark can split a hot digest
    keep = staged(stream_groups(spark, folder, files_per_batch).select("digest", F.bitwise_not("best.rev_id").alias("keep_id"), F.col("best.locator").alias("keep_at"), "group_size"), "dedup-groups")
    result = staged(slim.join(keep, "digest"), "dedup-tagged")
    discard(keep)
    differ = unequal(result, located(content))
    if not differ.isEmpty():
        every = spark.read.schema(SLIM).option("recursiveFileLookup", "true").parquet(f"{folder}/digests")
        result = result.join(differ, "digest", "left_anti").unionByName(by_bytes(every.join(differ, "digest", "left_semi"), slim, located(content), result.columns))
    return result.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("keep_at").alias("locator"))


def write_once(df: DataFrame, path: str) -> None:
    """Writes the rows unless an earlier call has, whole."""
    done, files = hadoop_path(df.sparkSession, f"{path}/_SUCCESS")
    if not files.exists(done):
        df.write.mode("overwrite").parquet(path)


def with_bytes(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked: file, at and more. Adds norm, the bytes that the locator leads to."""
    return texts.select("locator.file", "locator.at", "norm").join(asked.hint("merge"), ["file", "at"])  # both sides grow with the corpus: never broadcast


def unequal(tagged: DataFrame, texts: DataFrame, per_salt: int = 1000) -> DataFrame:
    """Digests of hits whose bytes are not those of the row that stays, one row each.

    The hits of a large group are dealt over salts, about per_salt each, and the row that stays is sent to every salt."""
    several = tagged.filter("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / per_salt).cast("int"))
    hits = several.filter("locator != keep_at").select("locator.*", "digest", F.pmod(F.xxhash64("locator"), "salts").cast("int").alias("salt"), F.lit(False).alias("stays"))
    keepers = several.select("keep_at", "digest", "salts").distinct().select("keep_at.*", "digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("stays"))
    fetched = staged(with_bytes(hits.unionByName(keepers), texts), "dedup-hits")
    kept = fetched.filter("stays").select("digest", "salt", F.col("norm").alias("kept_norm"))
    differ = staged(fetched.filter("not stays").join(kept, ["digest", "salt"]).filter("norm != kept_norm").select("digest").distinct(), "dedup-differ")
    discard(fetched)
    return differ


def by_bytes(every: DataFrame, slim: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """Groups the rows of digests that several texts share by their bytes; of these, the rows of slim."""
    rows = staged(with_bytes(every.select("*", "locator.*"), texts).drop("file", "at"), "dedup-bytes")
    groups = rows.groupBy("digest", "norm").agg(best(), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", "norm", F.bitwise_not("best.rev_id").alias("keep_id"), F.col("best.locator").alias("keep_at"), "group_size")
    return rows.join(slim.select("locator"), "locator", "left_semi").join(groups, ["digest", "norm"]).select(columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents"), in_files=True).drop("locator")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
