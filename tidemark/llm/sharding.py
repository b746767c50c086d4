"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of each row's place (its file and the row in
it), so no value, however common, makes a large bucket. Pass two shuffles each bucket by Fisher and Yates and writes it. Buckets one
after the other are a uniform permutation, which is cut into shards whose rows differ by at most one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, staged, table

#: Buckets of one group, whose numbers of rows are summed in one task.
GROUP = 4096


def fisher_yates(items: Column, draw) -> Column:
    """A permutation of an array of integers: from the last place down, draw(i) names one of the i + 1 that are left, which takes place i, and
    the last of them moves to where it was."""

    def step(a: Column, i: Column) -> Column:
        left = a["left"]

        def swap(j: Column) -> Column:
            rest = F.when(j < i, F.concat(F.slice(left, F.lit(1), j), F.array(F.get(left, i)), F.slice(left, j + 2, i - j - 1))).otherwise(F.slice(left, F.lit(1), i))
            return F.struct(rest.alias("left"), F.array_append(a["taken"], F.get(left, j)).alias("taken"))

        return F.transform(F.array(draw(i)), swap)[0]  # binds the draw

    start = F.struct(items.alias("left"), F.array().cast("array<int>").alias("taken"))
    return F.reverse(F.aggregate(F.sequence(F.size(items) - 1, F.lit(0)), start, step)["taken"])


def bucket_of(seed: int, buckets: int) -> Column:
    """The bucket of a row by its place."""
    return F.pmod(F.xxhash64(F.lit(seed), "place.file", "place.at"), F.lit(buckets)).cast("long")


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 7, bucket_rows: int = 512, bucket_bytes: int = 16 << 20, in_files: bool = False) -> DataFrame:
    """One row for each document: shard (0 to shards - 1), slot (from 0 without a gap), doc (a struct of all its columns).

    Law `rows`: numbers of rows of any two shards differ by at most one. Rows are dealt one by one, equal ones and those of one id too; their
    values play no part, so nulls, ties and clashing names do no harm, and an empty table gives no rows. Empty shards have none.
    The same files, seed and sizes give the same shards. A bucket has about bucket_rows rows, fewer where they would hold over bucket_bytes
    of text. in_files: docs is read from Parquet files without joins or unions; else it is written to the shared folder first."""
    names = docs.columns
    if in_files:
        place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        rows = docs.select(place.alias("place"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    else:
        held = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at")).alias("place")), "shard-rows")
        rows = held.select("place", "doc")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("doc.text"))).first()
    buckets = max(1, -(-n // bucket_rows), -(-(size or 0) // bucket_bytes))
    dealt = rows.withColumn("bucket", bucket_of(seed, buckets))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    by_group, inside = W.partitionBy().orderBy("group").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    groups = counts.groupBy("group").agg(F.sum("m").alias("in_group")).select("group", F.coalesce(F.sum("in_group").over(by_group), F.lit(0)).alias("before"))  # a row for each 4096 buckets
    starts = counts.join(groups, "group").select("bucket", (F.col("before") + F.coalesce(F.sum("m").over(inside), F.lit(0))).alias("start"))
    held = dealt.repartition("bucket").groupBy("bucket").agg(F.collect_list("place").alias("places"), F.collect_list("doc").alias("docs"))
    # rows arrive in any order: the shuffle starts from the order of their places
    inorder = F.transform(F.sort_array(F.transform("places", lambda p, i: F.struct(p.alias("place"), i.alias("i")))), lambda x: x["i"])
    order = fisher_yates(inorder, lambda i: F.pmod(F.xxhash64(F.lit(seed), "bucket", i), (i + 1).cast("long")).cast("int"))
    held = held.join(starts, "bucket").select("start", F.transform(order, lambda k: F.get("docs", k)).alias("docs"))
    mixed = held.select("start", F.posexplode("docs").alias("nth", "doc"))
    placed = mixed.select((F.col("start") + F.col("nth")).alias("at"), "doc").withColumn("shard", F.expr(f"at * {shards} div {max(1, n)}"))
    return placed.select(F.col("shard").cast("int").alias("shard"), (F.col("at") - F.expr(f"(shard * {n} + {shards - 1}) div {shards}")).alias("slot"), "doc")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes shuffled() as Parquet files, a folder for each shard (path/shard=0 ...). Files hold whole buckets in the order of their slots."""
    rows = shuffled(docs, **options)
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The shards' rows: shard, slot, doc. docs: what was written, for its schema, as an empty table leaves no folder to read it from."""
    kind = docs.schema.simpleString()
    return spark.read.schema(f"slot bigint, doc {kind}, shard int").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards' files as they are read back."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "shards")
    write_shards(docs, path, in_files=True)
    text = F.coalesce("doc.text", F.lit(""))
    return read_shards(spark, path, docs).select(
        F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
