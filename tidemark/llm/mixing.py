"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are permuted by a keyed hash. A source that takes c copies and a remainder draws its permutation
c times and then a prefix of it, so its quota of draws is exact before any row moves. The tree then splits the vector of
quotas over the output shards: at each node the left half's share of each source is a hypergeometric draw given what
the sources before it took, so each shard gets disjoint, consecutive runs of the permutations. Ranks in the permutation are
prefix sums over hash buckets, so no source passes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, n_words, partitions, staged, table

#: The contract's weights, repeated along the sorted sources.
WEIGHTS = (3, 1, 2)


def source_key(source: Column) -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources: sk, source_size, one row for each source. Adds target: share of all sizes by weight, at most `most` times
    the source's own size, the excess dealt again by weight among those below their cap. Sources are few; rows are not."""
    by_key, by_ratio = W.orderBy("sk"), W.orderBy("ratio", "sk")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sources.withColumns({"w": weight, "cap": most * F.col("source_size")}).withColumn("ratio", F.col("cap") / F.col("w"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = share * F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    return s.withColumn("target", F.when(F.col("ratio") > F.col("level"), F.col("w") * first).otherwise(F.col("cap"))).select("sk", "source_size", "n_docs", "target")


def hypergeometric(n: Column, total: Column, draws: Column, u: Column) -> Column:
    """Inverts the distribution of marked items among `draws` of `total` with n marked, at u in [0, 1). The weights are
    relative and reach 12 standard deviations and 12 to either side of the mean, where nothing of double size is left."""
    size = F.greatest(total, F.lit(1)).cast("double")
    mean = draws * n / size
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - n / size) * (total - draws) / F.greatest(total - 1, F.lit(1))))
    low = F.greatest(F.lit(0).cast("long"), draws - (total - n), F.floor(mean - 12 * sd - 12))
    high = F.least(n, draws, F.ceil(mean + 12 * sd + 12))
    ratio = lambda x: (n - x) * (draws - x).cast("double") / ((x + 1) * (total - n - draws + x + 1).cast("double"))
    xs = F.sequence(low, F.greatest(low, high))
    one, zero = F.lit(1.0), F.lit(0.0)
    mass = F.aggregate(xs, F.struct(one.alias("w"), zero.alias("s")), lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s")))["s"]

    def pick(mass: Column) -> Column:
        start = F.struct(one.alias("w"), zero.alias("s"), low.alias("x"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s"), F.when(a["s"] <= u * mass, x).otherwise(a["x"]).alias("x")))["x"]

    return F.transform(F.array(mass), pick)[0]  # binds the sum, which else would be computed again for each weight


def uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: sk, q. One row for each source and shard: sk, shard, n, exact for every source, shards of equal size (up to one)."""
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("sk", F.col("q").alias("n")))).alias("node")).withColumn("shard", F.lit(0))
    for level in range(depth):
        total = F.aggregate("node", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        nodes = nodes.withColumn("total", total)
        start = F.struct(F.col("total").alias("total"), (F.col("total") / 2).cast("long").alias("draws"), F.array().cast("array<struct<sk:string,n:bigint>>").alias("left"))

        salt = level

        def step(a, x):
            got = hypergeometric(x["n"], a["total"], a["draws"], uniform(F.lit(seed), F.lit(salt), F.col("shard"), x["sk"]))
            return F.transform(F.array(got), lambda g: F.struct((a["total"] - x["n"]).alias("total"), (a["draws"] - g).alias("draws"), F.concat(a["left"], F.array(F.struct(x["sk"].alias("sk"), g.alias("n")))).alias("left")))[0]

        nodes = nodes.withColumn("left", F.aggregate("node", start, step)["left"])
        right = F.zip_with("node", "left", lambda x, y: F.struct(x["sk"].alias("sk"), (x["n"] - y["n"]).alias("n")))
        pair = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("node")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("node")))
        nodes = nodes.select(F.inline(pair))
    return nodes.select("shard", F.inline("node"))


def within_groups(rows: DataFrame, per_salt: int) -> DataFrame:
    """Numbers the rows of each group (sk, key, size; m rows) from 0 as nth. Large groups are numbered salt by salt, about per_salt rows each."""
    key = ["sk", "key", "size"]
    alone = rows.filter("m = 1").withColumn("nth", F.lit(0).cast("long"))
    several = rows.filter("m > 1").withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / per_salt)).cast("int"))
    sizes = several.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("in_salt"))
    offsets = sizes.select(*key, "salt", F.coalesce(F.sum("in_salt").over(W.partitionBy(*key).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy(*key, "salt").orderBy("row")) - 1
    numbered = several.withColumn("number", number).join(offsets, [*key, "salt"]).withColumn("nth", (F.col("number") + F.col("offset")).cast("long"))
    return alone.unionByName(numbered.select(alone.columns))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), shards: int = 16, seed: int = 7, share: float = 1.5, most: float = 2.0, per_salt: int = 10_000) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies, taken, shards, and with carry row (a number of its own) and these columns.

    size counts runs of other characters than white space (null text: 0); taken is copies times size, shards holds the
    output shard of each copy. A null source is a source of its own, after all others; sources without a word get and
    give nothing. The permutation depends on the seed, doc_id and size alone, so reruns agree and repeated rows, which tie,
    are interchangeable. An empty table gives no rows. Other columns are left alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("sk"), n_words(F.col("text")).alias("size"), *[F.struct(*[F.col(c) for c in carry]).alias("carried")] * bool(carry))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("bucket", F.substring("key", 1, 4))
    whole = staged(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")  # row is kept in the files, so it is stable
    rows = whole.drop("carried")
    buckets = staged(rows.groupBy("sk", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-buckets")
    source = targets(buckets.groupBy("sk").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    source = staged(source.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-sources")
    earlier = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select("sk", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    # rows of one key and size are interchangeable: they are ranked as one group, so that no task holds all rows of a repeated id
    inside = W.partitionBy("sk", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    groups = rows.groupBy("sk", "bucket", "key", "size").agg(F.count(F.lit(1)).alias("m"))
    groups = groups.withColumns({"words_in": F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)), "n_in": F.coalesce(F.sum("m").over(inside), F.lit(0))})
    groups = staged(groups.join(starts, ["sk", "bucket"]).drop("bucket"), "mix-groups")
    placed = within_groups(rows.drop("bucket").join(groups, ["sk", "key", "size"]), per_salt).join(source, "sk")
    discard(buckets)
    run = F.col("words_before") + F.col("words_in") + F.col("nth") * F.col("size")
    extra = (F.col("rest") > 0) & (run + F.col("size") / 2 <= F.col("rest"))
    ranked = placed.withColumns({"rank": F.col("n_before") + F.col("n_in") + F.col("nth"), "extra": extra.cast("int")})
    ranked = staged(ranked.select("sk", "doc_id", "size", "source_size", "target", "n_docs", "full", "extra", "rank", "row"), "mix-ranked")
    quotas = ranked.groupBy("sk").agg((F.max("full") * F.max("n_docs") + F.sum("extra")).cast("long").alias("q"))
    runs = split_quotas(quotas, shards, seed).withColumn("end", F.sum("n").over(W.partitionBy("sk").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    ends = runs.groupBy("sk").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    copies = F.col("full") + F.col("extra")
    place = F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.size(F.filter("ends", lambda e: e <= k * F.col("n_docs") + F.col("rank"))))
    result = ranked.join(ends, "sk").withColumns({"copies": copies, "shards": F.when(copies > 0, place).otherwise(F.array().cast("array<int>"))})
    if carry:
        result = result.join(whole.select("row", "carried"), "row")
    return result.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards", *["row", "carried.*"] * bool(carry))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The mixture itself, with the columns of docs: one row for each copy, each shard shuffled locally by a keyed hash of row and copy.

    Shards are dealt to tasks in parts, four times as many in all as there are shuffle partitions, so tasks are as many as the owner
    of the cluster wants for the data. Equal rows and rows without an id are dealt like any others; names that clash do no harm, and
    an empty table gives no rows."""
    names = docs.columns
    carried = [f"in_{i}" for i in range(len(names))]
    named = docs.select("*").toDF(*names).select("doc_id", "source", "text", *[F.col(c).alias(k) for c, k in zip(names, carried)])
    draws = mix(named, tuple(carried), shards, seed).select("row", F.posexplode("shards").alias("copy", "shard"), *carried)
    order, parts = F.xxhash64(F.lit(seed), "copy", "row"), -(-4 * partitions(docs.sparkSession) // shards)
    dealt = draws.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(parts))).repartition("shard", "part").sortWithinPartitions("shard", "order")
    return dealt.select(*[F.col(k).alias(c) for c, k in zip(names, carried)])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
