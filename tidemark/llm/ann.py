"""Nearest neighbours by inner product through a few stable (Gaussian) projections and a kd-tree over them.

A vector gets one more component so that all have the norm of the longest; then the largest inner product is the smallest
distance. For a point at distance d, the squared distance of the projections over d squared is chi-square with as many
degrees of freedom as projections. Points are verified in the order of their projected distance, until the next is farther
than the k-th best distance allows with the given confidence: first in the query's own leaf of the kd-tree, then in all
leaves whose box fails that stopping test. Leaves are the partitions of the work; large ones are cut into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table


def chi_square(freedom: int, z: float) -> float:
    """Quantile by the Wilson-Hilferty approximation; z is the normal quantile."""
    c = 2 / (9 * freedom)
    return freedom * (1 - c + z * c**0.5) ** 3


def kd_splits(sample: np.ndarray, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A balanced kd-tree with a power of two of leaves: for each level the axis and the threshold of each node."""
    levels, groups = [], [sample]
    while len(groups) < leaves:
        axis, cut, next_ = [], [], []
        for g in groups:
            a = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
            t = float(np.median(g[:, a])) if len(g) else 0.0
            axis.append(a)
            cut.append(t)
            next_ += [g[g[:, a] <= t], g[g[:, a] > t]]
        levels.append((np.array(axis), np.array(cut)))
        groups = next_
    return levels


def leaf_of(points: np.ndarray, levels) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for axis, cut in levels:
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > cut[node])
    return node


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """Rows whose vector has some component other than 0, and none that is null or not finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = rows.schema[vector].dataType.elementType.typeName()
    own = F.col(vector) if kind in ("float", "double") else v
    return rows.filter(F.col(id_).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias("vec_id"), own.alias("v"))


def nearest(rows: DataFrame, k: int = 20, every: int = 20, projections: int = 8, z: float = 1.645, block_rows: int = 4096, query_rows: int = 4096, opening: int = 512, sample_rows: int = 400_000, seed: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query, a row whose id is divisible by `every`: query_id, rank, vec_id and score of its k nearest found.

    The tree is fitted to the projections of at most sample_rows vectors, a few numbers each; every vector is indexed. Of equal
    vectors only the k + 1 smallest ids can be among k nearest, so equal vectors are searched once; rows that share an id and
    differ are vectors of their own, and none of them is a neighbour of that id. Scores are of the vectors as they are, in double precision. A query
    has no neighbour but itself left out; with fewer candidates it gets them all. Vectors of another length than the most
    common (then smallest) take no part."""
    spark = rows.sparkSession
    fine = usable(rows, id_, vector)
    size = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fine = fine.filter(F.size("v") == size.d)
    best = W.partitionBy("v").orderBy("vec_id")
    few = fine.distinct().withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = staged(points.select(F.col("ids")[0].alias("rep"), "ids", "v"), "ann-points")
    queries = fine.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = staged(queries.join(points.select("rep", "v"), "v").select("query_id", "rep"), "ann-queries")

    squares = lambda v: F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    top = points.agg(F.max(squares(F.col("v"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    longest, matrix = top.m**0.5, np.random.default_rng(seed).normal(size=(size.d + 1, projections))

    def project(v: np.ndarray, query: bool) -> np.ndarray:
        square = (v * v).sum(1)
        if query:
            return (v @ matrix[:-1]) * (longest / np.sqrt(square))[:, None]
        return v @ matrix[:-1] + np.sqrt(np.maximum(0, top.m - square))[:, None] * matrix[-1]

    def vectors(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size.d)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(list(project(vectors(b["v"]), False)), pa.list_(pa.float64()))], names=["p"])

    some = points.select("rep", "v").orderBy(F.xxhash64("rep")).limit(sample_rows) if top.n > sample_rows else points
    sample = np.array(some.select("v").mapInArrow(projected, "p array<double>").toArrow()["p"].to_pylist(), np.float64).reshape(-1, projections)
    leaves = 1 << max(0, min(int(np.ceil(np.log2(max(1, top.n / block_rows)))), int(np.log2(max(1, len(sample) / 8)))))
    levels = kd_splits(sample, leaves)

    def index(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = project(vectors(b["v"]), query)
                    yield pa.record_batch([b["rep"], b["v"], pa.array(list(p), pa.list_(pa.float64())), pa.array(leaf_of(p, levels))], names=["rep", "v", "p", "leaf"])

        return run

    schema = f"rep bigint, v {points.schema['v'].dataType.simpleString()}, p array<double>, leaf bigint"
    indexed = staged(points.select("rep", "v").mapInArrow(index(False), schema), "ann-indexed")
    asked = staged(points.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "v").mapInArrow(index(True), schema), "ann-asked")
    boxes = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("p")[i]).alias(f"{s}{i}") for s, f in (("lo", F.min), ("hi", F.max)) for i in range(projections)]).orderBy("leaf").toPandas()  # a row a leaf
    rows_in = dict(zip(boxes.leaf.tolist(), boxes.n.tolist()))
    numbers, low, high = boxes.leaf.to_numpy(), boxes[[f"lo{i}" for i in range(projections)]].to_numpy(), boxes[[f"hi{i}" for i in range(projections)]].to_numpy()
    limit = chi_square(projections, z)

    def allowed(score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared projected distance beyond which a point is as near as score with less than the confidence."""
        return limit * np.maximum(0, 2 * top.m - 2 * longest * score / norm) + 1e-9

    def search(key, mine: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """The nearest that each query finds in a block, some queries at a time. First the `opening` points of smallest projected
        distance are verified; then, until the next fails the stopping test for the k-th best so far, twice as many."""
        out = [pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "near": pd.Series(dtype="float64")})]
        if not len(mine) or not len(ask):
            return out[0]
        v, p, names = np.stack(mine.v.to_numpy()).astype(np.float64), np.stack(mine.p.to_numpy()), mine.rep.to_numpy()
        squares_ = (p * p).sum(1)
        for at in range(0, len(ask), 64):
            part = ask.iloc[at : at + 64]
            q, a, kth, who = np.stack(part.v.to_numpy()).astype(np.float64), np.stack(part.p.to_numpy()), part.floor.to_numpy().copy(), np.arange(len(part))
            norm, floor = np.sqrt((q * q).sum(1)), kth.copy()
            far = np.maximum(0, (a * a).sum(1)[:, None] + squares_ - 2 * (a @ p.T))
            best, done, most = np.full((len(part), len(v)), -np.inf), 0, min(opening, len(v))
            order = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(v) else np.tile(np.arange(len(v)), (len(part), 1))
            while len(who):
                # of the points that the test allows, the next nearest; all scores of a block are one product where most are wanted
                score = q[who] @ v.T if 4 * order.shape[1] > len(v) else None
                found = np.take_along_axis(score, order, 1) if score is not None else np.einsum("ij,ikj->ik", q[who], v[order])
                best[who[:, None], order] = found
                done = order.shape[1]
                if done > k:
                    kth[who] = np.maximum(floor[who], np.partition(np.take_along_axis(best[who], order, 1), done - k - 1, axis=1)[:, done - k - 1])
                if done == len(v):
                    break
                open_ = (far[who] <= np.where(np.isneginf(kth[who]), np.inf, allowed(np.where(np.isneginf(kth[who]), 0, kth[who]), norm[who]))[:, None]).sum(1)
                who = who[(open_ > done) | (done <= k)]
                most = min(len(v), 2 * done)
                order = np.argpartition(far[who], most - 1, axis=1)[:, :most] if most < len(v) else np.tile(np.arange(len(v)), (len(who), 1))
            keep = min(k + 1, len(v))
            top_ = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
            near = np.take_along_axis(best, top_, 1)
            i, j = np.nonzero(near >= np.maximum(floor, -np.finfo(np.float64).max)[:, None])
            out.append(pd.DataFrame({"q": part.rep.to_numpy()[i], "rep": names[top_[i, j]], "near": near[i, j]}))
        return pd.concat(out)

    def visit(ask: DataFrame) -> DataFrame:
        """ask: rep, v, p, leaf, floor; each query searches one leaf, block by block."""
        n_asked = {r["leaf"]: r["count"] for r in ask.groupBy("leaf").count().collect()}  # a row a leaf
        cuts = [(leaf, -(-rows_in[leaf] // (2 * block_rows)), -(-n // query_rows)) for leaf, n in n_asked.items() if leaf in rows_in]
        cut = F.broadcast(spark.createDataFrame(cuts, "leaf long, np long, nq long"))  # a row a leaf
        left = indexed.join(cut, "leaf").select("rep", "v", "p", "leaf", F.pmod(F.xxhash64("rep"), "np").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"))
        right = ask.join(cut, "leaf").select("rep", "v", "p", "floor", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)).alias("pb"), F.pmod(F.xxhash64("rep", F.lit(1)), "nq").alias("qb"))
        keys = ["leaf", "pb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "q bigint, rep bigint, near double")

    ranked = lambda df: df.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("near"), "rep"))).filter(F.col("nth") <= k + 1)
    first = staged(visit(asked.withColumn("floor", F.lit(float("-inf")))), "ann-first")
    floors = ranked(first).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).select(F.col("q").alias("rep"), F.when(F.col("n") > k, F.col("near")).otherwise(float("-inf")).alias("floor"))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other leaves that a query's stopping test leaves open."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                p, v = np.array(part["p"].to_pylist()), vectors(part["v"])
                gap = sum(np.maximum(0, np.maximum(low[:, i] - p[:, i : i + 1], p[:, i : i + 1] - high[:, i])) ** 2 for i in range(projections))
                floor = part["floor"].to_numpy(zero_copy_only=False)
                reach = np.where(np.isneginf(floor), np.inf, allowed(np.where(np.isneginf(floor), 0, floor), np.sqrt((v * v).sum(1))))
                who, where = np.nonzero((gap <= reach[:, None]) & (numbers != part["leaf"].to_numpy()[:, None]))
                taken = pa.array(who)
                yield pa.record_batch([part["rep"].take(taken), part["v"].take(taken), part["p"].take(taken), pa.array(numbers[where]), part["floor"].take(taken)], names=["rep", "v", "p", "leaf", "floor"])

    again = staged(asked.join(floors, "rep").select("rep", "v", "p", "leaf", "floor").mapInArrow(more, schema + ", floor double"), "ann-again")
    found = staged(ranked(first if again.isEmpty() else first.unionByName(visit(again))), "ann-found")
    exact = F.aggregate(F.zip_with(F.col("qv").cast("array<double>"), F.col("v").cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(points, "rep").join(points.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q").select("q", F.explode("ids").alias("vec_id"), exact.alias("score"))
    each = queries.select("query_id", F.col("rep").alias("q")).join(scored, "q").filter("vec_id != query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
