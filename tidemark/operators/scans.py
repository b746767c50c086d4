"""Scans along a series that no task reads alone: forward fill, running sums, products and extremes, streaks, as-of and nearest joins.

A series is cut into blocks of time. Blocks are scanned in parallel, each as if the series began with it; their last values, a row a
block, are scanned in turn; and what came before a block is put together with what was found in it. One long series so uses as many tasks
as it has blocks, for one shuffle of the rows: the blocks' values come to the rows where these already are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import upto

ROWS_PER_BLOCK = 1 << 20
KINDS = ("ffill", "bfill", "sum", "product", "max", "min", "streak")


def as_number(df: DataFrame, time: str) -> Column:
    """Days of a date, microseconds of a timestamp, or the number itself."""
    kind = dict(df.dtypes)[time]
    if kind == "date":
        return F.unix_date(time)
    return F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time)


def time_blocks(df: DataFrame, time: str, rows_per_block: int = ROWS_PER_BLOCK) -> Column:
    """Numbers of equal stretches of time, each with about rows_per_block rows of all series together."""
    t = as_number(df, time)
    n, first, last = df.agg(F.count(F.lit(1)), F.min(t), F.max(t)).first()
    width = 1 if first is None else max(1, -(-int(last - first + 1) * rows_per_block // max(n, 1)))
    return F.coalesce(F.floor((t - F.lit(first)) / F.lit(width)).cast("long"), F.lit(-1))


def scan(df: DataFrame, keys: Sequence[str], time: str, block: Column, stats: dict[str, tuple[str, Column]], tie: Sequence[str] = ()) -> DataFrame:
    """Adds name -> (kind, column): ffill and bfill, the last and next value that is not null; sum, product, max and min of the values so far, nulls
    left out; streak, the rows up to this one in a row for which a flag holds (null breaks it). block: time_blocks(), rising with time. Rows
    of a series are ordered by time, then tie. A null key is a series of its own."""
    order = [time, *tie]
    rows = df.withColumns({"_key": F.struct(*keys), "_blk": block, **{f"_x_{k}": x for k, (_, x) in stats.items()}})
    here, series = W.partitionBy("_key", "_blk"), W.partitionBy("_key").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    up, down, later = upto(here.orderBy(*order)), upto(here.orderBy(*[F.desc(c) for c in order])), W.partitionBy("_key").orderBy(F.desc("_blk")).rowsBetween(W.unboundedPreceding, -1)
    plain = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
    last = lambda x, at: F.max_by(x, F.when(x.isNotNull(), at))
    of, at, c = {kind: [k for k, (m, _) in stats.items() if m == kind] for kind in KINDS}, F.struct(*order), F.col

    inside, ends = {}, {}
    for k, (kind, _) in stats.items():
        x = c(f"_x_{k}")
        if kind in plain:
            inside[f"_u_{k}"], ends[f"_e_{k}"] = plain[kind](x).over(up), plain[kind](x)
        elif kind == "ffill":
            inside[f"_u_{k}"], ends[f"_e_{k}"] = F.last(x, ignorenulls=True).over(up), last(x, at)
        elif kind == "bfill":
            inside[f"_u_{k}"], ends[f"_e_{k}"] = F.last(x, ignorenulls=True).over(down), F.min_by(x, F.when(x.isNotNull(), at))
    scanned = rows
    if of["streak"]:
        scanned = scanned.withColumn("_n", F.row_number().over(here.orderBy(*order)))
        broken = {f"_b_{k}": F.max(F.when(~F.coalesce(c(f"_x_{k}"), F.lit(False)), c("_n"))).over(up) for k in of["streak"]}
        scanned = scanned.withColumns(broken).withColumns({f"_u_{k}": (c("_n") - F.coalesce(f"_b_{k}", F.lit(0))).cast("long") for k in of["streak"]})
        for k in of["streak"]:
            ends |= {f"_e_{k}": F.max_by(f"_u_{k}", at), f"_w_{k}": F.max(c(f"_b_{k}").isNotNull()).cast("int")}
    table = scanned.groupBy("_key", "_blk").agg(*[e.alias(k) for k, e in ends.items()])  # a row a block
    for k in of["streak"]:  # a block that holds throughout goes on with the streak before it
        run = upto(W.partitionBy("_key").orderBy("_blk"))
        table = table.withColumn("_g", F.sum(f"_w_{k}").over(run)).withColumn(f"_e_{k}", F.sum(f"_e_{k}").over(upto(W.partitionBy("_key", "_g").orderBy("_blk"))))
    carried = {k: F.last(f"_e_{k}", ignorenulls=kind in ("ffill", "bfill")).over(later if kind == "bfill" else series) if kind in ("ffill", "bfill", "streak") else plain[kind](f"_e_{k}").over(series) for k, (kind, _) in stats.items()}
    table = table.select("_key", "_blk", *[x.alias(f"_c_{k}") for k, x in carried.items()])

    both = scanned.withColumns(inside).join(table, ["_key", "_blk"])
    out = {}
    for k, (kind, _) in stats.items():
        u, before = c(f"_u_{k}"), c(f"_c_{k}")
        if kind in ("ffill", "bfill"):
            out[k] = F.coalesce(u, before)
        elif kind == "streak":
            out[k] = u + F.when(c(f"_b_{k}").isNull(), F.coalesce(before, F.lit(0))).otherwise(F.lit(0))
        elif kind in ("max", "min"):
            out[k] = (F.greatest if kind == "max" else F.least)(u, before)
        else:
            out[k] = F.coalesce(u + before if kind == "sum" else u * before, u, before)
    return both.select(*df.columns, *[x.alias(k) for k, x in out.items()])


def stacked(probes: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str], time: str) -> DataFrame:
    """Probes and facts in one table; facts come before the probes of their time."""
    kept = [c for c in probes.columns if c not in (*keys, time)]
    left = probes.select(*keys, time, F.lit(1).alias("_p"), F.struct(*[F.col(c) for c in kept], F.lit(1).alias("_")).alias("_row"))
    right = facts.select(*keys, time, F.lit(0).alias("_p"), F.struct(F.col(time).alias("as_of"), *values).alias("_fact"))
    return left.unionByName(right, allowMissingColumns=True)


def as_of(probes: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "date", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """prep.as_of() for series of any length."""
    kept, both = [c for c in probes.columns if c not in (*keys, time)], stacked(probes, facts, keys, values, time)
    filled = scan(both, keys, time, time_blocks(both, time, rows_per_block), {"_seen": ("ffill", F.col("_fact"))}, ["_p"])
    return filled.filter("_p = 1").select(*keys, time, *[F.col(f"_row.{c}") for c in kept], "_seen.*")


def nearest(probes: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "date", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """prep.nearest() for series of any length: of two facts as near, the earlier."""
    kept, both = [c for c in probes.columns if c not in (*keys, time)], stacked(probes, facts, keys, values, time)
    found = scan(both, keys, time, time_blocks(both, time, rows_per_block), {"_b": ("ffill", F.col("_fact")), "_a": ("bfill", F.col("_fact"))}, ["_p"]).filter("_p = 1")
    gap = (lambda a, b: F.datediff(a, b)) if dict(both.dtypes)[time] == "date" else (lambda a, b: number(a) - number(b))
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if dict(both.dtypes)[time].startswith("timestamp") else F.col(c)
    late = F.col("_b").isNull() | (gap("_a.as_of", time) < gap(time, "_b.as_of"))
    best = F.when(late & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("_near", best).select(*keys, time, *[F.col(f"_row.{c}") for c in kept], "_near.*")
