"""Window operators over one series in time order. Frames are trailing and counted in rows; a value is null until enough
values that are not null lie in its frame. All of one call share a specification, so Spark sorts once.

A frame of many rows is not read anew for every row: rolling() and rolling_sums() cut a series into blocks as long as the frame, so that a
frame is the end of one block and the beginning of the next. Each row then costs the same, however long the frame."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by(keys: Sequence[str] | str, *order: str) -> WindowSpec:
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def enough(value: Column, x: Column, w: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(w) >= least, value)


def mean(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = last_rows(w, n)
    return enough(F.avg(x).over(f), x, f, least or n)


def std(x: Column, w: WindowSpec, n: int, least: int | None = None, population: bool = False) -> Column:
    f = last_rows(w, n)
    return enough((F.stddev_pop if population else F.stddev_samp)(x).over(f), x, f, least or n)


def zscore(x: Column, w: WindowSpec, n: int, least: int | None = None, population: bool = True) -> Column:
    """A frame without spread gives null."""
    s = std(x, w, n, least, population)
    return (x - mean(x, w, n, least)) / F.nullif(s, F.lit(0.0))


def median(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = last_rows(w, n)
    return enough(F.percentile(x, F.lit(0.5)).over(f), x, f, least or n)


#: Frames of at least so many rows are put together from blocks; below, reading them anew is measured to be the faster way.
LONG_FRAME = 400


def _by_blocks(df: DataFrame, keys: Sequence[str], order: str, n: int) -> tuple[DataFrame, WindowSpec, WindowSpec, WindowSpec, WindowSpec]:
    """df with _rn and _blk; the frames of a row's block up to the row, of the whole block, and from the row on; the series in order."""
    rows = df.withColumn("_rn", F.row_number().over(by(keys, order))).withColumn("_blk", F.floor((F.col("_rn") - 1) / n))
    block = W.partitionBy(*keys, "_blk")
    return rows, upto(block.orderBy("_rn")), block.orderBy("_rn").rowsBetween(W.unboundedPreceding, W.unboundedFollowing), upto(block.orderBy(F.desc("_rn"))), by(keys, "_rn")


def rolling_sums(df: DataFrame, keys: Sequence[str] | str, order: str, n: int, sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over the last n rows, nulls left out; null without a value. Sums are only added up, so nothing cancels."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows, up, _, down, series = _by_blocks(df.withColumns({f"_x_{c}": x for c, x in sums.items()}), keys, order, n)
    rows = rows.withColumns({f"_u_{c}": F.sum(f"_x_{c}").over(up) for c in sums})
    rows = rows.withColumns({f"_d_{c}": F.sum(f"_x_{c}").over(down) for c in sums})
    split = F.col("_rn") % n != 0  # else the frame is the row's own block
    before = {c: F.when(split, F.lag(f"_d_{c}", n - 1).over(series)) for c in sums}
    rows = rows.withColumns({c: F.coalesce(F.col(f"_u_{c}") + b, F.col(f"_u_{c}"), b) for c, b in before.items()})
    return rows.drop("_rn", "_blk", *[f"_{k}_{c}" for c in sums for k in "xud"])


def rolling(df: DataFrame, keys: Sequence[str] | str, order: str, n: int, stats: dict[str, tuple]) -> DataFrame:
    """Adds means, deviations and z-scores over the last n rows. stats: name -> (kind, column) or (kind, column, least); kind is mean, std, std_pop,
    z or z_pop. The same values as mean(), std() and zscore(), in time that does not depend on n.

    Blocks hold count, mean and summed squares of differences to a value of their own; two parts are put together by their means' distance,
    so nothing cancels, and a frame without spread has a deviation of exactly 0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if n < LONG_FRAME:
        w, make = by(keys, order), {"mean": lambda x, w, m: mean(x, w, n, m), "std": lambda x, w, m: std(x, w, n, m), "std_pop": lambda x, w, m: std(x, w, n, m, True), "z": lambda x, w, m: zscore(x, w, n, m, False), "z_pop": lambda x, w, m: zscore(x, w, n, m)}
        return df.withColumns({name: make[kind](x, w, least[0] if least else n) for name, (kind, x, *least) in stats.items()})
    c = F.col
    rows, up, whole, down, series = _by_blocks(df.withColumns({f"_x_{k}": x.cast("double") for k, (_, x, *_) in stats.items()}), keys, order, n)
    rows = rows.withColumns({f"_r_{k}": F.first(f"_x_{k}", ignorenulls=True).over(whole) for k in stats})
    rows = rows.withColumns({f"_y_{k}": c(f"_x_{k}") - c(f"_r_{k}") for k in stats})
    parts = {"n": F.count, "m": F.avg, "v": F.var_pop}
    need = {k: ("n", "m") if stats[k][0] == "mean" else tuple(parts) for k in stats}
    rows = rows.withColumns({f"_u{p}_{k}": parts[p](f"_y_{k}").over(up) for k in stats for p in need[k]})
    rows = rows.withColumns({f"_d{p}_{k}": parts[p](f"_y_{k}").over(down) for k in stats for p in need[k]})
    split = c("_rn") % n != 0  # else the frame is the row's own block
    rows = rows.withColumns({f"_b{p}_{k}": F.when(split, F.lag(f"_{'d' if p != 'r' else ''}{p}_{k}", n - 1).over(series)) for k in stats for p in (*need[k], "r")})
    out = {}
    for k, (kind, _, *least) in stats.items():
        n1, n2 = F.coalesce(c(f"_un_{k}"), F.lit(0)).cast("double"), F.coalesce(c(f"_bn_{k}"), F.lit(0)).cast("double")
        both, apart = n1 + n2, (c(f"_br_{k}") - c(f"_r_{k}")) + (c(f"_bm_{k}") - c(f"_um_{k}"))
        of = lambda v1, v2, v: F.when(n2 == 0, v1).when(n1 == 0, v2).otherwise(v)
        mean_ = of(c(f"_r_{k}") + c(f"_um_{k}"), c(f"_br_{k}") + c(f"_bm_{k}"), c(f"_r_{k}") + c(f"_um_{k}") + apart * n2 / both)
        value = mean_
        if kind != "mean":
            squares = of(c(f"_uv_{k}") * n1, c(f"_bv_{k}") * n2, c(f"_uv_{k}") * n1 + c(f"_bv_{k}") * n2 + apart * apart * n1 * n2 / both)
            spread = F.sqrt(squares / (both if kind.endswith("pop") else F.nullif(both - 1, F.lit(0.0))))
            value = (c(f"_x_{k}") - mean_) / F.nullif(spread, F.lit(0.0)) if kind[0] == "z" else spread
        out[k] = F.when(both >= (least[0] if least else n), value)
    rows = rows.withColumns({f"_o_{k}": x for k, x in out.items()}).withColumns({k: c(f"_o_{k}") for k in out})
    return rows.drop("_rn", "_blk", *[f"_{p}_{k}" for k in stats for p in ("x", "r", "y", "br", "o", *[a + b for a in "udb" for b in parts])])


def rolling_median(df: DataFrame, keys: Sequence[str] | str, order: str, n: int, name: str, x: Column, least: int | None = None, block_rows: int = 1 << 16) -> DataFrame:
    """Adds the median of the last n rows: median(), from a sorted structure that takes in one value and lets go of one with each row.

    A series is cut into blocks of block_rows rows, each with the n - 1 rows before it, so no task holds a whole series."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    block_rows = max(block_rows, n)
    rows = df.withColumns({"_x": x.cast("double"), "_rn": F.row_number().over(by(keys, order)) - 1}).withColumn("_blk", F.floor(F.col("_rn") / block_rows).cast("long"))
    next_too = F.col("_rn") % block_rows > block_rows - n
    dealt = rows.withColumn("_for", F.explode(F.when(next_too, F.array("_blk", F.col("_blk") + 1)).otherwise(F.array("_blk"))))
    out = [*df.columns, name]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_rn")
        found = pd.Series(t["_x"].to_pandas(), dtype=float).rolling(n, min_periods=least or n).median()
        t = t.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
        return t.filter(pc.equal(t["_blk"], t["_for"])).select(out)

    schema = df.schema.add(name, "double")
    return dealt.groupBy(*keys, "_for").applyInArrow(run, schema)


def diff(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def pct_change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x / F.nullif(F.lag(x, n).over(w), F.lit(0.0)) - 1


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(upto(w))


def ewma_std(x: Column, w: WindowSpec, span: int = 20, n: int = 21) -> Column:
    """Bias-corrected exponentially weighted deviation of the last n values; null with fewer than two.

    One pass over the frame from its oldest value, which decays all sums by each newer one; nulls are not collected."""
    decay = 1 - 2 / (span + 1)
    xs, zero = F.collect_list(x).over(last_rows(w, n)), F.lit(0.0)
    step = lambda a, v: F.struct((a["w"] * decay + 1).alias("w"), (a["w2"] * decay**2 + 1).alias("w2"), (a["x"] * decay + v).alias("x"), (a["xx"] * decay + v * v).alias("xx"), (a["n"] + 1).alias("n"))

    def finish(a: Column) -> Column:
        mean_ = a["x"] / a["w"]
        variance = (a["xx"] / a["w"] - mean_ * mean_) * a["w"] * a["w"] / F.nullif(a["w"] * a["w"] - a["w2"], zero)
        return F.when(a["n"] >= 2, F.sqrt(F.greatest(variance, zero)))

    return F.aggregate(xs, F.struct(zero.alias("w"), zero.alias("w2"), zero.alias("x"), zero.alias("xx"), F.lit(0).alias("n")), step, finish)


def cumulative_product(x: Column, w: WindowSpec) -> Column:
    return F.product(x).over(upto(w))


def drawdown(x: Column, w: WindowSpec) -> Column:
    return x / F.max(x).over(upto(w)) - 1


def with_streak(df: DataFrame, flag: Column, keys, order: str, name: str) -> DataFrame:
    """Rows in a row, up to each, whose flag is true; null breaks."""
    w = by(keys, order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.when(~F.coalesce(flag, F.lit(False)), F.col("_n")))
    return df.withColumn(name, F.col("_n") - F.coalesce(F.max("_b").over(upto(w)), F.lit(0))).drop("_n", "_b")


def all_of_last(flag: Column, w: WindowSpec, n: int) -> Column:
    """True when the last n rows exist and all hold."""
    f = last_rows(w, n)
    return (F.count(F.lit(1)).over(f) == n) & (F.min(F.coalesce(flag, F.lit(False)).cast("int")).over(f) == 1)


def cross_up(x: Column, w: WindowSpec) -> Column:
    return F.coalesce((F.lag(x).over(w) < 0) & (x >= 0), F.lit(False))


def slope(x: Column, w: WindowSpec, n: int = 20) -> Column:
    """x less its value n rows ago, or less the first with fewer rows."""
    return x - F.coalesce(F.lag(x, n).over(w), F.first(x).over(upto(w)))


def islands(df: DataFrame, value: str, keys, order: str, name: str = "run") -> DataFrame:
    """Numbers the runs of equal values within each key."""
    w = by(keys, order)
    changed = df.withColumn("_c", (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    return changed.withColumn(name, F.sum(F.col("_c").cast("int")).over(upto(w))).drop("_c")


def downsample(df: DataFrame, keys, order: str, points: int) -> DataFrame:
    """Every k-th row of each key, k so that at most about `points` stay."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    k = F.greatest(F.lit(1), F.ceil(n / points))
    return df.withColumn("_k", k).withColumn("_n", F.row_number().over(by(keys, order))).filter((F.col("_n") - 1) % F.col("_k") == 0).drop("_k", "_n")
