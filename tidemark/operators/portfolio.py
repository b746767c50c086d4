"""Multi-asset trend and volatility-target portfolio in long form: one row for each asset and day."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .prep import as_of
from .windows import by, cumulative_product, drawdown, ffill, pct_change, rolling, std, upto


def bond_index(yields: DataFrame, duration: float, carry: bool = True, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Total-return index of a constant-maturity bond from its yield in percent: keys, date, value -> keys, date, value."""
    w = by(list(keys), "date")
    rows = yields.select(*keys, "date", ffill(F.col("value"), w).alias("y"))
    rows = rows.select("*", F.lag("y").over(w).alias("before"))
    earned = F.col("before") / 100 / 252 if carry else F.lit(0.0)
    ret = F.coalesce(earned - duration * (F.col("y") - F.col("before")) / 100, F.lit(0.0))
    return rows.select(*keys, "date", "y", ret.alias("r")).select(*keys, "date", F.when(F.col("y").isNotNull(), cumulative_product(1 + F.col("r"), w)).alias("value"))


def price_grid(daily: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Every asset on every date of any: an asset without a price has null there, as windows must see the gap. The assets are given, so
    a date's rows are made where the date is."""
    known = daily.filter(F.col("series_id").isin(*assets))
    each = known.select("date").distinct().select("date", F.explode(F.array(*[F.lit(a) for a in assets])).alias("series_id"))
    return each.join(known, ["date", "series_id"], "left")


def with_multiplier(grid: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Adds to each date the latest risk_multiplier of a table by date; 1 before the first and where it is unknown."""
    one = F.lit(1).alias("_k")
    days = as_of(grid.select("date", one).distinct(), multipliers.select("date", "risk_multiplier", one), ["_k"], ["risk_multiplier"])  # a row a calendar day
    return grid.join(days.select("date", F.coalesce("risk_multiplier", F.lit(1.0)).alias("risk_multiplier")), "date")


def asset_weights(grid: DataFrame, macro: Column, risk_assets: Sequence[str], cap: Column | float = DEFAULT.portfolio_cap, ma_window: int = 200, vol_window: int = 20, target: float = DEFAULT.portfolio_target) -> DataFrame:
    """grid: series_id, date, value, and columns of macro and cap. Adds ret, ma, vol_ann, up and raw_weight; windows need all their values."""
    w = by("series_id", "date")
    rows = grid.withColumns({"ret": pct_change(F.col("value"), w)})
    rows = rolling(rows, "series_id", "date", ma_window, {"ma": ("mean", F.col("value"))}).withColumn("vol_ann", std(F.col("ret"), w, vol_window) * math.sqrt(252))
    rows = rows.withColumn("up", F.coalesce(F.col("value") >= F.col("ma"), F.lit(False)))
    cap = F.lit(cap) if isinstance(cap, (int, float)) else cap
    size = F.when(F.col("up") & (F.col("vol_ann") > 0), F.least(cap, target / F.nullif(F.col("vol_ann"), F.lit(0.0)))).otherwise(0.0)
    scaled = F.when(F.col("series_id").isin(*risk_assets), size * macro).otherwise(size)
    return rows.withColumn("raw_weight", F.greatest(F.lit(0.0), scaled))


def scale_gross(rows: DataFrame, cap: Column | float = DEFAULT.portfolio_cap) -> DataFrame:
    """Scales each date's weights to the cap; adds weight, gross, cash."""
    total = F.sum("raw_weight").over(W.partitionBy("date"))
    cap = F.lit(float(cap)) if isinstance(cap, (int, float)) else cap
    rows = rows.withColumn("weight", F.when(total > cap, F.col("raw_weight") * cap / F.nullif(total, F.lit(0.0))).otherwise(F.col("raw_weight")))
    gross = F.sum("weight").over(W.partitionBy("date"))
    return rows.withColumns({"gross": gross, "cash": 1 - gross})


def fear_overlay(level: Column, trigger: Column, config: EngineConfig = DEFAULT) -> tuple[Column, Column]:
    """Leverage cap and risk multiplier of a fear level; without one, the trigger counts as level 1."""
    lvl = F.coalesce(level, F.when(trigger == 1, 1).otherwise(0))
    cap, mult = F.lit(config.portfolio_cap), F.lit(1.0)
    for i, (tier, c, m) in enumerate(config.fear_tiers):
        hit = lvl >= tier if i == len(config.fear_tiers) - 1 else lvl == tier
        cap, mult = F.when(hit, F.least(F.lit(config.portfolio_cap), F.lit(c))).otherwise(cap), F.when(hit, m).otherwise(mult)
    return cap, mult


def macro_multiplier(state: Column, config: EngineConfig = DEFAULT) -> Column:
    """By state; a state that is not listed counts in full."""
    out = F.lit(1.0)
    for s, m in config.macro.items():
        out = F.when(F.upper(state) == s, m).otherwise(out)
    return out


def backtest(rows: DataFrame, key: str = "portfolio") -> DataFrame:
    """rows: key, series_id, date, weight, ret. Yesterday's weights earn today's returns: key, date, gross, ret, curve, dd."""
    w = by([key, "series_id"], "date")
    lagged = rows.withColumn("held", F.lag("weight", 1, 0.0).over(w))
    daily = lagged.groupBy(key, "date").agg(F.sum("weight").alias("gross"), F.sum(F.col("held") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    w = by(key, "date")
    return daily.withColumn("curve", cumulative_product(1 + F.col("ret"), w)).withColumn("dd", drawdown(F.col("curve"), w))


def metrics(curve: DataFrame, key: str = "portfolio") -> DataFrame:
    """Growth a year, worst drawdown and mean gross exposure of each portfolio."""
    rows = curve.withColumn("peak", F.max("curve").over(upto(by(key, "date"))))
    return rows.groupBy(key).agg(
        (F.pow(F.max_by("curve", "date"), F.lit(252.0) / F.count(F.lit(1))) - 1).alias("cagr"), F.min(F.col("curve") / F.col("peak") - 1).alias("mdd"), F.avg("gross").alias("avg_gross"), F.count(F.lit(1)).alias("n_days")
    )


def basis_1x(rows: DataFrame) -> DataFrame:
    """Shows a portfolio of twofold leverage on a basis of one."""
    return rows.withColumns({"gross": F.col("gross") / 2, "cash": 1 - F.col("gross") / 2, "weight": F.col("weight") / 2})


def top_weights(rows: DataFrame, k: int, keys: Sequence[str] = ("date",)) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("weight"), "series_id")
    return rows.filter("weight > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
