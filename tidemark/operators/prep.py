"""Preparation of observations: last-write-wins, daily and monthly last values, pivots, merges, calendars, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import by, ffill


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def dedupe_lww(ledger: DataFrame, keys: Sequence[str] = ("series_id", "time_utc_ms", "interval"), order: Sequence[str] = ("received_at", "seq")) -> DataFrame:
    """The row of each key written last: one shuffle, summed before it."""
    rest = [c for c in ledger.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return ledger.groupBy(*keys).agg(best).select(*keys, "row.*").select(*ledger.columns)


def local_date(ts: Column, tz: str = "UTC") -> Column:
    """Calendar day in a zone of a time without zone that is UTC."""
    if tz == "UTC":
        return ts.cast("date")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz")).cast("date")


def daily_last(obs: DataFrame, tz: str = "UTC") -> DataFrame:
    """obs: series_id, ts, value, seq. The last value of each series and day."""
    return obs.groupBy("series_id", local_date(F.col("ts"), tz).alias("date")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))


def monthly_last(daily: DataFrame) -> DataFrame:
    """The last value of each series and month, by month end; months without one are left out."""
    found = daily.filter(F.col("value").isNotNull())
    return found.groupBy("series_id", F.last_day("date").alias("month_end")).agg(F.max_by("value", "date").alias("value"))


def pivot_wide(daily: DataFrame, ids: Sequence[str], order: str | None = None) -> DataFrame:
    """One row a date, one column a series; ids are given, so the plan needs no extra pass. Of several values of a series and date
    the last by `order` counts; without one daily must hold a single value."""
    value = F.max("value") if order is None else F.max_by("value", order)
    return daily.groupBy("date").pivot("series_id", list(ids)).agg(value)


def without_test_rows(ledger: DataFrame, series: str, value: float) -> DataFrame:
    """Leaves out a series' rows that hold exactly the value of a test; a null value stays."""
    return ledger.filter(~F.coalesce((F.col("series_id") == series) & (F.col("value") == value), F.lit(False)))


def future_rows(ledger: DataFrame, now_ms: Column | int, n: int = 5, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Of each series the n latest rows that are dated after now."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    w = W.partitionBy(*keys).orderBy(F.desc("time_utc_ms"), F.desc("seq"))
    return ledger.filter(F.col("time_utc_ms") > now).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def unpivot_long(wide: DataFrame, ids: Sequence[str]) -> DataFrame:
    return wide.unpivot(["date"], list(ids), "series_id", "value").filter(F.col("value").isNotNull())


def alias_merge(wide: DataFrame, name: str, alias: str) -> DataFrame:
    return wide.withColumn(name, F.coalesce(name, alias)).drop(alias)


def ratio_fill(wide: DataFrame, ratio: str, top: str, bottom: str) -> DataFrame:
    return wide.withColumn(ratio, F.coalesce(F.col(ratio), F.col(top) / F.nullif(F.col(bottom), F.lit(0.0))))


def calendar(bounds: DataFrame, first: str = "first", last: str = "last", step: str = "1 day") -> DataFrame:
    """Dates from first to last of each row of bounds, with its other columns."""
    rest = [c for c in bounds.columns if c not in (first, last)]
    days = F.explode(F.sequence(F.col(first), F.col(last), F.expr(f"interval {step}"))).alias("date")
    return bounds.select(*rest, days)


def as_of(probes: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "date") -> DataFrame:
    """Adds to each probe the values of the latest fact at or before its time, and the fact's time as `as_of`.

    Both sides are stacked and read in time order: one shuffle and sort by key, however long the gaps."""
    kept = [c for c in probes.columns if c not in (*keys, time)]
    left = probes.select(*keys, time, F.lit(1).alias("_p"), F.struct(*[F.col(c) for c in kept], F.lit(1).alias("_")).alias("_row"))
    right = facts.select(*keys, time, F.lit(0).alias("_p"), F.struct(F.col(time).alias("as_of"), *values).alias("_fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    filled = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(by(keys, time, "_p").rowsBetween(W.unboundedPreceding, 0)))
    return filled.filter("_p = 1").select(*keys, time, *[F.col(f"_row.{c}") for c in kept], "_fact.*")


def nearest(probes: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "date") -> DataFrame:
    """As as_of(), with the nearest fact in either direction; of two as near, the earlier."""
    kept = [c for c in probes.columns if c not in (*keys, time)]
    left = probes.select(*keys, time, F.lit(1).alias("_p"), F.struct(*[F.col(c) for c in kept], F.lit(1).alias("_")).alias("_row"))
    right = facts.select(*keys, time, F.lit(0).alias("_p"), F.struct(F.col(time).alias("as_of"), *values).alias("_fact"))
    both, w = left.unionByName(right, allowMissingColumns=True), by(keys, time, "_p")
    before = F.last("_fact", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_fact", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    both = both.select("*", before.alias("_b"), after.alias("_a")).filter("_p = 1")
    late = F.col("_b").isNull() | (F.datediff(F.col("_a.as_of"), F.col(time)) < F.datediff(F.col(time), F.col("_b.as_of")))
    best = F.when(late & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_fact", best).select(*keys, time, *[F.col(f"_row.{c}") for c in kept], "_fact.*")


def left_ffill(frame: DataFrame, states: DataFrame, keys: Sequence[str], value: str, default: str, time: str = "date") -> DataFrame:
    """Left equi-join, then the last known value, then the default."""
    joined = frame.join(states.select(*keys, time, value), [*keys, time], "left")
    return joined.withColumn(value, F.coalesce(ffill(F.col(value), by(keys, time)), F.lit(default)))


def merge_rows(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; of one key the new row."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def merge_cells(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; in one key each cell of new that is not null, else of old."""
    rest = [c for c in new.columns if c not in keys]
    n, o = new.alias("n"), old.alias("o")
    joined = n.join(o, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "full")
    return joined.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def first_candidate(daily: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates: asset, series_id, priority. Each asset's series of the best priority that exists; a small dimension table."""
    known = daily.select("series_id").distinct().join(candidates, "series_id")
    pick = known.groupBy("asset").agg(F.min_by("series_id", "priority").alias("series_id"))
    return daily.join(pick, "series_id")


def contiguity(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, first, last and whether no day is missing."""
    grouped = days.groupBy(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("contiguous", F.datediff("last_date", "first_date") + 1 == F.col("n_days"))
