"""Sinks: idempotent table writes and exports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import num
from .operators.prep import dedupe_lww, merge_rows

#: The exported columns of a state, in order.
STATE_COLUMNS = ("as_of_date", "state", "score", "action", "equity_weight", "trend_signal", "trend_price", "trend_ma", "hard_defcon1", "prev_state", "streak_ge_2", "streak_ge_3_5", "streak_lt_2", "streak_le_3", "T10Y2Y_cross_up", "BAML_spread_risk", "WEI_recession_trend", "COPPER_GOLD_under_ma200", "UMCSENT_low", "triggers")


def replace_days(df: DataFrame, path: str, day: str = "as_of_date") -> None:
    """Replaces the days that df holds and keeps all others."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert_ledger(new: DataFrame, old: DataFrame | None, path: str) -> None:
    """Writes the last write of each key to a new place; the caller then points readers there, so no reader sees half of it."""
    rows = new if old is None else old.unionByName(new)
    dedupe_lww(rows).write.mode("overwrite").parquet(path)


def flat_states(states: DataFrame) -> DataFrame:
    """The 20 columns of the export as text: missing values empty, scores and weights to 3 places, prices to 2."""
    text = lambda c: F.col(c).cast("string")
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    places = {"score": 3, "equity_weight": 3, "trend_price": 2, "trend_ma": 2}
    have = states.columns
    out = []
    for c in STATE_COLUMNS:
        value = F.lit(None).cast("string") if c not in have else F.when(F.col(c).isNotNull(), fixed(c, places[c])) if c in places else F.array_join(c, " | ") if dict(states.dtypes)[c].startswith("array") else F.col(c).cast("int").cast("string") if dict(states.dtypes)[c] == "boolean" else text(c)
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return states.select(*out)


def export_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A sorted CSV with a header. The sort is by range, so the files in order hold the rows in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def export_parquet(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A sorted table that keeps its types, beside the two of text."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def merged_export(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows over those of an earlier export, with its further columns; a column that one side lacks is null there."""
    columns = list(dict.fromkeys([*new.columns, *sorted(set(old.columns) - set(new.columns))]))
    fill = lambda d: d.select(*[F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return merge_rows(fill(new), fill(old), keys)


def recent_portfolio(weights: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Wide text rows of a portfolio: date, gross_exposure, cash_weight, w_<asset> to 6 places."""
    wide = weights.groupBy("date").pivot("series_id", list(assets)).agg(F.max("weight"))
    totals = weights.groupBy("date").agg(F.sum("weight").alias("g"))
    six = lambda c: F.format_string("%.6f", c)
    return totals.join(wide, "date").select("date", six(F.col("g")).alias("gross_exposure"), six(1 - F.col("g")).alias("cash_weight"), *[six(F.coalesce(F.col(f"`{a}`"), F.lit(0.0))).alias(f"w_{a}") for a in assets])


def recent_export(weights: DataFrame, have_state: DataFrame, assets: Sequence[str], old: DataFrame | None, days: int = 30, end=None) -> DataFrame:
    """recent_portfolio() of those of the last `days` days up to end (else the last date) that have a state, over an earlier export.

    A day that is made anew loses all its earlier w_ columns and keeps others; the other days stay. New columns come last, sorted."""
    last = F.lit(end) if end is not None else F.lit(weights.agg(F.max("date")).first()[0])
    new = recent_portfolio(weights.join(have_state.select("date").distinct(), "date", "left_semi").filter((F.col("date") > F.date_sub(last, max(1, days))) & (F.col("date") <= last)), assets)
    if old is None:
        return new
    n, o, made = new.alias("n"), old.alias("o"), F.col("n.date").isNotNull()

    def cell(c: str):
        kept = F.when(~made, F.col(f"o.{c}")) if c.startswith("w_") else F.col(f"o.{c}")
        if c not in old.columns:
            return F.col(f"n.{c}").alias(c)
        return (F.coalesce(f"n.{c}", kept) if c in new.columns else kept).alias(c)

    columns = [*old.columns, *sorted(c for c in new.columns if c not in old.columns)]
    return n.join(o, F.col("n.date") == F.col("o.date"), "full").select(*[cell(c) for c in columns])


def flat_records(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """states: as_of_date, state, score, reasons_json. The export's columns as text, from records of any age: a weight may stand as a
    percentage, streaks under their older names, the hard trigger only among the triggers."""
    at = lambda *paths: F.coalesce(*[F.get_json_object("reasons_json", f"$.{p}") for p in paths])
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    listed = F.from_json(at("triggers"), "array<string>")
    triggers = F.coalesce(F.array_join(F.filter(listed, lambda x: x != ""), " | "), at("triggers"), F.lit(""))
    weight = F.coalesce(num(at("allocation.equity_weight")), num(at("allocation.equity_weight_pct")) / 100)
    hard = F.coalesce(at("hard_defcon1").isin("true", "1"), F.contains(F.lower(triggers), F.lit("hard defcon1")))
    values = {
        "as_of_date": F.col("as_of_date").cast("string"), "state": F.col("state"), "score": F.format_string("%.3f", F.col("score")), "action": at("allocation.action", "action"), "equity_weight": F.when(weight.isNotNull(), F.format_string("%.3f", weight)),
        "trend_signal": at("trend.signal", "trend_signal"), "trend_price": F.format_string("%.2f", num(at("trend.price"))), "trend_ma": F.format_string("%.2f", num(at("trend.ma"))), "hard_defcon1": hard.cast("int"), "prev_state": at("prev_state"),
        "streak_ge_2": at("streaks.streak_ge_2", "streaks.streak_ge_3"), "streak_ge_3_5": at("streaks.streak_ge_3_5", "streaks.streak_ge_5"), "streak_lt_2": at("streaks.streak_lt_2", "streaks.streak_le_2"), "streak_le_3": at("streaks.streak_le_3"),
        **{c: at(f"components.{c}") for c in STATE_COLUMNS[14:19]}, "triggers": triggers,
    }
    known = {"score": F.col("score").isNotNull(), "trend_price": num(at("trend.price")).isNotNull(), "trend_ma": num(at("trend.ma")).isNotNull()}
    return states.select(*keys, *[text(F.when(known[c], values[c]) if c in known else values[c]).alias(c) for c in STATE_COLUMNS])


def backup(spark: SparkSession, path: str, folder: str, at: str | None = None) -> str | None:
    """Copies a table to a path of its own below the folder, named by the time (UTC), and returns that path; None if there is nothing."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(source):
        return None
    at = at or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    name, dot, kind = source.getName().rpartition(".")
    copy = f"{folder.rstrip('/')}/{name}_{at}.{kind}" if dot else f"{folder.rstrip('/')}/{kind}_{at}"
    target = spark._jvm.org.apache.hadoop.fs.Path(copy)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, target.getFileSystem(spark._jsc.hadoopConfiguration()), target, False, spark._jsc.hadoopConfiguration())
    return copy


def export_all(frames: dict[str, tuple[DataFrame, Sequence[str]]], folder: str) -> dict[str, str]:
    """Writes each frame, given with its order, as a sorted CSV below the folder; returns the paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}.csv" for name in frames}
    for name, (df, order) in frames.items():
        export_csv(df, paths[name], order)
    return paths


def message(states: DataFrame, weights: DataFrame, k: int = 6) -> DataFrame:
    """Notification text of each day: state, score, and the k largest weights."""
    top = F.slice(F.sort_array(F.collect_list(F.struct("weight", "series_id")), asc=False), 1, k)
    line = F.array_join(F.transform(top, lambda w: F.format_string("%s %.1f%%", w["series_id"], w["weight"] * 100)), ", ")
    per = weights.filter("weight > 0").groupBy("date").agg(line.alias("line"))
    score = F.when(F.col("score").isNotNull(), F.format_string("%.2f", "score")).otherwise("n/a")
    return states.join(per, "date", "left").select("date", F.concat_ws(" | ", "state", F.concat(F.lit("score "), score), F.coalesce("line", F.lit("no positions"))).alias("text"))
