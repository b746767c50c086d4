"""Late data: a batch of the ledger changes some days of some series, and only what follows from them is computed and written again.

The earliest changed day bounds what may differ. To compute a day, each series needs its last rows before it, as many as its longest
window holds; so the input is cut there, and the state machine starts from the stored state of the day before. Of the result, only months
that hold a different row are replaced."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, EngineConfig
from ..operators import prep, score
from .ledger import accepted, start_ledger

STATES = f"date date, {score.STATE_SCHEMA}, scenario string, month string"


def observed_at() -> Column:
    return F.to_timestamp_ntz(F.timestamp_millis("time_utc_ms").cast("string"))


def batch_days(ledger: DataFrame, n: int, tz: str = "UTC") -> DataFrame:
    """The ledger's rows up to batch n as series_id, date, value, the last of each local day; `old`, which the day had before batch n, null if none; and
    `touched`, whether batch n has rows of it. Accepted rows have a value.

    Rows are summed to the last write of each time, before and with batch n at once, and only then moved: what passes the shuffle follows the series' times,
    however often these were written, and no payload passes it."""
    order, before = F.struct("received_at", "batch", "seq"), F.col("batch") < n
    value = F.max_by("value", order).alias("value")
    old = F.max_by("value", F.when(before, order)).alias("old")
    times = ledger.filter(F.col("batch") <= n).groupBy("series_id", "time_utc_ms", "interval").agg(value, old, F.max(~before).alias("touched"))
    at = F.struct("time_utc_ms", "interval")
    days = times.groupBy("series_id", prep.local_date(observed_at(), tz).alias("date"))
    return days.agg(F.max_by("value", at).alias("value"), F.max_by("old", F.when(F.col("old").isNotNull(), at)).alias("old"), F.max("touched").alias("touched"))


def reach(ma_window: int = 200, back: int = 20) -> int:
    """Rows of a series that a sensor's features of one row look at: five averages in a row, and the slope."""
    return max(ma_window + 4, back + 1)


def within_reach(daily: DataFrame, day: datetime.date, rows: int) -> DataFrame:
    """Each series from a day on, with its last `rows` rows before, and `earlier`, the number of values further back that are left out."""
    old = daily.filter(F.col("date") < F.lit(day))
    near = old.withColumn("_n", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("date")))).filter(F.col("_n") <= rows).drop("_n")
    counts = old.groupBy("series_id").agg(F.count("value").alias("_all")).join(near.groupBy("series_id").agg(F.count("value").alias("_near")), "series_id")
    kept = near.unionByName(daily.filter(F.col("date") >= F.lit(day)))
    return kept.join(counts.select("series_id", (F.col("_all") - F.col("_near")).alias("earlier")), "series_id", "left").withColumn("earlier", F.coalesce("earlier", F.lit(0)))


def suffix_scores(daily: DataFrame, sensors: Sequence[score.Sensor], first: datetime.date, last: datetime.date, config: EngineConfig = DEFAULT, ma_window: int = 200, back: int = 20) -> DataFrame:
    """score.day_scores() of the days from first to last, from the rows within reach of first."""
    rows = within_reach(daily.filter(F.col("series_id").isin(*[s.series_id for s in sensors])), first, reach(ma_window, back))
    days = prep.calendar(daily.sparkSession.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last")))
    seen = score.sensor_days(days, rows.drop("earlier"), sensors, config, ma_window=ma_window, back=back)
    earlier = rows.groupBy("series_id").agg(F.max("earlier").alias("earlier"))
    seen = seen.join(earlier, "series_id", "left").withColumn("have", F.col("have") + F.coalesce("earlier", F.lit(0))).drop("earlier")
    return score.day_scores(seen, config)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The stored states, none if nothing is stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STATES)
    return spark.read.schema(STATES).parquet(path)


def replace_states(path: str, new: DataFrame, first: datetime.date, scenario: str) -> list[str]:
    """Puts a scenario's new states, of all days from first on, in place of the stored ones, and returns the months that were written.

    new must not depend on files that this replaces in another way than by reading them: a month's files change when all of its rows are written.
    A month without a different row stays as it is; so a run that failed and is repeated ends in the same rows."""
    spark = new.sparkSession
    new = new.withColumns({"scenario": F.lit(scenario), "month": month_of(F.col("date"))}).persist()
    start = first.strftime("%Y-%m")
    stored = read_states(spark, path).filter((F.col("scenario") == scenario) & (F.col("month") >= start))
    kept, old = stored.filter(F.col("date") < F.lit(first)), stored.filter(F.col("date") >= F.lit(first))
    values = [x.split()[0] for x in score.STATE_SCHEMA.split(", ")]
    a, b = new.select("date", "month", F.struct(*values).alias("new")), old.select("date", "month", F.struct(*values).alias("old"))
    months = [r.month for r in a.join(b, ["date", "month"], "full").filter(~F.col("new").eqNullSafe(F.col("old"))).select("month").distinct().collect()]  # a row a month
    if months:
        rows = new.unionByName(kept).filter(F.col("month").isin(*months)).repartition("month")
        rows.sortWithinPartitions("month", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario", "month").parquet(path)
    new.unpersist()
    return sorted(months)


def apply_batch(spark: SparkSession, out: str, n: int, states: str, sensors: Sequence[score.Sensor], scenario: str = "batch", derive: Callable[[DataFrame], DataFrame] | None = None, config: EngineConfig = DEFAULT, ma_window: int = 200, back: int = 20, tz: str = "UTC") -> tuple[datetime.date | None, list[str]]:
    """Brings the stored states up to date with batch n of the ledger under out: the first day computed again, None if none, and the months written.

    derive: further series made of a day's values (series_id, date, value in and out). Days before the first change are neither computed nor written;
    days after the last stored one are always computed. Days that the ledger lost all values of do not occur: it only takes rows in."""
    days = batch_days(accepted(spark, out), n, tz).persist()  # a row a series and day
    try:
        changed = F.col("touched") & ~F.col("value").eqNullSafe(F.col("old"))  # a value that is sent again is no change
        first, start, last = days.agg(F.min(F.when(changed, F.col("date"))), F.min("date"), F.max("date")).first()
        stored = read_states(spark, states).filter(F.col("scenario") == scenario)
        known = stored.agg(F.max("date")).first()[0]
        if last is None or first is None and known is not None and known >= last:
            return None, []
        first = min(x for x in (first, start if known is None else known + datetime.timedelta(days=1)) if x is not None)
        now = days.select("series_id", "date", "value")
        daily = derive(now) if derive else now
        scores = suffix_scores(daily, sensors, first, last, config, ma_window, back).withColumn("scenario", F.lit(scenario))
        seed = stored.filter(F.col("date") == F.lit(first - datetime.timedelta(days=1)))
        new = score.resume_states(scores, seed, config=config).drop("scenario")
        return first, replace_states(states, new, first, scenario)
    finally:
        days.unpersist()


def start_live_states(spark: SparkSession, source: str, out: str, checkpoint: str, states: str, sensors: Sequence[score.Sensor], seen: Callable | None = None, **options) -> StreamingQuery:
    """ledger.start_ledger(), and after each batch apply_batch(): late payloads of any age change the states that follow from them. seen gets each result."""

    def then(n: int) -> None:
        found = apply_batch(spark, out, n, states, sensors, **options)
        if seen:
            seen(n, *found)

    return start_ledger(spark, source, out, checkpoint, then=then)
