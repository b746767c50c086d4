"""Queries of the state machine and of bull and bear phases as streams, and of recomputation after late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..operators import score as S
from ..streaming import recompute, states
from ..streaming.folders import shared_folder
from . import market, series, views  # noqa: F401  series has the SQL of the ledger
from .base import ORACLES, events_ledger, ms_of, query, r, table

PIECES = 3


def streamed(rows: DataFrame, key: str, start, name: str) -> str:
    """Feeds rows to a stream in pieces, each a stretch of days whose rows are in no order, and at last a clock row. The stream is stopped after
    each piece and started again from its checkpoint. The folder of its results."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, name)
    rows.withColumn("clock", F.lit(False)).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    piece = F.floor(F.datediff("date", F.lit(first)) * PIECES / (F.datediff(F.lit(last), F.lit(first)) + 1))
    clock = rows.select(key).limit(1).withColumns({"date": F.date_add(F.lit(last), 2), "clock": F.lit(True)})
    for k in range(PIECES + 1):
        part = rows.filter(piece == k).orderBy(F.xxhash64("date")) if k < PIECES else rows.limit(0).unionByName(clock, allowMissingColumns=True)
        part.write.parquet(f"{folder}/source/piece-{k}")
        start(spark, f"{folder}/source", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query(ORACLES["daily_states"])
def daily_states_streamed(spark, sf):
    """The daily states from a stream that is restarted between its pieces."""
    days = S.day_scores(market.sensor_days(spark, sf)).select(F.lit("batch").alias("scenario"), "date", "ready", "raw", "hard", "stale_critical")
    return states.read_states(spark, streamed(days, "scenario", states.start_states, "states-stream")).drop("scenario")


@query(ORACLES["bull_bear"])
def bull_bear_streamed(spark, sf):
    """Bull and bear segments of every series from a stream that is restarted between its pieces."""
    return states.read_phases(spark, streamed(views.closes(spark, sf), "series_id", states.start_phases, "phases-stream"))


def payloads(spark, sf) -> DataFrame:
    """Orders as payload texts: value, and date and late for the choice of a batch. Of a day's orders the last key arrives last, in whichever batch."""
    o = table(spark, sf, "orders")
    at = ms_of(F.col("o_orderdate"))
    fields = {"schema_version": F.lit(1), "source": F.lit("tradingview"), "series_id": F.col("o_orderpriority"), "time_utc": at, "interval": F.lit("1D"), "value": F.col("o_totalprice"), "timenow": at + F.col("o_orderkey")}
    return o.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("value"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 10 == 3).alias("late"))


@query(ORACLES["daily_states"])
def daily_states_late(spark, sf):
    """The daily states from payloads of which one in ten comes in two later batches, each of which changes only what follows from it."""
    folder, rows = shared_folder(spark, "late"), payloads(spark, sf)
    recent = F.col("date") >= F.lit("2001-03-01").cast("date")
    for k, part in enumerate((~F.col("late"), F.col("late") & recent, F.col("late") & ~recent)):
        rows.filter(part).select("value").write.text(f"{folder}/source/piece-{k}")
        query_ = recompute.start_live_states(spark, f"{folder}/source/*", f"{folder}/ledger", f"{folder}/checkpoint", f"{folder}/states", market.SENSORS, derive=market.with_curve)
        query_.awaitTermination()
    return recompute.read_states(spark, f"{folder}/states").drop("scenario", "month")


@query(ORACLES["dedupe_lww"])
def ledger_upsert(spark, sf):
    """The ledger's last writes from a table that three batches are put into, each of which rewrites only the buckets that it touches."""
    rows, root = events_ledger(spark, sf), shared_folder(spark, "ledger-store")
    store.create(spark, root, ", ".join(f"{n} {t}" for n, t in rows.dtypes), ["series_id", "time_utc_ms", "interval"], ["received_at", "seq"], 8)
    for k in range(3):
        store.upsert(spark, root, rows.filter(F.col("seq") % 3 == k))
    return store.read(spark, root).select("series_id", "time_utc_ms", "interval", r("value").alias("value"), "seq")
