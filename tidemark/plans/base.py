"""Registry of queries, and the mapping of the driver's tables onto the ledger and daily series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB equivalent."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, n: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


def ms_of(ts: Column) -> Column:
    """Epoch milliseconds of a time without zone, read as UTC."""
    return F.unix_date(ts.cast("date")).cast("long") * 86400000 + F.hour(ts) * 3600000 + F.minute(ts) * 60000 + F.floor(F.date_part(F.lit("SECONDS"), ts) * 1000).cast("long")


def orders_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Observations: one series for each order priority."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return prep.daily_last(orders_obs(spark, sf))


def events_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger: event_type is the series, arrival is late by a fixed rule; every tenth row arrives again, later, with another value."""
    e = table(spark, sf, "events")
    base = e.select(
        F.col("event_type").alias("series_id"), ms_of(F.col("ts")).alias("time_utc_ms"), F.lit("1D").alias("interval"), "value",
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))).alias("received_at"), F.col("event_id").alias("seq"), F.col("props").alias("payload_json"),
    )
    again = base.filter("seq % 10 = 0").withColumns({"value": F.col("value") * 2, "received_at": F.col("received_at") + F.make_dt_interval(days=F.lit(1))})
    return base.unionByName(again)


LEDGER_SQL = """base AS (SELECT event_type AS series_id, epoch_us(ts) // 1000 AS time_utc_ms, '1D' AS interval, value, ts + to_hours(CAST(event_id % 7 AS INT)) AS received_at, event_id AS seq, props AS payload_json FROM events),
ledger AS (SELECT * FROM base UNION ALL SELECT series_id, time_utc_ms, interval, value * 2, received_at + INTERVAL 1 DAY, seq, payload_json FROM base WHERE seq % 10 = 0)"""
DAILY_SQL = """obs AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey AS seq FROM orders),
daily AS (SELECT series_id, date, value FROM obs QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY ts DESC, seq DESC) = 1)"""
MONTHLY_SQL = DAILY_SQL + """,
monthly AS (SELECT series_id, last_day(date) AS month_end, arg_max(value, date) AS value FROM daily GROUP BY ALL)"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return prep.monthly_last(daily(spark, sf))


#: Forty years of months, as long windows need them: the order's key picks the month, of a month's orders the last key counts.
LONG_MONTHLY_SQL = DAILY_SQL + """,
monthly AS (SELECT o_orderpriority AS series_id, CAST(last_day(DATE '1962-01-01' + to_months(CAST(o_orderkey % 480 AS INT))) AS DATE) AS month_end, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL)"""


def long_monthly(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    month = F.last_day(F.add_months(F.lit("1962-01-01").cast("date"), (F.col("o_orderkey") % 480).cast("int")))
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("month_end")).agg(F.max_by("o_totalprice", "o_orderkey").alias("value"))
