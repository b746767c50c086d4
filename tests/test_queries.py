"""Every query with an oracle against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_entry_has_every_query(spark):
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == QUERIES["daily_states"](spark, SF).columns


def test_fear_calendar_all_has_every_order(spark):
    got = {r.id: r["count"] for r in QUERIES["fear_calendar_all"](spark, SF).groupBy("id").count().collect()}
    assert got == {r.o_orderkey: 73 for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}


@pytest.mark.parametrize("name", ["asof_join_all", "nearest_join_all"])
def test_joins_probe_every_series_and_day(spark, name):
    first, last = QUERIES["daily_last"](spark, SF).selectExpr("min(date)", "max(date)").first()
    got = {r.series_id: r["count"] for r in QUERIES[name](spark, SF).groupBy("series_id").count().collect()}
    series = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderpriority").distinct().collect()]
    assert got == {s: (last - first).days + 1 for s in series}


def test_logit_probs_has_every_series(spark):
    """On the smallest tables series have under 300 labels, on the next all have more."""
    for sf, status in ((SF, "WARMUP"), ("/root/testdata/sf0.01", "OK")):
        got = QUERIES["logit_probs"](spark, sf).select("series_id", "date", "status", "p").collect()
        want = QUERIES["daily_last"](spark, sf).select("series_id", "date").collect()
        assert sorted((r.series_id, r.date) for r in got) == sorted(map(tuple, want))
        assert all(r.status == status and (r.p is None) == (status == "WARMUP") for r in got)
