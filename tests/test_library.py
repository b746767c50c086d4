"""Unit tests of operators on small tables: closed forms, edge cases, sources, sinks, and the streaming ledger."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.functions import scalars as S
from tidemark.operators import cycles as C
from tidemark.operators import models as M
from tidemark.operators import portfolio as P
from tidemark.operators import prep, score, views, windows
from tidemark.sources import files
from tidemark.streaming import ledger

D = dt.date


def days(n, start=D(2020, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def test_scalars(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14T22:13:20+00:00",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.to_ms(F.col("t"))).collect()] == [1700000000000] * 4 + [None, None]
    raw = '{"time_utc": 2024-01-02T03:04:05Z, "series_id": "a"}'
    got = spark.createDataFrame([(raw,), ("{",), ('{"a": 1}',)], "t string").select(S.loose_json(F.col("t"))).collect()
    assert json.loads(got[0][0])["time_utc"] == "2024-01-02T03:04:05Z" and got[1][0] is None and got[2][0] == '{"a": 1}'
    xs = [-3.0, -0.5, 0.0, 0.7, 2.5]
    erf = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.erf(F.col("x"))).collect()]
    assert np.allclose(erf, [math.erf(x) for x in xs], atol=2e-7)


def test_windows_against_pandas(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(np.where(rng.random(80) < 0.1, np.nan, rng.normal(100, 5, 80)))
    df = prep.nan_to_null(spark.createDataFrame(pd.DataFrame({"series_id": "a", "date": days(80), "value": x})))
    w = windows.by("series_id", "date")
    v = F.col("value")
    got = df.select("date", windows.mean(v, w, 10, 6).alias("m"), windows.std(v, w, 10, 6).alias("s"), windows.median(v, w, 10, 6).alias("d"), windows.ewma_std(v, w, 20, 21).alias("e")).orderBy("date").toPandas()
    roll = x.rolling(10, min_periods=6)
    for name, want in (("m", roll.mean()), ("s", roll.std()), ("d", roll.median())):
        assert np.allclose(got[name].astype(float), want, equal_nan=True)
    tail = x.iloc[59:80].dropna()
    assert math.isclose(got.e.iloc[-1], tail.ewm(span=20).std().iloc[-1], rel_tol=1e-9)


def test_last_write_wins_and_merges(spark):
    rows = [("a", 1, "1D", 1.0, 1, 0), ("a", 1, "1D", 2.0, 3, 0), ("a", 1, "1D", 3.0, 2, 9), ("b", 1, "1D", 4.0, 1, 0)]
    df = spark.createDataFrame(rows, "series_id string, time_utc_ms long, interval string, value double, received_at long, seq long")
    once = prep.dedupe_lww(df)
    assert sorted(r.value for r in once.collect()) == [2.0, 4.0]
    assert sorted(prep.dedupe_lww(once).collect()) == sorted(once.collect())
    a = spark.createDataFrame([(1, None, "n")], "k int, x int, y string")
    b = spark.createDataFrame([(1, 5, "o"), (2, 6, "o")], "k int, x int, y string")
    assert sorted(prep.merge_cells(a, b, ["k"]).collect()) == [(1, 5, "n"), (2, 6, "o")]


def test_as_of_and_nearest_edges(spark):
    probe = spark.createDataFrame([("a", D(2020, 1, d)) for d in (1, 4, 6, 20)], "k string, date date")
    fact = spark.createDataFrame([("a", D(2020, 1, 3), 3), ("a", D(2020, 1, 5), 5), ("a", D(2020, 1, 7), None)], "k string, date date, v int")
    assert [r.v for r in prep.as_of(probe, fact, ["k"], ["v"]).orderBy("date").collect()] == [None, 3, 5, None]
    assert [r.as_of.day for r in prep.nearest(probe, fact, ["k"], ["v"]).orderBy("date").collect()] == [3, 3, 5, 7]


def machine(spark, raws, hard=None, stale=None):
    n = len(raws)
    rows = [("s", d, x is not None, x, bool(hard and i in hard), bool(stale and i in stale)) for i, (d, x) in enumerate(zip(days(n), raws))]
    df = spark.createDataFrame(rows, "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean")
    return score.fold_states(df).orderBy("date").collect()


def test_state_machine(spark):
    assert [r.state for r in machine(spark, [2.0] * 3 + [0.0] * 5)] == ["NORMAL"] * 2 + ["DEFCON2"] * 5 + ["NORMAL"]
    assert machine(spark, [4.0] * 3)[-1].state == "DEFCON1"
    warm = machine(spark, [4.0, 4.0, None, 4.0, 4.0, 4.0])
    assert [r.state for r in warm] == ["NORMAL", "NORMAL", "WARMUP", "NORMAL", "NORMAL", "DEFCON1"]
    held = machine(spark, [2.5, 2.5, 2.5, 0.0, 0.0], stale={3, 4})
    assert held[3].held and held[4].raw_score == 2.5 and held[4].state == "DEFCON2"
    hard = machine(spark, [0.5], hard={0})[0]
    assert (hard.state, hard.score, hard.raw_score) == ("DEFCON1", 3.5, 0.5)


def test_bond_index(spark):
    df = spark.createDataFrame([("y", d, v) for d, v in zip(days(4), [4.0, 4.1, None, 4.05])], "series_id string, date date, value double")
    got = [r.value for r in P.bond_index(df, 8.5).orderBy("date").collect()]
    want = [1.0]
    for a, b in ((4.0, 4.1), (4.1, 4.1), (4.1, 4.05)):
        want.append(want[-1] * (1 + a / 100 / 252 - 8.5 * (b - a) / 100))
    assert np.allclose(got, want)


def test_band_component_is_the_filtered_analytic_signal(spark):
    n = 120
    t = np.arange(n)
    x = np.sin(2 * np.pi * t / 36) + 0.3 * np.cos(2 * np.pi * t / 7) + 0.01 * t
    ends = [D(2000 + i // 12, i % 12 + 1, 28) for i in range(n)]
    df = spark.createDataFrame([("s", d, float(v)) for d, v in zip(ends, x)], "series_id string, month_end date, v double")
    got = C.band_component(df, "v", "w", n, 24, 48).orderBy(F.desc("month_end")).first()
    f = np.fft.fft(x - x.mean())
    k = np.fft.fftfreq(n)
    f[~((k >= 1 / 48) & (k <= 1 / 24))] = 0
    z = (2 * np.fft.ifft(f))[-1]
    assert np.allclose([got.w, got.w_amp], [z.real, abs(z)])


def test_holidays_and_easter(spark):
    years = {2019: D(2019, 4, 21), 2020: D(2020, 4, 12), 2024: D(2024, 3, 31), 2038: D(2038, 4, 25)}
    got = {r[0]: r[1] for r in spark.createDataFrame([(y,) for y in years], "y int").select("y", views.easter(F.col("y"))).collect()}
    assert got == years
    closed = [D(2021, 7, 5), D(2021, 12, 24), D(2021, 12, 31), D(2024, 3, 29), D(2024, 5, 27), D(2024, 11, 28), D(2024, 1, 6)]
    flags = spark.createDataFrame([(d,) for d in [*closed, D(2024, 1, 2)]], "d date").select(views.trading_day(F.col("d"))).collect()
    assert [r[0] for r in flags] == [False] * len(closed) + [True]


def test_month_calendar_counts(spark):
    """Label counts of the published calendar for 2026-02-28, peaks in 60 and 0 months."""
    e = spark.createDataFrame([(D(2026, 2, 28), 60.0, 0.0)], "as_of date, months_until_fear double, months_until_euphoria double")
    rows = C.month_calendar(e).collect()
    count = {k: sum(r.label == k for r in rows) for k in ("EUPH", "NONE", "FEAR")}
    assert (len(rows), count) == (73, {"EUPH": 13, "NONE": 23, "FEAR": 37})
    assert [sum(r[c] for r in rows) for c in ("fear_36m", "fear_24m", "euphoria_36m", "euphoria_24m")] == [37, 25, 13, 13]


def test_next_months_of_each_event_without_a_shuffle(spark):
    """An id that occurs twice has the months of both events, one without a day keeps its rows, and the plan moves none."""
    e = spark.createDataFrame([(1, D(2023, 1, 31)), (1, D(2023, 6, 30)), (2, None)], "id long, as_of date").selectExpr("*", "0D AS months_until_fear", "1D AS months_until_euphoria")
    out = C.next_months(C.month_calendar(e)).select("id", "month_end")
    ends = lambda y, m: [(pd.Period(year=y, month=m, freq="M") + k).end_time.date() for k in range(48)]
    assert sorted(r.month_end for r in out.collect() if r.id == 1) == sorted(ends(2023, 1) + ends(2023, 6))
    assert [r.month_end for r in out.collect() if r.id == 2] == [None] * 48
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_bull_bear_and_gauge(spark):
    values = [100, 110, 120, 96, 90, 108, 120]
    df = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days(7), values)], "series_id string, date date, value double")
    segs = views.bull_bear(df)
    assert [(r.regime, r.days, r.open) for r in segs.orderBy("start", "end").collect()] == [("BULL", 3, False), ("BEAR", 2, False), ("BULL", 1, True)]
    assert views.phase_gauge(segs).first().typical == 252.0


def test_ridge_logit_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] + 0.3)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = M.newton_logits(df.withColumn("k", F.lit(1)), ["k"], ["a", "b"], "y")
    w = np.zeros(3)
    xx = np.column_stack([x, np.ones(400)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-xx @ w))
        g = xx.T @ (p - y) + np.array([w[0], w[1], 0])
        w -= np.linalg.solve(xx.T @ (xx * (p * (1 - p))[:, None]) + np.diag([1, 1, 0]), g)
    assert np.allclose(m[(1,)], [w[2], w[0], w[1]], atol=1e-8)
    assert M.newton_logits(df.limit(10).withColumn("k", F.lit(1)), ["k"], ["a", "b"], "y") == {}


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "series_id string, date date, value double")
    assert views.bull_bear(empty).count() == 0
    assert score.trend(empty).count() == 0
    assert P.bond_index(empty, 2.0).count() == 0
    assert C.detrended(prep.monthly_last(empty)).count() == 0


def test_csv_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,BTCUSD,USDKRW,XAUUSD\n2020-01-01T00:00:00Z,1,2,x\n1577923200,4,,6\n", encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("time,close\n2020-01-01T00:00:00Z,9\n")
    (tmp_path / "c.csv").write_bytes("time,이름\n1577923200,값\n".encode("cp949"))
    wide = files.read_any(spark, str(tmp_path / "a.csv"))
    assert sorted((r.series_id, r.value) for r in wide.collect()) == [("BTCUSD", 1.0), ("BTCUSD", 4.0), ("USDKRW", 2.0), ("XAUUSD", 6.0)]
    assert files.read_any(spark, str(tmp_path / "b.csv"), series="S").first().value == 9.0
    assert files.read_any(spark, str(tmp_path / "b.csv")) is None
    assert files.read_csv(spark, str(tmp_path / "c.csv")).first()[1] == "값"
    assert [r.path.rsplit("/", 1)[1] for r in files.sniff_assets(spark, str(tmp_path)).collect()] == ["a.csv"]
    combined = files.read_combined(spark, {"1D": str(tmp_path / "b.csv")}, {"1D": {"close": "S"}})
    assert combined.first().series_id == "S"


def test_sinks(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([(D(2020, 1, d), v)], "as_of_date date, v int")
    out = str(tmp_path / "t")
    sinks.replace_days(day(1, 1).unionByName(day(2, 2)), out)
    sinks.replace_days(day(2, 5), out)
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [1, 5]
    flat = sinks.flat_states(spark.createDataFrame([(D(2020, 1, 1), "NORMAL", 1.23456, None, ["a", "b"])], "as_of_date date, state string, score double, trend_ma double, triggers array<string>")).first()
    assert (flat.score, flat.trend_ma, flat.triggers, flat.action) == ("1.235", "", "a | b", "")
    new, old = spark.createDataFrame([("d1", "1")], "date string, w_A string"), spark.createDataFrame([("d1", "9", "8"), ("d0", "7", "6")], "date string, w_A string, w_B string")
    assert sorted(map(tuple, sinks.merged_export(new, old, ["date"]).collect())) == [("d0", "7", "6"), ("d1", "1", None)]
    w = spark.createDataFrame([(D(2020, 1, 1), "A", 0.5), (D(2020, 1, 1), "B", 0.25)], "date date, series_id string, weight double")
    assert sinks.recent_portfolio(w, ["A", "B"]).first().w_B == "0.250000"
    s = spark.createDataFrame([(D(2020, 1, 1), "NORMAL", None)], "date date, state string, score double")
    assert sinks.message(s, w).first().text == "NORMAL | score n/a | A 50.0%, B 25.0%"


def test_streaming_ledger(spark, tmp_path):
    """Files out of order, repeated and refused payloads, and a restart, give the ledger that one batch gives."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    line = lambda v, at, **k: json.dumps({"schema_version": 1, "source": "tradingview", "series_id": "a", "interval": "1d", "time_utc": 1700000000, "value": v, "timenow": at} | k)
    (tmp_path / "in" / "1.txt").write_text(line(2, "2024-01-02T00:00:00Z") + "\n" + line(9, "2024-01-01T00:00:00Z", source="other") + "\n{bad\n")
    ledger.start_ledger(spark, src, out, ck, files_per_batch=1).awaitTermination()
    (tmp_path / "in" / "2.txt").write_text(line(1, "2024-01-01T00:00:00Z") + "\n" + line("3.5", "2024-01-01T00:00:00Z", series_id="b") + "\n")
    ledger.start_ledger(spark, src, out, ck, files_per_batch=1).awaitTermination()
    got = sorted((r.series_id, r.value, r.interval) for r in ledger.read_ledger(spark, out).collect())
    assert got == [("A", 2.0, "1D"), ("B", 3.5, "1D")]
    assert sorted(r.reject for r in spark.read.parquet(f"{out}/rejected").collect()) == ["json", "source"]


def test_windowed_counts(spark):
    e = spark.createDataFrame([("a", dt.datetime(2020, 1, 1, h), float(h)) for h in (1, 2, 3)], "series_id string, ts timestamp, value double")
    assert [(r.n, r.total, r.last) for r in ledger.windowed_counts(e).collect()] == [(3, 6.0, 3.0)]


@pytest.mark.parametrize("cap", [2.0])
def test_weights_never_exceed_cap(spark, cap):
    rng = np.random.default_rng(5)
    rows = [(a, d, float(v)) for a in "abc" for d, v in zip(days(60), 100 * np.cumprod(1 + rng.normal(0.01, 0.01, 60)))]
    grid = spark.createDataFrame(rows, "series_id string, date date, value double")
    out = P.scale_gross(P.asset_weights(grid, F.lit(1.0), ["a"], cap, 20, 10), cap).toPandas()
    assert (out.weight >= 0).all() and (out.gross <= cap + 1e-9).all() and np.allclose(out.gross + out.cash, 1)


@pytest.mark.parametrize("n", [48, 60, 200])
def test_long_frames_are_those_read_row_by_row(spark, n, monkeypatch):
    """Also of fewer rows than are put together from blocks otherwise. Series with gaps, shorter than a block, without spread, and without a value at their beginning; large values with a small spread."""
    monkeypatch.setattr(windows, "LONG_FRAME", 48)
    rng, frames = np.random.default_rng(1), []
    for name, size in (("a", 500), ("b", 49), ("c", 3), ("flat", 410), ("late", 300), ("edge", 2 * n)):
        x = rng.normal(1e6, 5, size)
        x[rng.random(size) < 0.1] = np.nan
        if name == "flat":
            x[:] = 3.3
        if name == "late":
            x[:170] = np.nan
        frames.append(pd.DataFrame({"series_id": name, "date": days(size), "value": x}))
    df, v, w = prep.nan_to_null(spark.createDataFrame(pd.concat(frames))).repartition(3), F.col("value"), windows.by("series_id", "date")
    direct = {"m": windows.mean(v, w, n, 20), "s": windows.std(v, w, n), "p": windows.std(v, w, n, 20, True), "zs": windows.zscore(v, w, n, 20, False), "zp": windows.zscore(v, w, n, 20), "total": F.sum(v).over(windows.last_rows(w, n)), "med": windows.median(v, w, n, 20)}
    want = df.select("series_id", "date", *[c.alias(k) for k, c in direct.items()]).orderBy("series_id", "date").toPandas()
    got = windows.rolling(df, "series_id", "date", n, {"m": ("mean", v, 20), "s": ("std", v), "p": ("std_pop", v, 20), "zs": ("z", v, 20), "zp": ("z_pop", v, 20)})
    got = windows.rolling_median(windows.rolling_sums(got, "series_id", "date", n, {"total": v}), "series_id", "date", n, "med", v, 20, block_rows=n + 7)
    assert got.columns == ["series_id", "date", "value", "m", "s", "p", "zs", "zp", "total", "med"]
    got = got.orderBy("series_id", "date").toPandas()
    for k in direct:
        assert np.allclose(got[k].astype(float), want[k].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True), k
    flat = got[got.series_id == "flat"]
    assert set(flat.p.dropna()) == {0.0} and flat.zp.isna().all() and set(flat.m.dropna()) == {3.3}


def test_band_component_slides(spark):
    """The component of each window, computed anew from the window's own values less their mean; values missing at the beginning and between."""
    rng, n, window = np.random.default_rng(3), 300, 60
    x = 5 + np.sin(np.arange(n) / 4) + rng.normal(0, 0.3, n)
    x[:30] = np.nan
    x[rng.random(n) < 0.05] = np.nan
    df = prep.nan_to_null(spark.createDataFrame(pd.DataFrame({"series_id": "a", "month_end": days(n), "value": x})))
    got = C.band_component(df, "value", "wave", window, 10.0, 30.0).orderBy("month_end").toPandas()
    filled, ks = pd.Series(x).ffill().to_numpy(), C.bins(window, 10.0, 30.0)
    for t in range(n):
        own = filled[max(0, t - window + 1) : t + 1]
        if len(own) < window or np.isnan(own).all():
            assert np.isnan(got.wave.astype(float)[t])
            continue
        own = np.nan_to_num(own - np.nanmean(own))
        ages = np.arange(window)[::-1]
        z = 2 / window * sum((own * np.exp(1j * S.TAU * k * ages / window)).sum() for k in ks)
        assert np.allclose([got.wave[t], got.wave_amp[t]], [z.real, abs(z)], atol=1e-9) and np.isclose(np.angle(np.exp(1j * (got.wave_phase[t] - np.angle(z)))), 0, atol=1e-7)


def test_scans_ranges_and_price_files(spark, tmp_path):
    ledger_ = spark.createDataFrame([("a", "1D", 1.0), ("a", "1W", 2.0), ("b", "1D", 3.0), ("", "1D", 4.0)], "series_id string, interval string, value double")
    found = lambda ids, i=None: sorted(r.value for r in files.scan_series(ledger_, ids, i).collect())
    assert found(["a", "", None]) == [1.0, 2.0] and found(["a", "b"], "1D") == [1.0, 3.0] and found([]) == found(["", None]) == found(["nothing"]) == [] and found(["a"], "") == [1.0, 2.0]
    assert [r[0] for r in spark.createDataFrame([("1970-01-02",)], "t string").select(S.to_ms(F.col("t"))).collect()] == [86400000]

    only = spark.createDataFrame([("x", D(2020, 2, 29), "WARMUP"), ("y", D(2021, 5, 1), None), ("y", D(2021, 5, 2), "NORMAL")], "scenario string, date date, state string")
    got = {(r.scenario, r.preset): (r.start, r.end) for r in views.range_presets(only).collect()}
    assert got["x", "default"] == got["x", "1y"] == got["x", "max"] == (D(2020, 2, 29), D(2020, 2, 29))
    assert got["y", "default"] == (D(2021, 5, 2), D(2021, 5, 2)) and got["y", "10y"] == (D(2021, 5, 1), D(2021, 5, 2))
    seen = views.relaxed_pages(only, F.col("date").isNull(), ["NORMAL"], F.lit(None).cast("boolean"), size=1)
    assert {(r.date.day, r.dropped, r.page) for r in seen.collect()} == {(29, 3, 0), (1, 3, 1), (2, 3, 0)}

    (tmp_path / "p.csv").write_text("time,close,XAUUSD_GOLD,US10Y,US02Y,COPPER1,COPPER2\n2020-01-01,1,10,4.0,2.0,7,8\n2020-01-01T12:00:00Z,2,11,4.0,2.0,7,8\nbad,9,9,9,9,9,9\n2020-01-02,3,,4.1,,,8\n")
    rows = {(r.series_id, r.date.day): r.value for r in files.price_matrix(spark, f"{tmp_path}/p.csv", carry=False).collect()}
    assert math.isclose(rows.pop(("UST10Y", 2)), 1 - 8.5 * 0.1 / 100)
    assert rows == {("NASDAQ", 1): 2.0, ("NASDAQ", 2): 3.0, ("GOLD", 1): 11.0, ("COPPER", 1): 7.0, ("UST10Y", 1): 1.0, ("UST2Y", 1): 1.0}
    (tmp_path / "q.csv").write_text("time,open\n2020-01-01,1\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        files.price_matrix(spark, f"{tmp_path}/q.csv")
    sinks.export_parquet(only, f"{tmp_path}/out", ["date"])
    assert spark.read.parquet(f"{tmp_path}/out").dtypes == only.dtypes


@pytest.mark.parametrize("parts", [1, 7])
def test_auc_over_ranges(spark, parts):
    """All rows and rows of groups, with ties, missing values, one class, few rows and a constant probability."""
    rng = np.random.default_rng(6)
    rows = [(g, int(y) if rng.random() > 0.05 else None, round(float(p), 2) if rng.random() > 0.05 else None, k) for g, n in (("a", 400), ("b", 60)) for k, (p, y) in enumerate(zip(rng.random(n), rng.random(n) < 0.4))]
    rows += [("one", 1, 0.1 * k, k) for k in range(20)] + [("few", k % 2, 0.1 * k, k) for k in range(9)] + [("flat", k % 2, 0.5, k) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, y int, p double, t int").repartition(parts)

    def want(found):
        found = sorted((p, t, y) for _, y, p, t in found if y is not None and p is not None)
        pos, ranks = sum(y for *_, y in found), sum(k for k, (*_, y) in enumerate(found) if y)
        if len(found) < 10 or pos in (0, len(found)):
            return None
        return 0.5 if found[0][0] == found[-1][0] else (ranks - pos * (pos - 1) / 2) / (pos * (len(found) - pos))

    got = {r.g: r.auc for r in M.auc(df, "y", "p", "t", ["g"]).collect()}
    assert got == {g: want([r for r in rows if r[0] == g]) for g in ("a", "b", "one", "few", "flat")}
    whole = df.withColumn("t", F.col("t") * 10 + F.when(F.col("g") == "a", 1).when(F.col("g") == "b", 2).when(F.col("g") == "one", 3).when(F.col("g") == "few", 4).otherwise(5))
    shift = {"a": 1, "b": 2, "one": 3, "few": 4, "flat": 5}
    assert M.auc(whole, "y", "p", "t").first().auc == want([(g, y, p, t * 10 + shift[g]) for g, y, p, t in rows])


@pytest.mark.parametrize("block_days", [7, 512])
def test_composed_states_are_those_of_the_fold(spark, block_days):
    rng, rows = np.random.default_rng(12), []
    for name, held in (("calm", False), ("held", True), ("short", False)):
        level = 1.0
        for k in range(3 if name == "short" else 400):
            level = float(np.clip(level + rng.choice([-1, -0.5, 0, 0.5, 1]), 0, 5))
            rows.append((name, D(2019, 1, 1) + dt.timedelta(k), bool(rng.random() > 0.03), None if rng.random() < 0.02 else level, bool(rng.random() < 0.02), bool(held and rng.random() < 0.2)))
    df = spark.createDataFrame(rows, "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean")
    want, got = score.fold_states(df), score.composed_states(df, block_days=block_days)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.filter("held").count() > 0 and {r.state for r in want.filter("scenario = 'calm'").collect()} == {"NORMAL", "DEFCON2", "DEFCON1", "WARMUP"}
