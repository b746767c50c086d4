"""Forecasts, exports, jobs and sources against brute force and on edge cases."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import sinks
from tidemark.config import EngineConfig
from tidemark.functions import scalars as S
from tidemark.operators import cycles as C
from tidemark.operators import models as M
from tidemark.operators import portfolio as P
from tidemark.operators import prep, score, views, windows
from tidemark.sources import files
from tidemark.streaming import jobs

D = dt.date


def days(n, start=D(2020, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def newton(x, y, l2=1.0):
    x = np.column_stack([np.ones(len(x)), x])
    b, ridge = np.zeros(x.shape[1]), np.array([0.0, *[l2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
    return b


def test_forecast_matches_its_parts(spark):
    """Nine features, three horizons, two labels; the longest horizon has too few labels."""
    rng, n = np.random.default_rng(4), 900
    x = rng.normal(size=(n, 9))
    x[rng.random((n, 9)) < 0.1] = np.nan
    crisis = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) > 0.3).astype(int)
    euphoria = (np.nan_to_num(x[:, 1]) > 1).astype(int)
    names = [f"f{i}" for i in range(9)]
    rows = [(d, *[None if np.isnan(v) else float(v) for v in r], int(c), int(e)) for d, r, c, e in zip(days(n), x, crisis, euphoria)]
    df = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in names) + ", crisis int, euphoria int")
    horizons = {"a": 5, "b": 350, "c": 700}
    got = M.forecast(df, names, horizons).orderBy("date").collect()
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    scaled = (filled - filled.mean(0)) / filled.std(0)
    for t, y in (("crisis", crisis), ("euphoria", euphoria)):
        for k, h in horizons.items():
            if n - h < 300:
                assert all(r[f"p_{t}_{k}"] is None and r[f"auc_val_{t}_{k}"] is None and r[f"net_{k}"] is None for r in got)
                continue
            b = newton(scaled[: n - h], y[h:])
            p = 1 / (1 + np.exp(-(b[0] + scaled @ b[1:])))
            assert np.allclose([r[f"p_{t}_{k}"] for r in got], p, atol=1e-9)
            if n - h > 500:
                order = np.argsort(p[: n - h][-1260:], kind="stable")
                last = y[h:][-1260:]
                rank = np.empty(len(order))
                rank[order] = np.arange(len(order))
                pos = last.sum()
                area = (rank[last == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(last) - pos))
                assert got[0][f"auc_val_{t}_{k}"] == pytest.approx(area, abs=1e-9) and got[0][f"conf_{t}_{k}"] == pytest.approx(min(1, max(0, (area - 0.5) / 0.5)), abs=1e-9)
            else:
                assert got[0][f"conf_{t}_{k}"] is None
    assert got[3].net_a == pytest.approx(got[3].p_euphoria_a - got[3].p_crisis_a) and got[0].status == "OK" and got[0].euphoria_rule
    assert {r.status for r in M.forecast(df.limit(100), names, horizons).collect()} == {"WARMUP"}
    assert {r.status for r in M.forecast(df.limit(10), [], horizons).collect()} == {"NO_FEATURES"}


def test_standardised_by_key_and_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("c", None)], "k string, x double")
    got = {k: sorted(round(r.x, 6) for r in M.standardised(df, ["x"], ["k"]).collect() if r.k == k) for k in "abc"}
    assert got == {"a": [-1.224745, 0.0, 1.224745], "b": [0.0, 0.0], "c": [0.0]}


def test_calendar_file_has_a_header_and_only_known_events(spark):
    df = spark.createDataFrame([(D(2024, 1, 31), 30.0, None), (D(2024, 1, 31), -1.0, None), (D(2024, 1, 31), 2.5, 40.0)], "as_of date, months_until_fear double, months_until_euphoria double")
    texts = [r.ics for r in C.calendar_file(df).collect()]
    assert [t.count("BEGIN:VEVENT") for t in texts] == [3, 0, 6]
    assert all(t.startswith("BEGIN:VCALENDAR\nVERSION:2.0\nPRODID:") and t.endswith("END:VCALENDAR\n") for t in texts)
    assert "UID:fear-peak@tidemark\nDTSTART;VALUE=DATE:20260701\nDTEND;VALUE=DATE:20260702\nSUMMARY:FEAR peak (cycle forecast)" in texts[0]
    assert "UID:fear-peak@tidemark\nDTSTART;VALUE=DATE:20240301" in texts[2]  # half a month rounds to even


def test_recent_export_and_backup(spark, tmp_path):
    weights = spark.createDataFrame([(d, a, w) for d in days(5) for a, w in (("A", 0.5), ("B", 0.25))], "date date, series_id string, weight double")
    states = spark.createDataFrame([(d,) for d in days(5) if d.day != 4], "date date")
    old = spark.createDataFrame([(d, "s", "9", "9", "9") for d in days(6)], "date date, state string, gross_exposure string, w_A string, w_old string")
    got = {r.date.day: r for r in sinks.recent_export(weights, states, ["A", "B"], old, days=3).collect()}
    assert sinks.recent_export(weights, states, ["A", "B"], old, days=3).columns == ["date", "state", "gross_exposure", "w_A", "w_old", "cash_weight", "w_B"]
    assert tuple(got[5]) == (D(2020, 1, 5), "s", "0.750000", "0.500000", None, "0.250000", "0.250000")
    assert tuple(got[4])[2:5] == ("9", "9", "9") and tuple(got[2])[2:5] == ("9", "9", "9") and got[3].w_old is None and len(got) == 6
    assert sinks.recent_export(weights, states, ["A"], None, days=1).count() == 1
    path = str(tmp_path / "out" / "states.csv")
    assert sinks.backup(spark, path, str(tmp_path / "backups")) is None
    sinks.export_all({"states": (old, ["date"])}, str(tmp_path / "out"))
    copy = sinks.backup(spark, path, str(tmp_path / "backups"), "20240101_000000")
    assert copy.endswith("/states_20240101_000000.csv") and spark.read.csv(copy, header=True).count() == 6


def test_flat_records_of_any_age(spark):
    records = [None, "broken", "[]", json.dumps({"triggers": ["a", "", "Hard DEFCON1"], "hard_defcon1": None, "allocation": {"equity_weight": "", "equity_weight_pct": 40}, "streaks": {"streak_ge_3": 2, "streak_le_2": 7}, "trend_signal": "UP", "components": {"UMCSENT_low": 0.5}}), json.dumps({"hard_defcon1": True, "action": "old", "allocation": {"action": "new", "equity_weight": 0.3}, "streaks": {"streak_ge_2": 1, "streak_ge_3": 2}})]
    df = spark.createDataFrame([(D(2020, 1, i + 1), "NORMAL", None if i == 1 else 1.25, t) for i, t in enumerate(records)], "as_of_date date, state string, score double, reasons_json string")
    got = sinks.flat_records(df).orderBy("as_of_date").collect()
    assert list(got[0].asDict()) == list(sinks.STATE_COLUMNS) and got[1].score == "" and got[0].score == "1.250" and all(got[i].equity_weight == "" for i in range(3))
    assert (got[3].equity_weight, got[3].streak_ge_2, got[3].streak_lt_2, got[3].trend_signal, got[3].triggers, got[3].hard_defcon1, got[3].UMCSENT_low) == ("0.400", "2", "7", "UP", "a | Hard DEFCON1", "1", "0.5")
    assert (got[4].equity_weight, got[4].action, got[4].streak_ge_2, got[4].hard_defcon1) == ("0.300", "new", "1", "1")


def test_recompute_checks_for_gaps(spark):
    rows = [("s", d, True, 2.5, False, False) for d in days(12)]
    scores = spark.createDataFrame(rows, "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean")
    full = score.recompute_states(scores, None)
    stored = full.filter(F.dayofmonth("date") <= 6)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(stored.unionByName(score.recompute_states(scores, stored))) == key(full)
    holes = stored.filter(F.dayofmonth("date") != 3)
    with pytest.raises(ValueError, match="gaps"):
        score.recompute_states(scores, holes)
    assert key(score.recompute_states(scores, holes, reset=True)) == key(full)


def test_reasons_name_stale_sensors(spark):
    df = spark.createDataFrame([("x | y", 1.0, 3.5, True, "DEFCON2", 1, 0, 0, 0, "UP", 2.0, 1.0, "HOLD", 0.4, ["b", "c"])], "triggers string, raw_score double, score double, held boolean, prev_state string, ge_2 int, ge_1 int, lt_2 int, le_1 int, signal string, price double, ma double, action string, equity double, stale_critical array<string>")
    record = json.loads(score.reasons(df).first().reasons_json)
    assert record["triggers"] == ["x", "y", "Held last score (DEFCON safety) due to stale: b, c"] and record["stale_critical_series"] == ["b", "c"] and record["thresholds"]["enter_1"] == 3.5


def test_jobs_run_once_and_not_too_often(spark, tmp_path):
    folder, ran, clock = str(tmp_path), [], [1000.0]

    def work():
        ran.append(jobs.run_once(spark, folder, "daily", lambda: "inner"))  # while it runs, another driver is refused
        return "done"

    once = lambda **o: jobs.run_once(spark, folder, "daily", work, now=lambda: clock[0], stale_after=1e12, **o)
    assert once(min_interval=30) == "done" and ran == [None]
    clock[0] += 10
    assert once(min_interval=30) is None and once(min_interval=30, force=True) == "done"
    clock[0] += 31
    assert once(min_interval=30) == "done" and jobs.last_run(spark, folder, "daily") == clock[0]
    with pytest.raises(ZeroDivisionError):
        jobs.run_once(spark, folder, "daily", lambda: 1 / 0)
    assert jobs.run_once(spark, folder, "daily", lambda: 1) == 1  # the lock went with the failure
    assert jobs.last_run(spark, folder, "other") is None


def test_sources(spark, tmp_path):
    (tmp_path / "#Uc9c0#Ud45c").mkdir()
    assert files.find_folder(spark, str(tmp_path), ["data", "more"], "#Ud").endswith("#Uc9c0#Ud45c")
    (tmp_path / "more").mkdir()
    assert files.find_folder(spark, str(tmp_path), ["data", "more"], "#Ud").endswith("/more")
    assert files.find_folder(spark, str(tmp_path / "more"), ["data"], "#Ud").endswith("/more/data")
    (tmp_path / "c.csv").write_text("time,A,B\n2024-01-02T05:00:00Z,1,x\n1704240000,2,3\n")
    df = files.read_csv(spark, str(tmp_path / "c.csv"))
    got = sorted(tuple(r) for r in files.observations(df, "time", {"A": "a", "B": "b"}, "1D", {"b": "1W"}, whole_days=True).collect())
    assert got == [("a", 1704153600000, "1D", 1.0), ("a", 1704240000000, "1D", 2.0), ("b", 1704240000000, "1W", 3.0)]
    full, none = spark.range(1), spark.range(0)
    assert files.preferred(none, full) is full and files.preferred(full, none) is full and files.preferred(None, none) is none and files.preferred(none, None) is none


def test_config_from_the_environment():
    c = EngineConfig.from_env({"TIDEMARK_TREND_WINDOW": "50", "TIDEMARK_BOND_CARRY": "false", "TIDEMARK_TZ": "Asia/Seoul", "OTHER": "1"})
    assert (c.trend_window, c.bond_carry, c.tz, c.enter_1) == (50, False, "Asia/Seoul", 3.5)
    with pytest.raises(ValueError):
        EngineConfig.from_env({"TIDEMARK_TREND_WINDOW": "many"})
    with pytest.raises(ValueError):
        EngineConfig.from_env({"TIDEMARK_BOND_CARRY": "maybe"})


def test_command_line(spark, tmp_path):
    assert cli.main(["query", "daily_last", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    scores = spark.createDataFrame([("s", d, True, 2.5, False, False) for d in days(12)], "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean")
    scores.write.parquet(str(tmp_path / "scores"))
    assert cli.main(["states", "--scores", str(tmp_path / "scores"), "--out", str(tmp_path / "all")], spark) == 0
    assert cli.main(["states", "--scores", str(tmp_path / "scores"), "--stored", str(tmp_path / "all"), "--days", "7", "--out", str(tmp_path / "last")], spark) == 0
    assert (spark.read.parquet(str(tmp_path / "all")).count(), spark.read.parquet(str(tmp_path / "last")).count()) == (12, 7)
    for key in ("date", "time", "index"):
        (tmp_path / f"{key}.csv").write_text(f"{key},months_until_fear,months_until_euphoria,confidence_fear,confidence_euphoria,fear_trigger,fear_level,euphoria_trigger,euphoria_level,macro_risk\n2024-01-02,3,x,0.5,0.5,0,0,0,0,0\n")
        assert cli.main(["timing", "--features", str(tmp_path / f"{key}.csv"), "--out", str(tmp_path / f"{key}-out")], spark) == 0
        row = spark.read.csv(str(tmp_path / f"{key}-out"), header=True).first()
        assert (row.date, row.status_crisis, row.status_euphoria) == ("2024-01-02", "OK", "NO_FEATURES")
    (tmp_path / "none.csv").write_text("date,x\n")
    assert cli.main(["timing", "--features", str(tmp_path / "none.csv"), "--out", str(tmp_path / "n")], spark) == 1


def test_pages_match_the_whole_order(spark):
    rows = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i // 3), i) for i in range(100)], "date date, n int")
    whole = [r.n for r in rows.orderBy(F.desc("date"), "n").collect()]
    for number, at in ((1, 0), (2, 7), (9, 56), (15, 98), (99, 98), (0, 0)):
        assert [r.n for r in views.page(rows, number, 7, tie="n").collect()] == whole[at : at + 7]
    assert views.page(rows.limit(0), 3).count() == 0


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.csv_list(F.lit(" a, ,b,"))) == ["a", "b"] and one(S.truncated(F.lit("x" * 30), 20)) == "x" * 5 + "…(truncated)" and one(S.truncated(F.lit(None).cast("string"))) == "" and one(S.preview(F.lit("abc"), 2)) == "ab…"
    assert one(S.clock_angle(F.lit(3.0), F.lit(12.0))) == 180.0 and one(S.clock_angle(F.lit(30.0), F.lit(12.0))) == -90.0
    peak, trough = C.near_phase(F.lit(-3.1))
    assert (one(peak), one(trough)) == (False, True)
    wide = prep.pivot_wide(spark.createDataFrame([(D(2020, 1, 1), "a", 9.0, 1), (D(2020, 1, 1), "a", 2.0, 2)], "date date, series_id string, value double, seq int"), ["a"], "seq")
    assert wide.first().a == 2.0
    grid = P.price_grid(spark.createDataFrame([(D(2020, 1, 1), "a", 1.0), (D(2020, 1, 2), "b", 2.0), (D(2020, 1, 3), "zz", 2.0)], "date date, series_id string, value double"), ["a", "b"])
    assert sorted((r.date.day, r.series_id, r.value) for r in grid.collect()) == [(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", 2.0)]


def test_ewma_skips_nulls(spark):
    xs = [None, 0.1, None, -0.2, 0.3, 0.05]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    got = [r.e for r in df.select("i", windows.ewma_std(F.col("x"), windows.by("k", "i"), 20, 4).alias("e")).orderBy("i").collect()]
    for i, e in enumerate(got):
        v = np.array([x for x in xs[max(0, i - 3) : i + 1] if x is not None])
        if len(v) < 2:
            assert e is None
        else:
            w = (1 - 2 / 21) ** np.arange(len(v))[::-1]
            m = (w * v).sum() / w.sum()
            assert e == pytest.approx((((w * (v - m) ** 2).sum() / w.sum()) * w.sum() ** 2 / (w.sum() ** 2 - (w * w).sum())) ** 0.5)
