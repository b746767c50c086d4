"""Stateful streams and recomputation after late data, held against the batch operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import score, views
from tidemark.streaming import ledger, recompute, states

D = dt.date
VALUES = "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean, clock boolean"


def day(k):
    return D(2020, 1, 1) + dt.timedelta(k)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)


def score_path(seed, n):
    rng = random.Random(seed)
    level, out = 0.0, []
    for k in range(n):
        level = min(5.0, max(0.0, level + rng.choice([-1, -0.5, 0, 0, 0.5, 1])))
        out.append((rng.random() > 0.03, None if rng.random() < 0.02 else level, rng.random() < 0.02, rng.random() < 0.2))
    return [(day(k), *x) for k, x in enumerate(out)]


def test_states_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Two scenarios, shuffled within ten days' lateness, a row twice, gaps between days, and a restart after each file."""
    rows = {s: [r for k, r in enumerate(score_path(s, 150)) if k % 17] for s in ("1", "2")}
    source, rng = f"{tmp_path}/source", random.Random(4)
    every = [(s, *r, False) for s in rows for r in rows[s]]
    arrival = sorted(every, key=lambda r: (r[1] - day(0)).days + rng.uniform(0, 9))
    seen = []
    for k in range(0, len(arrival), 60):
        part = arrival[k : k + 60]
        write(spark, [*part, part[0]], VALUES, f"{source}/{k}")
        states.start_states(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", late="10 days").awaitTermination()
        seen.append(states.read_states(spark, f"{tmp_path}/out").count())
    assert seen == sorted(seen) and 0 < seen[-1] < len(every)
    write(spark, [("1", day(500), None, None, None, None, True)], VALUES, f"{source}/clock")
    states.start_states(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", late="10 days").awaitTermination()
    want = score.fold_states(spark.createDataFrame([r[:-1] for r in every], VALUES.rpartition(",")[0]))
    got = states.read_states(spark, f"{tmp_path}/out")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.state for r in got.collect()} == {"NORMAL", "DEFCON1", "DEFCON2", "WARMUP"}


def test_phases_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Series of many values, of one value (no segment) and of values that are null; the open segment grows with each file."""
    rng, rows = random.Random(8), [("one", day(3), 5.0, False), ("none", day(4), None, False)]
    for s in ("a", "b"):
        v = 100.0
        for k in range(200):
            v *= rng.choice([0.9, 0.95, 1.0, 1.04, 1.12])
            rows.append((s, day(k), None if rng.random() < 0.05 else v, False))
    schema, source = "series_id string, date date, value double, clock boolean", f"{tmp_path}/source"
    for k in range(3):
        part = [r for r in rows if (r[1] - day(0)).days * 3 // 200 == k]
        rng.shuffle(part)
        write(spark, part, schema, f"{source}/{k}")
        states.start_phases(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        assert states.read_phases(spark, f"{tmp_path}/out").filter("open").count() == 2
    write(spark, [("clock", day(400), None, True)], schema, f"{source}/clock")
    states.start_phases(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    want = views.bull_bear(spark.createDataFrame([r[:3] for r in rows], "series_id string, date date, value double"))
    got = states.read_phases(spark, f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.filter("not open").count() > 10


SENSORS = (score.Sensor("A", "spread", 105.0), score.Sensor("B", "ratio", critical=True), score.Sensor("C", "hard", 118.0), score.Sensor("E", "curve"))


def payload(series, date, value, order):
    ms = int(dt.datetime.combine(date, dt.time(), dt.timezone.utc).timestamp() * 1000)
    return json.dumps({"schema_version": 1, "source": "tradingview", "series_id": series, "time_utc": ms, "interval": "1D", "value": value, "timenow": ms + order})


@pytest.fixture(scope="module")
def observed():
    rng = random.Random(2)
    return {(s, day(k)): 100 + rng.gauss(0, 8) * (0.1 if s == "E" else 1) - 100 * (s == "E") for s in "ABCE" for k in range(260) if rng.random() < 0.8}


def full_run(spark, values):
    daily = spark.createDataFrame([(s, d, v) for (s, d), v in values.items()], "series_id string, date date, value double")
    days = [r[1] for r in values]
    scores = recompute.suffix_scores(daily, SENSORS, min(days), max(days), ma_window=20, back=5).withColumn("scenario", F.lit("batch"))
    seen = score.sensor_days(recompute.prep.calendar(daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))), daily, SENSORS, ma_window=20, back=5)
    assert sorted(map(str, scores.drop("scenario").collect())) == sorted(map(str, score.day_scores(seen).collect()))
    return {r.date: tuple(r)[2:] for r in score.fold_states(scores).collect()}


def test_late_batches_change_only_what_follows(spark, tmp_path, observed):
    source, results = f"{tmp_path}/source", {}
    live = lambda: recompute.start_live_states(spark, source, f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", f"{tmp_path}/states", SENSORS, lambda n, *x: results.update({n: x}), ma_window=20, back=5).awaitTermination()
    stored = lambda: {r.date: (r.state, r.raw_score, r.score, r.held, r.prev_state, r.ge_2, r.ge_1, r.lt_2, r.le_1) for r in recompute.read_states(spark, f"{tmp_path}/states").collect()}
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}

    def send(name, lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        live()

    late = [k for i, k in enumerate(sorted(observed)) if i % 9 == 4 or k[1] > day(240)]
    now = {k: v for k, v in observed.items() if k not in late}
    send("first", [payload(*k, v, 1) for k, v in now.items()])
    assert stored() == full_run(spark, now)

    # one old value: days before it, and months in which nothing differs, stay
    changed, before = next(k for k in late if k[0] == "C" and k[1] > day(120)), files()
    now[changed] = 130.0
    send("old", [payload(*changed, 130.0, 1), payload(*changed, 7.0, 0)])
    first, months = results[1]
    assert first == changed[1] and months and min(months) >= first.strftime("%Y-%m")
    assert stored() == full_run(spark, now)
    touched = {p.split("month=")[1][:7] for p in set(before) ^ set(files())}
    assert touched == set(months) and len({p.split("month=")[1][:7] for p in before} - touched) >= 3

    # the same value again, and an older write: nothing changes, nothing is written
    before = files()
    send("again", [payload(*changed, 130.0, 2), payload(*changed, 1.0, 0)])
    assert results[2] == (None, []) and files() == before

    # the rest in two shuffled batches, the newest days among them
    random.Random(1).shuffle(late)
    for k, part in enumerate((late[::2], late[1::2])):
        now |= {x: observed[x] for x in part}
        send(f"rest-{k}", [payload(*x, observed[x], 3) for x in part])
        assert stored() == full_run(spark, now)

    # a batch that runs again ends in the same rows
    assert recompute.apply_batch(spark, f"{tmp_path}/ledger", 4, f"{tmp_path}/states", SENSORS, ma_window=20, back=5)[1] == []
    assert stored() == full_run(spark, observed) | {} and ledger.read_ledger(spark, f"{tmp_path}/ledger").count() == len(observed)

    # a value before the first day: everything is computed again
    now[("A", day(-3))] = 100.0
    send("before", [payload("A", day(-3), 100.0, 1)])
    assert results[5][0] == day(-3) and stored() == full_run(spark, now)


def shuffled_rows(spark):
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_batch_moves_no_rows_of_the_ledger(spark, tmp_path):
    """Ten days of two series, each written 2000 times, in a ledger that is too large to be broadcast: sums of the days are shuffled, not rows. Of a time's
    writes the last by arrival counts, of whichever batch."""
    times = [(s, k) for s in ("A", "C") for k in range(10)]
    for n, sent in ((0, range(2000)), (1, (1500, 2500))):
        rows = [(s, 1577836800000 + k * 86400000, "1D", float(w + k), dt.datetime(2021, 1, 1) + dt.timedelta(seconds=w), None, w) for s, k in times if n == 0 or (s, k) in (("A", 4), ("C", 7)) for w in sent if n == 0 or (w > 2000) == (s == "A")]
        spark.createDataFrame(rows, "series_id string, time_utc_ms long, interval string, value double, received_at timestamp, payload_json string, seq long").write.parquet(f"{tmp_path}/ledger/accepted/batch={n}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        first = [recompute.apply_batch(spark, f"{tmp_path}/ledger", n, f"{tmp_path}/states", SENSORS, ma_window=3, back=1)[0] for n in (0, 1)]
        assert shuffled_rows(spark) - before < 10000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert first == [D(2020, 1, 1), D(2020, 1, 5)]  # the older write of C changes nothing
    now = recompute.batch_days(ledger.accepted(spark, f"{tmp_path}/ledger"), 1)
    assert {(r.series_id, r.date.day, r.value, r.old) for r in now.filter("touched").collect()} == {("A", 5, 2504.0, 2003.0), ("C", 8, 2006.0, 2006.0)}


def test_rows_within_reach(spark):
    daily = spark.createDataFrame([(s, day(k), None if k == 3 else float(k)) for s, n in (("a", 30), ("b", 4)) for k in range(n)], "series_id string, date date, value double")
    got = {s: sorted((r.date, r.earlier) for r in recompute.within_reach(daily, day(20), 5).filter(F.col("series_id") == s).collect()) for s in "ab"}
    assert got == {"a": [(day(k), 14) for k in range(15, 30)], "b": [(day(k), 0) for k in range(4)]}


def test_refused_payloads_keep_their_text(spark, tmp_path):
    lines = [payload("A", day(1), 5.0, 0), "{bad", payload("", day(1), 5.0, 0)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/source")
    ledger.start_ledger(spark, f"{tmp_path}/source", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.raw, r.reject) for r in spark.read.parquet(f"{tmp_path}/out/rejected").collect()} == {(lines[1], "json"), (lines[2], "series_id")}
    assert [r.series_id for r in ledger.accepted(spark, f"{tmp_path}/out").collect()] == ["A"]
