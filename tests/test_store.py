"""The table of hash buckets, scans over blocks of a series, and what else must hold whatever the size."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import store
from tidemark.operators import prep, quantiles, scans, score, windows
from tidemark.streaming import jobs

SCHEMA = "k long, v string, at long"


def table(spark, root, buckets=8):
    store.create(spark, root, SCHEMA, ["k"], ["at"], buckets)
    return lambda rows, **more: store.upsert(spark, root, spark.createDataFrame(rows, SCHEMA), **more)


def content(spark, root, version=None):
    return {r.k: (r.v, r["at"]) for r in store.read(spark, root, version).collect()}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    put = table(spark, root)
    assert content(spark, root) == {}
    assert put([(k, "a", 1) for k in range(100)]) == 2
    before = store.manifest(spark, root)["buckets"]
    assert put([(3, "new", 2), (3, "newer", 3), (5, "old", 0), (None, "null", 1)]) == 3
    after = store.manifest(spark, root)["buckets"]
    want = {**{k: ("a", 1) for k in range(100)}, 3: ("newer", 3), None: ("null", 1)}
    assert content(spark, root) == want and 1 <= sum(before.get(b) != after[b] for b in after) <= 3
    assert content(spark, root, 2) == {k: ("a", 1) for k in range(100)}, "an old version stays as it was"
    assert put([(3, "newer", 3)]) == 4 and content(spark, root) == want, "the same write again does no harm"
    assert store.restore(spark, root, 2) == 5 and content(spark, root)[3] == ("a", 1)
    assert store.vacuum(spark, root, keep=2, older_than=3600) == 0 and store.versions(spark, root) == [4, 5] and content(spark, root, 4) == want
    assert store.vacuum(spark, root, keep=1, older_than=-1) == 2 and store.versions(spark, root) == [5] and content(spark, root) == {k: ("a", 1) for k in range(100)}
    with pytest.raises(ValueError, match="holds a table"):
        table(spark, root)


def test_writers_at_once_lose_no_row_and_readers_see_whole_writes(spark, tmp_path):
    """Each write puts one value into all keys of its own and into a shared row; readers meanwhile see each writer's keys all alike."""
    root, seen, stop, failed = str(tmp_path / "t"), [], threading.Event(), []
    put = table(spark, root, 4)

    def write(w):
        try:
            for n in range(1, 4):
                put([(w * 100 + k, f"{w}-{n}", n) for k in range(20)] + [(0, f"{w}-{n}", 10 * n + w)], retries=50)
        except Exception as e:  # noqa: BLE001  shown by the assertion below
            failed.append(e)

    def look():
        while not stop.is_set():
            seen.append(content(spark, root))

    threads, reader = [threading.Thread(target=write, args=(w,)) for w in (1, 2, 3)], threading.Thread(target=look)
    for t in (*threads, reader):
        t.start()
    for t in threads:
        t.join()
    stop.set()
    reader.join()
    assert not failed
    assert content(spark, root) == {0: ("3-3", 33), **{w * 100 + k: (f"{w}-3", 3) for w in (1, 2, 3) for k in range(20)}}
    assert store.versions(spark, root) == list(range(1, 11))
    for x in seen:
        for w in (1, 2, 3):
            assert len({x.get(w * 100 + k) for k in range(20)}) == 1


def test_a_lost_race_is_told_and_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    put = table(spark, root)
    put([(1, "a", 1)])
    monkeypatch.setattr(store, "publish", lambda *a: False)
    with pytest.raises(store.LostRace):
        put([(1, "b", 2)], retries=2, wait=0.0)
    assert content(spark, root) == {1: ("a", 1)}


def test_stored_states_go_on_from_their_last_day_under_a_lock(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "states")
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(k), rng.random() > 0.05, rng.choice([0.0, 1.0, 2.5, 4.0]), False, rng.random() < 0.2) for k in range(120)]
    days = spark.createDataFrame(rows, "scenario string, date date, ready boolean, raw double, hard boolean, stale_critical boolean")
    store.create(spark, root, f"scenario string, date date, {score.STATE_SCHEMA}", ["scenario", "date"], ["date"], 4)
    assert jobs.recompute_stored(spark, root, days.filter(F.col("date") < "2020-02-10")) == 2
    assert jobs.recompute_stored(spark, root, days) == 3
    want = score.fold_states(days)
    assert sorted(map(str, store.read(spark, root).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    (tmp_path / "states" / "recompute.lock").touch()
    began = time.time()
    assert jobs.run_once(spark, root, "recompute", lambda: 1, force=True, attempts=3, pause=0.1) is None and time.time() - began >= 0.3
    threading.Timer(0.3, (tmp_path / "states" / "recompute.lock").unlink).start()
    assert jobs.run_once(spark, root, "recompute", lambda: 1, force=True, attempts=5, pause=0.2) == 1


def series():
    rng = random.Random(7)
    rows = []
    for s, n in (("a", 400), (None, 60), ("b", 1), ("c", 90)):
        t = dt.datetime(2020, 1, 1)
        for k in range(n):
            t += dt.timedelta(hours=rng.choice([1, 1, 1, 40, 900]))
            rows.append((s, t, None if rng.random() < 0.3 else rng.uniform(0.9, 1.12), rng.choice([True, True, True, True, None, False])))
    return rows


@pytest.mark.parametrize("rows_per_block", [7, 50, 10_000])
def test_scans_in_blocks_are_those_of_whole_series(spark, rows_per_block):
    df, x = spark.createDataFrame(series(), "s string, t timestamp, x double, f boolean"), F.col("x")
    w = windows.by("s", "t")
    whole = {"ffill": windows.ffill(x, w), "bfill": F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "sum": F.sum(x).over(windows.upto(w)), "product": windows.cumulative_product(x, w), "max": F.max(x).over(windows.upto(w)), "min": F.min(x).over(windows.upto(w))}
    want = windows.with_streak(df.select("*", *[c.alias(k) for k, c in whole.items()]), F.col("f"), "s", "t", "streak")
    got = scans.scan(df, ["s"], "t", scans.time_blocks(df, "t", rows_per_block), {**{k: (k, x) for k in whole}, "streak": ("streak", F.col("f"))})
    assert got.columns == want.columns
    plain = lambda d: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()], key=str)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_joins_in_blocks_are_those_of_whole_series(spark, kind):
    rng = random.Random(11)
    time_ = F.date_add(F.lit("2020-01-01").cast("date"), F.col("d").cast("int")) if kind == "date" else F.timestamp_seconds(F.col("d") * 3600) if kind == "timestamp" else F.col("d")
    frame = lambda n: spark.createDataFrame([(rng.choice("ab"), rng.randrange(2000), k) for k in range(n)], "s string, d long, v long").dropDuplicates(["s", "d"]).select("s", time_.alias("t"), "v")
    probes, facts = frame(300).withColumnRenamed("v", "p").cache(), frame(150).cache()
    for rows_per_block in (20, 10_000):
        assert sorted(scans.as_of(probes, facts, ["s"], ["v"], "t", rows_per_block).collect(), key=str) == sorted(prep.as_of(probes, facts, ["s"], ["v"], "t").collect(), key=str)
        if kind == "date":
            assert sorted(scans.nearest(probes, facts, ["s"], ["v"], "t", rows_per_block).collect(), key=str) == sorted(prep.nearest(probes, facts, ["s"], ["v"], "t").collect(), key=str)
        else:
            assert scans.nearest(probes, facts, ["s"], ["v"], "t", rows_per_block).filter("as_of is null").count() == 0


def test_one_series_uses_all_tasks(spark):
    df = spark.range(40_000).select(F.lit("one").alias("s"), F.col("id").alias("t"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = scans.scan(df, ["s"], "t", scans.time_blocks(df, "t", 1000), {"total": ("sum", F.col("x"))}).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 20_000
        assert rows.filter(F.col("total") != F.col("t") * (F.col("t") + 1) / 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "s string, t date, x double")
    assert scans.scan(df, ["s"], "t", scans.time_blocks(df, "t"), {"y": ("ffill", F.col("x"))}).collect() == []


@pytest.mark.parametrize("limit", [5, 60, 10_000])
def test_exact_medians(spark, limit):
    """Even and odd numbers, many equal values, nulls, NaN, infinities, a key without a value and a null key; small limits need several sketches."""
    rng, rows = random.Random(4), []
    for g, n in (("a", 4001), ("b", 600), (None, 51), ("one", 1), ("none", 3)):
        for _ in range(n):
            x = None if g == "none" or rng.random() < 0.05 else rng.choice([float("nan"), float("inf")]) if rng.random() < 0.01 else rng.gauss(0, 1e6)
            rows.append((g, x, float(rng.choice([1, 2, 2, 2, 2, 2, 3])), rng.randrange(10**6)))
    df = spark.createDataFrame(rows, "g string, x double, y double, z int").repartition(3)
    clean = df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    percentiles = [F.percentile(c, F.lit(0.5)).alias(c) for c in "xyz"]
    plain = lambda d: sorted(map(str, d.collect()))
    assert plain(quantiles.exact_medians(df, ["x", "y", "z"], ["g"], limit)) == plain(clean.groupBy("g").agg(*percentiles))
    assert plain(quantiles.exact_medians(df, ["x", "y", "z"], limit=limit)) == plain(clean.agg(*percentiles))
    assert quantiles.exact_medians(df.limit(0), ["x"], limit=limit).collect() == [(None,)] and quantiles.exact_medians(df.limit(0), ["x"], ["g"]).collect() == []
