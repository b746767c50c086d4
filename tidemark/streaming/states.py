"""Stateful streams: the state machine and the bull and bear phases, day by day, from rows that come in any order.

A key's rows wait in its state until the watermark has passed their day; then they are folded in the order of days, with the same
steps that the batch operators take, so a stream fed in pieces and restarted between them ends where one batch does. One event-time timer a
key, at its first waiting day, releases all that are due. State is kept by RocksDB under the query's checkpoint."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import DEFAULT, EngineConfig
from ..operators import score, views

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS, EPOCH = 86_400_000, datetime.date(1970, 1, 1)


class DayFold(StatefulProcessor):
    """Folds a key's days in order. step(state, date, values) gives the next state and rows; tail(state) the rows that stand open after a release.

    Of several rows of a day that wait, the last to arrive counts; a day that has been folded is not folded again. Rows without values (`clock`
    rows) only move the watermark. state_schema and value_schema are of flat rows, columns those of the result, the key first."""

    def __init__(self, step: Callable, tail: Callable, state_schema: str, values: list[tuple[str, str]], key: str, columns: list[str]):
        self.step, self.tail, self.state_schema, self.key, self.columns = step, tail, state_schema, key, columns
        self.names, self.value_schema = [n for n, _ in values], ", ".join(f"{n} {t}" for n, t in values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", f"day int, {self.state_schema}")
        self.due = handle.getValueState("due", "day int")
        self.waiting = handle.getMapState("waiting", "day int", self.value_schema)

    def _arm(self, day: int | None) -> None:
        """The key's one timer: just after its first waiting day."""
        now = self.due.get()[0] if self.due.exists() else None
        if now is not None and (day is None or day != now):
            self.handle.deleteTimer(now * DAY_MS + 1)
        if day is None:
            self.due.clear()
        elif day != now:
            self.handle.registerTimer(day * DAY_MS + 1)
            self.due.update((day,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.folded.get()[0] if self.folded.exists() else None
        first = self.due.get()[0] if self.due.exists() else None
        for pdf in rows:
            for row in pdf[~pdf["clock"]][["date", *self.names]].itertuples(index=False, name=None):
                day = (row[0] - EPOCH).days
                if done is None or day > done:
                    self.waiting.updateValue((day,), tuple(None if pd.isna(x) else x for x in row[1:]))
                    first = day if first is None else min(first, day)
        if first is not None:
            self._arm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = (timerValues.getCurrentWatermarkInMs() - 1) // DAY_MS
        rows = sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())
        due = [x for x in rows if x[0] <= last]
        state = tuple(self.folded.get())[1:] if self.folded.exists() else None
        out = []
        for day, values in due:
            state, found = self.step(state, EPOCH + datetime.timedelta(days=day), values)
            out += found
            self.waiting.removeKey((day,))
        self.due.clear()
        if len(rows) > len(due):
            self._arm(rows[len(due)][0])
        if due:
            self.folded.update((due[-1][0], *state))
            out += self.tail(state)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=self.columns)

    def close(self) -> None:
        pass


class StateStep:
    """score.step() as a step of a DayFold."""

    def __init__(self, config: EngineConfig):
        self.config = config

    def __call__(self, state, date, values):
        after, row = score.step(state or score.START, values, self.config)
        return after, [(date, *row)]


class PhaseStep:
    """views.turn() as a step of a DayFold."""

    def __init__(self, fall: float, rise: float):
        self.fall, self.rise = fall, rise

    def __call__(self, state, date, values):
        if values[0] is None:
            return state or (None, None, None, None, 0), []
        before = None if state is None or state[0] is None else (state[0], EPOCH + datetime.timedelta(days=state[1]), state[2])
        (regime, start, level), closed = views.turn(before, date, values[0], self.fall, self.rise)
        return (regime, (start - EPOCH).days, level, (date - EPOCH).days, (state[4] if state else 0) + 1), [closed] if closed else []


def nothing_open(state) -> list[tuple]:
    return []


def open_phase(state) -> list[tuple]:
    """The segment that stands open, once two values are known."""
    if state[4] < 2:
        return []
    return [(state[0], EPOCH + datetime.timedelta(days=state[1]), EPOCH + datetime.timedelta(days=state[3]), True)]


def _start(spark: SparkSession, source: str, out: str, checkpoint: str, fold: DayFold, result: str, late: str, files_per_batch: int) -> StreamingQuery:
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = f"{fold.key} string, date date, {fold.value_schema}, clock boolean"
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source).filter("date is not null")
    rows = rows.withColumns({"clock": F.coalesce("clock", F.lit(False)), "ts": F.to_timestamp("date")}).withWatermark("ts", late)
    folded = rows.groupBy(fold.key).transformWithStateInPandas(fold, outputStructType=result, outputMode="Update", timeMode="EventTime")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    return folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def start_states(spark: SparkSession, source: str, out: str, checkpoint: str, key: str = "scenario", config: EngineConfig = DEFAULT, late: str = "0 seconds", files_per_batch: int = 1000) -> StreamingQuery:
    """Reads the Parquet files of source (key, date, ready, raw, hard, stale_critical, and perhaps clock) that it has not read, folds each key's
    days that the watermark has passed, and appends their states to out, each batch under its number. Call it again to go on.

    Rows may come `late` behind the newest day; what comes later than the watermark is not folded (recompute.replace_states() takes that in).
    A row whose clock is true holds no day: it moves the watermark, as at a stream's end."""
    values = [("ready", "boolean"), ("raw", "double"), ("hard", "boolean"), ("stale_critical", "boolean")]
    names = [key, "date", *[x.split()[0] for x in score.STATE_SCHEMA.split(", ")]]
    fold = DayFold(StateStep(config), nothing_open, "state string, raw double, ge_2 int, ge_1 int, lt_2 int, le_1 int", values, key, names)
    return _start(spark, source, out, checkpoint, fold, f"{key} string, date date, {score.STATE_SCHEMA}", late, files_per_batch)


def start_phases(spark: SparkSession, source: str, out: str, checkpoint: str, key: str = "series_id", fall: float = 0.8, rise: float = 1.2, late: str = "0 seconds", files_per_batch: int = 1000) -> StreamingQuery:
    """As start_states(), for closes (key, date, value, and perhaps clock): segments that have ended, and the open one as it stands."""
    fold = DayFold(PhaseStep(fall, rise), open_phase, "regime string, start int, level double, last int, n int", [("value", "double")], key, [key, "regime", "start", "end", "open"])
    return _start(spark, source, out, checkpoint, fold, f"{key} string, regime string, start date, end date, open boolean", late, files_per_batch)


def read_states(spark: SparkSession, out: str) -> DataFrame:
    """The states so far: a row a key and day."""
    return spark.read.parquet(out).drop("batch")


def read_phases(spark: SparkSession, out: str, key: str = "series_id") -> DataFrame:
    """The segments so far, each as last written: key, regime, start, end, open, days."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(key, "start").agg(F.max_by(F.struct("regime", "end", "open"), "batch").alias("s"))
    return last.select(key, "s.regime", "start", "s.end", "s.open").withColumn("days", F.datediff("end", "start"))
