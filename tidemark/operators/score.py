"""Readiness, component scores, trend, state machine and equity allocation, one row for each scenario and calendar day."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .prep import as_of, contiguity
from .scans import scan
from .windows import all_of_last, by, cross_up, ewma_std, mean, pct_change, rolling, slope, std

STATE_SCHEMA = "state string, raw_score double, score double, held boolean, prev_state string, ge_2 int, ge_1 int, lt_2 int, le_1 int"


@dataclass(frozen=True)
class Sensor:
    """One input of the score. rule: curve, spread, activity, ratio, sentiment (components) or hard (the trigger)."""

    series_id: str
    rule: str
    level: float = 0.0
    interval: str = "1D"
    critical: bool = False


def sensor_features(daily: DataFrame, sensors: Sequence[Sensor], ma_window: int = 200, back: int = 20) -> DataFrame:
    """Per series and observation: value, its crossing, slope, mean of 4, and below-average run; keyed by series, so one shuffle."""
    w = by("series_id", "date")
    found = daily.filter(F.col("series_id").isin(*[s.series_id for s in sensors]))
    found = rolling(found, "series_id", "date", ma_window, {"ma": ("mean", F.col("value"))}).withColumn("have", F.count("value").over(w))
    below = F.col("ma").isNotNull() & (F.col("value") < F.col("ma"))
    return found.select(
        "series_id", "date", "value", "have", "ma", cross_up(F.col("value"), w).alias("crossed"), slope(F.col("value"), w, back).alias("slope"),
        mean(F.col("value"), w, 4).alias("mean_4"), all_of_last(below, w, 5).alias("below_5"),
    )


def sensor_days(days: DataFrame, daily: DataFrame, sensors: Sequence[Sensor], config: EngineConfig = DEFAULT, buffer_days: int = 1, ma_window: int = 200, back: int = 20) -> DataFrame:
    """Calendar by sensors: each sensor's latest observation as of each day, its age and whether it is late or stale.

    Stale: older than the valid days of its interval and buffer_days more; late: older than the valid days."""
    table = F.array(*[F.struct(F.lit(s.series_id).alias("series_id"), F.lit(s.rule).alias("rule"), F.lit(s.level).alias("level"), F.lit(config.valid_days[s.interval]).alias("valid"), F.lit(s.critical).alias("critical")) for s in sensors])
    probes = days.select("date", F.inline(table))
    seen = as_of(probes, sensor_features(daily, sensors, ma_window, back), ["series_id"], ["value", "have", "ma", "crossed", "slope", "mean_4", "below_5"])
    age = F.datediff("date", "as_of")
    return seen.withColumns({"age": age, "late": F.coalesce(age > F.col("valid"), F.lit(True)), "stale": F.coalesce(age > F.col("valid") + buffer_days, F.lit(True)), "have": F.coalesce("have", F.lit(0)).cast("long")})


def fires(batch: bool = True) -> Column:
    """Whether a sensor's component counts. batch: stale sensors don't, and levels need a trend; else the last value alone decides."""
    v, level = F.col("value"), F.col("level")
    if batch:
        rules = {"curve": F.col("crossed"), "spread": (v >= level) & (F.col("slope") >= 0), "activity": (v < level) & (F.col("mean_4") < level), "ratio": F.col("below_5"), "sentiment": v < level, "hard": v >= level}
    else:
        rules = {"curve": F.col("crossed"), "spread": v >= level, "activity": v < level, "ratio": v < F.col("ma"), "sentiment": v < level, "hard": v >= level}
    hit = F.lit(False)
    for rule, c in rules.items():
        hit = F.when(F.col("rule") == rule, F.coalesce(c, F.lit(False))).otherwise(hit)
    return hit & ~F.col("stale") if batch else hit


def day_scores(sensors_by_day: DataFrame, config: EngineConfig = DEFAULT, batch: bool = True) -> DataFrame:
    """One row a day: ready, raw (null when not ready), hard, stale_critical and the rules that fired."""
    weight = F.lit(0.0)
    for rule, w in config.weights.items():
        weight = F.when(F.col("rule") == rule, w).otherwise(weight)
    rows = sensors_by_day.withColumn("hit", fires(batch)).withColumn("points", F.when(F.col("hit"), weight).otherwise(0.0))
    day = rows.groupBy("date").agg(
        F.min(F.when(F.col("critical"), F.col("have") > 0)).alias("ready"), F.sum("points").alias("points"), F.max((F.col("rule") == "hard") & F.col("hit")).alias("hard"),
        F.max(F.col("critical") & F.col("stale") & (F.col("have") > 0)).alias("stale_critical"), F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("rule")))).alias("triggers"),
    )
    ready = F.coalesce("ready", F.lit(True))
    return day.select("date", ready.alias("ready"), F.when(ready, F.col("points")).alias("raw"), (ready & F.col("hard")).alias("hard"), (ready & F.col("stale_critical")).alias("stale_critical"), F.concat_ws(" | ", "triggers").alias("triggers"))


def step(before: tuple, day: tuple, c: EngineConfig) -> tuple[tuple, tuple]:
    """before: state, raw score and the four streaks; day: ready, raw, hard, stale_critical. What the next day starts from, and the day's row."""
    state, last, *counts = before
    ready, raw, hard, stale = day
    if not ready or raw is None or math.isnan(raw):
        return ("WARMUP", None, 0, 0, 0, 0), ("WARMUP", None, None, False, state, 0, 0, 0, 0)
    prev = "NORMAL" if state == "WARMUP" else state
    held = bool(c.hold_last_score and stale and prev in ("DEFCON1", "DEFCON2") and last is not None and raw < last)
    raw = last if held else raw
    tests = (raw >= c.enter_2, raw >= c.enter_1, raw < c.leave_2, raw <= c.leave_1)
    counts = [n + 1 if t else 0 for n, t in zip(counts, tests)]
    state = prev
    if hard or counts[1] >= c.days_enter and prev != "DEFCON1":
        state = "DEFCON1"
    elif prev == "NORMAL" and counts[0] >= c.days_enter:
        state = "DEFCON2"
    elif prev == "DEFCON2" and counts[2] >= c.days_leave_2:
        state = "NORMAL"
    elif prev == "DEFCON1" and counts[3] >= c.days_leave_1:
        state = "DEFCON2"
    return (state, raw, *counts), (state, raw, max(raw, c.hard_floor) if hard else raw, held, prev, *counts)


def _fold(pdf: pd.DataFrame, key: str, c: EngineConfig, seed: tuple) -> pd.DataFrame:
    """One scenario's days in order. seed: what the first starts from."""
    pdf = pdf.sort_values("date")
    out = []
    for day in zip(pdf.ready, pdf.raw, pdf.hard, pdf.stale_critical):
        seed, row = step(seed, day, c)
        out.append(row)
    names = [x.split()[0] for x in STATE_SCHEMA.split(", ")]
    return pd.concat([pdf[[key, "date"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)


START = ("NORMAL", None, 0, 0, 0, 0)
_INPUT = ("date", "ready", "raw", "hard", "stale_critical")


def fold_states(days: DataFrame, key: str = "scenario", config: EngineConfig = DEFAULT) -> DataFrame:
    """The hysteresis machine over consecutive days of each scenario: days has key, date, ready, raw, hard, stale_critical.

    A day that is not ready is WARMUP and resets all. A held score feeds back into the next day, which no window expresses, so each
    scenario is one group: a few thousand rows of its calendar, whatever the observations' number."""
    kind = dict(days.dtypes)[key]
    return days.select(key, *_INPUT).groupBy(key).applyInPandas(lambda pdf: _fold(pdf, key, config, START), f"{key} {kind}, date date, {STATE_SCHEMA}")


#: The machine's states by number; a day is a table that tells for each of them which one follows.
NUMBERED = ("NORMAL", "DEFCON2", "DEFCON1", "WARMUP")


def day_table(c: EngineConfig) -> Column:
    """What each state becomes on a day whose streaks are known: an array of four numbers."""
    went, rose, fell, left = F.col("ge_1") >= c.days_enter, F.col("ge_2") >= c.days_enter, F.col("lt_2") >= c.days_leave_2, F.col("le_1") >= c.days_leave_1
    calm = F.when(went, 2).when(rose, 1).otherwise(0)
    alert = F.when(went, 2).when(fell, 0).otherwise(1)
    crisis = F.when(left, 1).otherwise(2)
    each = lambda x: F.array(x, x, x, x)
    return F.when(F.col("raw").isNull() | ~F.col("ready"), each(F.lit(3))).when(F.col("hard"), each(F.lit(2))).otherwise(F.array(calm, alert, crisis, calm))


def scan_states(days: DataFrame, key: str = "scenario", config: EngineConfig = DEFAULT, block_days: int = 512) -> DataFrame:
    """fold_states() without a fold, for days on which no score is held (no stale critical sensor, or no holding): then streaks follow from
    the scores alone, and each day is a table over the four states. Tables are put together, which may be done in any grouping: blocks of
    days in parallel, then the blocks of a key, then each block's days from the state that it starts with. Days must be consecutive."""
    c = F.col
    day = F.unix_date("date")
    ready = F.coalesce(c("ready") & c("raw").isNotNull() & ~F.isnan("raw"), F.lit(False))
    rows = days.select(key, "date", ready.alias("ready"), F.when(ready, c("raw")).alias("raw"), F.coalesce("hard", F.lit(False)).alias("hard"))
    tests = {"ge_2": c("raw") >= config.enter_2, "ge_1": c("raw") >= config.enter_1, "lt_2": c("raw") < config.leave_2, "le_1": c("raw") <= config.leave_1}
    rows = scan(rows, [key], "date", F.floor(day / block_days).cast("long"), {n: ("streak", t) for n, t in tests.items()})
    rows = rows.withColumns({"_t": day_table(config), "_blk": F.floor(day / block_days).cast("long")})
    after = lambda table, state: F.get(table, state)
    day_row = F.struct("date", "ready", "raw", "hard", *tests, c("_t").alias("t"))
    blocks = rows.groupBy(key, "_blk").agg(F.sort_array(F.collect_list(day_row)).alias("days"))
    both = lambda a, x: F.transform(a, lambda s: after(x["t"], s))
    identity = F.array(*[F.lit(k) for k in range(4)])
    tables = blocks.select(key, "_blk", F.aggregate("days", identity, both).alias("t"))
    # a row a block: the state that each starts with
    chain = tables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_blk", "t"))).alias("all"))
    walk = F.aggregate("all", F.array(F.lit(0)), lambda a, x: F.array_append(a, after(x["t"], F.element_at(a, -1))))
    starts = chain.select(key, F.inline(F.arrays_zip(F.col("all._blk").alias("_blk"), F.slice(walk, F.lit(1), F.size("all")).alias("start"))))
    states = F.aggregate("days", F.array("start"), lambda a, x: F.array_append(a, after(x["t"], F.element_at(a, -1))))
    out = blocks.join(starts, [key, "_blk"]).select(key, F.inline(F.arrays_zip("days", F.slice(states, F.lit(1), F.size("days")).alias("before"), F.slice(states, F.lit(2), F.size("days")).alias("now"))))
    name = lambda n: F.get(F.array(*[F.lit(x) for x in NUMBERED]), n)
    out = out.select(key, "days.*", "before", "now")
    prev = name(F.when(c("ready") & (c("before") == 3), 0).otherwise(c("before")))
    score_ = F.when(c("hard"), F.greatest("raw", F.lit(config.hard_floor))).otherwise(c("raw"))
    return out.select(key, "date", name(c("now")).alias("state"), c("raw").alias("raw_score"), F.when(c("ready"), score_).alias("score"), F.lit(False).alias("held"), prev.alias("prev_state"), *[c(n).cast("int").alias(n) for n in tests])


def composed_states(days: DataFrame, key: str = "scenario", config: EngineConfig = DEFAULT, block_days: int = 512) -> DataFrame:
    """fold_states(): keys of which no day can hold a score by scan_states(), the others by the fold, as a held score depends on the day before."""
    if not config.hold_last_score:
        return scan_states(days, key, config, block_days)
    risk = days.groupBy(key).agg(F.max(F.coalesce(F.col("stale_critical"), F.lit(False))).alias("_risk"))
    marked = days.join(risk, key)
    return scan_states(marked.filter("not _risk"), key, config, block_days).unionByName(fold_states(marked.filter("_risk"), key, config))


def resume_states(days: DataFrame, stored: DataFrame, key: str = "scenario", config: EngineConfig = DEFAULT) -> DataFrame:
    """As fold_states(), over the days after each scenario's last stored one, from the state and streaks stored there.

    stored: rows that fold_states() gave. To recompute a recent window, pass the stored rows before it. Without stored rows, all days."""
    kind = dict(days.dtypes)[key]
    last = stored.groupBy(key).agg(F.max_by(F.struct("date", "state", "raw_score", "ge_2", "ge_1", "lt_2", "le_1"), "date").alias("s")).select(key, "s.*")

    def run(pdf: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        start = START
        if len(seed):
            s = seed.iloc[0]
            pdf = pdf[pdf.date > s.date]
            start = (s.state, None if pd.isna(s.raw_score) else float(s.raw_score), int(s.ge_2), int(s.ge_1), int(s.lt_2), int(s.le_1))
        return _fold(pdf, key, config, start)

    return days.select(key, *_INPUT).groupBy(key).cogroup(last.groupBy(key)).applyInPandas(run, f"{key} {kind}, date date, {STATE_SCHEMA}")


def check_contiguous(stored: DataFrame, key: str = "scenario") -> None:
    """Raises ValueError if a scenario's stored days have a gap or a day twice: then only a full recomputation helps."""
    bad = contiguity(stored, [key]).filter("not contiguous").select(key).limit(5).collect()
    if bad:
        raise ValueError(f"stored states have gaps: {', '.join(str(r[0]) for r in bad)}; recompute with reset")


def recompute_states(days: DataFrame, stored: DataFrame | None, key: str = "scenario", config: EngineConfig = DEFAULT, reset: bool = False) -> DataFrame:
    """resume_states() after check_contiguous(), or all days anew with reset or without stored rows."""
    if reset or stored is None:
        return fold_states(days, key, config)
    check_contiguous(stored, key)
    return resume_states(days, stored, key, config)


def health(sensors_by_day: DataFrame) -> DataFrame:
    """One record a day of how old each sensor's value is: date, stale_critical (names), health_json."""
    one = F.struct("series_id", F.struct("as_of", "have", "age", "late", "stale").alias("h"))
    stale = F.array_sort(F.collect_list(F.when(F.col("critical") & F.col("stale") & (F.col("have") > 0), F.col("series_id"))))
    return sensors_by_day.groupBy("date").agg(stale.alias("stale_critical"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))).alias("health_json"))


def reasons(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Nested records of a day: reasons (scores, streaks, triggers, trend, allocation, thresholds) and their JSON text. With the column
    stale_critical (health()) the record names these sensors, and a held score says so among the triggers (fixed value: the text)."""
    allocation = F.struct("action", "equity", F.bround(F.col("equity") * 100, 1).alias("equity_pct"))
    streaks = F.struct("ge_2", "ge_1", "lt_2", "le_1")
    stale = F.col("stale_critical") if "stale_critical" in rows.columns else F.array().cast("array<string>")
    note = F.when(F.col("held") & (F.size(stale) > 0), F.array(F.concat(F.lit("Held last score (DEFCON safety) due to stale: "), F.array_join(stale, ", ")))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.filter(F.split("triggers", r" \| "), lambda x: x != ""), note)
    thresholds = F.struct(*[F.lit(getattr(config, n)).alias(n) for n in ("enter_2", "enter_1", "leave_2", "leave_1")])
    record = F.struct(found.alias("triggers"), "raw_score", F.col("score").alias("effective_score"), F.col("held").alias("held_last_score"), stale.alias("stale_critical_series"), "prev_state", streaks.alias("streaks"), F.struct("signal", "price", "ma").alias("trend"), allocation.alias("allocation"), thresholds.alias("thresholds"))
    return rows.withColumn("reasons", record).withColumn("reasons_json", F.to_json("reasons"))


def trend_as_of(days: DataFrame, trends: DataFrame, valid_days: int = DEFAULT.valid_days["1D"]) -> DataFrame:
    """days: series_id, date. Each day's latest trend(); a price older than valid_days gives UNKNOWN and no values."""
    seen = as_of(days, trends, ["series_id"], ["price", "ma", "vol_ann", "signal"])
    fresh = F.coalesce(F.datediff("date", "as_of") <= valid_days, F.lit(False))
    values = {c: F.when(fresh, F.col(c)) for c in ("price", "ma", "vol_ann")}
    return seen.withColumns({**values, "signal": F.when(fresh, F.col("signal")).otherwise("UNKNOWN")})


def trend(daily: DataFrame, window: int = 200, vol_window: int = 20, live: bool = False, trading_days: int = 252) -> DataFrame:
    """Per series and day: price, ma, signal (UP when the price is at least its average, DOWN below, UNKNOWN without one) and vol_ann."""
    w = by("series_id", "date")
    rows = daily.select("*", pct_change(F.col("value"), w).alias("ret"))
    rows = rolling(rows, "series_id", "date", window, {"ma": ("mean", F.col("value"))})
    vol = ewma_std(F.col("ret"), w) if live else std(F.col("ret"), w, vol_window)
    rows = rows.select("series_id", "date", F.col("value").alias("price"), "ma", (vol * math.sqrt(trading_days)).alias("vol_ann"))
    return rows.withColumn("signal", F.when(F.col("price") >= F.col("ma"), "UP").when(F.col("price") < F.col("ma"), "DOWN").otherwise("UNKNOWN"))


def fixed_allocation(state: Column, signal: Column, config: EngineConfig = DEFAULT) -> tuple[Column, Column]:
    """Action and equity weight by the table of state and trend. The actions' words."""
    weight = F.when(state == "NORMAL", 0.0)
    for (s, t), x in config.equity.items():
        weight = weight.when((state == s) & (signal == t), x)
    action = F.when(state == "NORMAL", "SELL / DISTRIBUTE").when(state == "DEFCON2", "REBALANCE / ADJUST").when(state == "DEFCON1", "BUY / ACCUMULATE").otherwise("WAIT / WARMUP")
    return action, weight


def target_allocation(state: Column, signal: Column, vol_ann: Column, config: EngineConfig = DEFAULT) -> tuple[Column, Column]:
    """Action and equity weight by trend and volatility target. The actions' words."""
    cap = config.leverage_cap if config.leverage_cap > 0 else 1.0
    fixed_action, fixed_weight = fixed_allocation(state, signal, config)
    base = F.when(vol_ann > 0, config.target_vol / F.nullif(vol_ann, F.lit(0.0))).otherwise(1.0)
    macro = F.lit(0.0)
    for s, m in config.macro.items():
        macro = F.when(state == s, m).otherwise(macro)
    sized = F.least(F.lit(cap), F.greatest(F.lit(0.0), F.least(F.lit(cap), F.greatest(F.lit(0.0), base)) * macro))
    up = F.when(state == "NORMAL", "BUY / ACCUMULATE").when(state.isin("DEFCON1", "DEFCON2"), "CAUTIOUS HOLD").otherwise("WAIT / WARMUP")
    action = F.when(state == "WARMUP", "WAIT / WARMUP").when(signal == "DOWN", "DEFENSIVE / CASH").when(signal == "UP", up).otherwise(fixed_action)
    weight = F.when(state == "WARMUP", F.lit(None).cast("double")).when(signal == "DOWN", 0.0).when((signal == "UP") & state.isin("NORMAL", "DEFCON1", "DEFCON2"), sized).when(signal == "UP", F.lit(None).cast("double")).otherwise(fixed_weight)
    return action, weight
