"""Dashboard queries: mixes, roll-ups, segments, pages, trading calendar, bull and bear phases."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip, half_up
from .prep import as_of
from .windows import by, islands

STATES = ("NORMAL", "DEFCON2", "DEFCON1", "WARMUP")


def state_mix(states: DataFrame, all_states: Sequence[str] = STATES) -> DataFrame:
    """Days and percentage of every state, those without a day too."""
    dim = states.sparkSession.createDataFrame([(s,) for s in all_states], "state string")
    counts = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    rows = F.broadcast(dim).join(counts, "state", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.withColumn("pct", F.col("n") * 100 / F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1)))


def rollup(states: DataFrame, period: str, key: str = "scenario") -> DataFrame:
    """states: key, date, state, score, triggers, trading. By week (its Sunday) or month end: mean score, most frequent state (of equals
    the one seen first), last row's triggers, and as date the last trading day, else the last day."""
    bucket = F.next_day(F.date_sub("date", 1), "SU") if period == "week" else F.last_day("date")
    rows = states.withColumn("bucket", bucket)
    per = rows.groupBy(key, "bucket", "state").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.sum("score").alias("s"), F.count("score").alias("k"), F.max(F.struct("date", "triggers")).alias("last"), F.max(F.when(F.col("trading"), F.col("date"))).alias("traded"))
    out = per.groupBy(key, "bucket").agg(F.min_by("state", F.struct(-F.col("n"), "first")).alias("state"), (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("score"), F.sum("n").alias("n_days"), F.max("last").alias("last"), F.max("traded").alias("traded"))
    text = F.concat(F.col("n_days").cast("string"), F.lit(" days aggregated. Last: "), F.coalesce("last.triggers", F.lit("")))
    return out.select(key, "bucket", F.coalesce("traded", "last.date").alias("date"), "state", "score", "n_days", text.alias("triggers"))


def segments(states: DataFrame, key: str = "scenario", value: str = "state", past_end: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """Runs of equal state: start, end (the next run's start; of the last run the day after its last day, or without past_end that day), days.

    only: the states whose runs are returned, once all runs are cut."""
    runs = islands(states, value, key, "date").groupBy(key, "run", value).agg(F.min("date").alias("start"), F.max("date").alias("last"))
    end = F.coalesce(F.lead("start").over(by(key, "run")), F.date_add("last", int(past_end)))
    out = runs.select(key, value, "start", end.alias("end")).withColumn("days", F.datediff("end", "start"))
    return out if only is None else out.filter(F.col(value).isin(*only))


#: Years of the presets of a range; `max` is all days, and `default` starts with the first day that is not WARMUP.
PRESETS = {"1y": 1, "5y": 5, "10y": 10}


def clamp_range(first: Column, last: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """start and end within first and last; an end before the start gives the start's day alone."""
    low = F.greatest(first, start)
    return low, F.greatest(low, F.least(last, end))


def range_presets(states: DataFrame, key: str = "scenario", by_calendar: bool = True) -> DataFrame:
    """The days that each preset shows of a key: key, preset, start, end. Years are those of the calendar, or 365 days each."""
    ready = F.when(F.col("state").isNotNull() & (F.col("state") != "") & (F.col("state") != "WARMUP"), F.col("date"))
    bounds = states.groupBy(key).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min(ready).alias("ready"))
    back = lambda n: F.add_months("last", -12 * n) if by_calendar else F.date_sub("last", 365 * n)
    starts = {"max": F.col("first"), "default": F.coalesce("ready", "first"), **{name: back(n) for name, n in PRESETS.items()}}
    rows = bounds.select(key, "first", "last", F.inline(F.array(*[F.struct(F.lit(name).alias("preset"), start.alias("from")) for name, start in starts.items()])))
    start, end = clamp_range(F.col("first"), F.col("last"), F.col("from"), F.col("last"))
    return rows.select(key, "preset", start.alias("start"), end.alias("end"))


def relaxed_pages(rows: DataFrame, found: Column, states: Sequence[str], trading: Column, key: str = "scenario", size: int = 200) -> DataFrame:
    """How many filters must go until each day can be seen, and the page (from 0, newest first) that it is on then: key, date, dropped, page.

    The filters are a search (found), the states shown, and trading days alone (trading). dropped 0: the day is seen with all
    of them; 1: without the search; 2: its own state is shown too; 3: all days are shown. One shuffle counts for every day at once."""
    c, shown = F.col, F.coalesce(F.col("state").isin(*states), F.lit(False))
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.select(key, "date", "state", yes(found).alias("_found"), shown.alias("_shown"), yes(trading).alias("_open"))
    kept = [c("_found") & c("_shown") & c("_open"), c("_shown") & c("_open"), c("_open"), F.lit(True)]
    newer, own = W.partitionBy(key).orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key, "state").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)
    count = lambda test, w: F.count(F.when(test, 1)).over(w)
    more = lambda test: count(c("_shown") & test, newer) + F.when(c("_shown"), 0).otherwise(count(test, own))  # noqa: E731  a state that is shown for a day shows all of its days
    before = [count(kept[0], newer), count(kept[1], newer), more(c("_open")), more(F.lit(True))]
    dropped = F.when(kept[0], 0).when(kept[1], 1).when(kept[2], 2).otherwise(3)
    rows = rows.select(key, "date", dropped.alias("dropped"), F.array(*before).alias("_before"))
    return rows.select(key, "date", "dropped", F.floor(F.get("_before", F.col("dropped")) / size).cast("int").alias("page"))


def flag_ranges(points: DataFrame, flag: str, key: str = "scenario") -> DataFrame:
    """Ranges where the flag holds: from its first day to the first day off, or to the last point."""
    on = points.withColumn("_on", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    runs = islands(on, "_on", key, "date").groupBy(key, "run", "_on").agg(F.min("date").alias("start"), F.max("date").alias("last"))
    runs = runs.withColumn("end", F.coalesce(F.lead("start").over(by(key, "run")), F.col("last")))
    return runs.filter("_on").select(key, "start", "end")


def page(rows: DataFrame, number: int, size: int = 200, order: str = "date", tie: str | None = None) -> DataFrame:
    """One page, newest first. Numbers too large give the last page.

    The rows of each day are counted first (a row a calendar day reaches the driver), so only the page's own days are sorted."""
    days = rows.groupBy(order).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(order)).collect()
    pages = max(1, -(-sum(d.n for d in days) // size))
    skip, first, last = (min(max(1, number), pages) - 1) * size, None, None
    left, before = skip + size, 0
    for d in days:
        if before + d.n > skip:
            first, last = (first or (d[order], before)), d[order]
        before += d.n
        if before >= left:
            break
    if first is None:
        return rows.limit(0)
    near = rows.filter(F.col(order).between(F.lit(last), F.lit(first[0])))
    return near.orderBy(F.desc(order), *([tie] if tie else [])).offset(skip - first[1]).limit(size)


def portfolio_text(weights: DataFrame, key: str = "date") -> DataFrame:
    """weights: key, series_id, weight, gross, cash. A line of each date that a search can look through, largest weight first."""
    one = F.transform(F.sort_array(F.collect_list(F.when(F.col("weight") > 0, F.struct((-F.col("weight")).alias("w"), "series_id")))), lambda x: F.format_string("%s %.1f%%", x["series_id"], -x["w"] * 100))
    text = F.concat_ws(" | ", F.col("parts"), F.format_string("CASH %.1f%%", F.col("cash") * 100), F.format_string("GROSS %.2fx", F.col("gross")))
    rows = weights.groupBy(key).agg(one.alias("parts"), F.max("cash").alias("cash"), F.max("gross").alias("gross"))
    return rows.select(key, text.alias("text"))


def portfolio_search(states: DataFrame, texts: DataFrame, text: str, key: str = "scenario") -> DataFrame:
    """Days whose portfolio, the latest up to the day, holds the text, whatever its case. states: key, date; texts: date, text."""
    one = F.lit(1).alias("_k")
    seen = as_of(states.select("date", one).distinct(), texts.select("date", "text", one), ["_k"], ["text"]).drop("_k")  # a row a calendar day
    return states.join(text_search(seen, text, ["text"]), "date")


def in_range(rows: DataFrame, start, end, states: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("date").between(F.lit(start), F.lit(end)) & F.col("state").isin(*states))


def text_search(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns hold the text, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.filter(hit)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous algorithm."""
    div, mod = lambda a, b: F.floor(a / b), lambda a, b: F.pmod(a, F.lit(b))
    golden, century, rest = mod(year, 19), div(year, 100), mod(year, 100)
    epact = mod(19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15, 30)
    weekday = mod(32 + 2 * mod(century, 4) + 2 * div(rest, 4) - epact - mod(rest, 4), 7)
    shift = epact + weekday - 7 * div(golden + 11 * epact + 22 * weekday, 451) + 114
    return F.make_date(year, div(shift, 31).cast("int"), (mod(shift, 31) + 1).cast("int"))


def us_holidays(year: Column) -> list[Column]:
    """The ten exchange holidays of a year: fixed ones observed on the nearest weekday, nth weekdays, and Good Friday."""

    def fixed(month: int, day: int) -> Column:
        d = F.make_date(year, F.lit(month), F.lit(day))
        return F.when(F.dayofweek(d) == 7, F.date_sub(d, 1)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)

    def nth(month: int, weekday: str, n: int) -> Column:
        return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (n - 1))

    last_monday = F.date_sub(F.next_day(F.make_date(year, F.lit(5), F.lit(31)), "MO"), 7)
    return [fixed(1, 1), nth(1, "MO", 3), nth(2, "MO", 3), F.date_sub(easter(year), 2), last_monday, fixed(6, 19), fixed(7, 4), nth(9, "MO", 1), nth(11, "TH", 4), fixed(12, 25)]


def trading_day(date: Column) -> Column:
    """A weekday that is no exchange holiday of its year or the next (whose New Year may fall on 31 December)."""
    year = F.year(date)
    holidays = F.array(*us_holidays(year), us_holidays(year + 1)[0])
    return ~F.dayofweek(date).isin(1, 7) & ~F.array_contains(holidays, date)


def turn(before: tuple | None, date, value: float, fall: float, rise: float) -> tuple[tuple, tuple | None]:
    """before: regime, start and level of the open segment, None before the first value. The open segment after the value, and the one that it closes."""
    regime, start, level = before or ("BULL", date, value)
    level = max(level, value) if regime == "BULL" else min(level, value)
    if value <= level * fall if regime == "BULL" else value >= level * rise:
        return ("BEAR" if regime == "BULL" else "BULL", date, value), (regime, start, date, False)
    return (regime, start, level), None


def bull_bear(closes: DataFrame, fall: float = 0.8, rise: float = 1.2, key: str = "series_id") -> DataFrame:
    """closes: key, date, value. Segments: regime, start, end, days, open. BULL turns at `fall` of its peak, BEAR at `rise` of its trough.

    The level restarts at each turn, which is a fold over one series' days."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("date")
        out, names = [], [key, "regime", "start", "end", "open"]
        if len(pdf) < 2:
            return pd.DataFrame(out, columns=names)
        name, segment = pdf[key].iloc[0], None
        for date, value in zip(pdf.date, pdf.value):
            segment, closed = turn(segment, date, value, fall, rise)
            out += [(name, *closed)] if closed else []
        out.append((name, *segment[:2], pdf.date.iloc[-1], True))
        return pd.DataFrame(out, columns=names)

    rows = closes.select(key, "date", "value").groupBy(key).applyInPandas(run, f"{key} string, regime string, start date, end date, open boolean")
    return rows.withColumn("days", F.datediff("end", "start"))


def phase_gauge(segments_: DataFrame, key: str = "series_id", least: int = 20, last: int = 12) -> DataFrame:
    """Of each series' open segment: typical length, progress, predicted switch and its window, stage."""
    done = segments_.filter(~F.col("open") & (F.col("days") >= least)).withColumn("_n", F.row_number().over(W.partitionBy(key, "regime").orderBy(F.desc("start"))))
    typical = done.filter(F.col("_n") <= last).groupBy(key, "regime").agg(F.percentile("days", F.lit(0.5)).alias("typical"))
    rows = segments_.filter("open").join(typical, [key, "regime"], "left")
    rows = rows.withColumn("typical", F.coalesce("typical", F.when(F.col("regime") == "BULL", 252.0).otherwise(126.0)))
    switch, half = F.date_add("start", half_up(F.col("typical")).cast("int")), F.greatest(F.lit(1), half_up(F.col("typical") * 0.2).cast("int"))
    rows = rows.withColumns({"progress": clip(F.col("days") / F.nullif(F.col("typical"), F.lit(0.0)), 0, 1), "switch": switch, "window_start": F.date_sub(switch, half), "window_end": F.date_add(switch, half)})
    return rows.withColumns({"stage": F.when(F.col("progress") < 0.33, "early").when(F.col("progress") < 0.66, "middle").otherwise("late"), "in_window": F.col("progress") >= 0.8})


def all_at_least(rows: DataFrame, key: str, value: str, last: int = 120, least_rows: int = 30, floor: float = 0.999) -> DataFrame:
    """Whether each key's last values all reach the floor, given enough of them."""
    tail = rows.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("date")))).filter(F.col("_n") <= last)
    return tail.groupBy(key).agg(((F.count(F.lit(1)) >= least_rows) & F.min(F.col(value) >= floor)).alias("saturated"))


def range_return(daily: DataFrame, start, end, key: str = "series_id") -> DataFrame:
    """Percentage between the first value from start on and the last up to end."""
    rows = daily.filter(F.col("date").between(F.lit(start), F.lit(end)))
    first, last = F.min_by("value", "date"), F.max_by("value", "date")
    return rows.groupBy(key).agg(((last - first) / F.nullif(first, F.lit(0.0)) * 100).alias("pct"))
