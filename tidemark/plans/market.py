"""Queries of the score, state machine, allocation, and portfolio."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import portfolio as P
from ..operators import prep
from ..operators import score as S
from ..sources import files
from ..streaming.folders import shared_folder
from .base import DAILY_SQL, daily, orders_obs, query, r, table

#: The order priorities play the sensors; CURVE is the low-priority series about its middle.
SENSORS = (
    S.Sensor("CURVE", "curve"), S.Sensor("2-HIGH", "spread", 150000.0), S.Sensor("3-MEDIUM", "activity", 170000.0, "1W", True),
    S.Sensor("4-NOT SPECIFIED", "ratio", 0.0, "1W", True), S.Sensor("5-LOW", "sentiment", 200000.0, "1D", True), S.Sensor("1-URGENT", "hard", 480000.0),
)
MA, BACK = 200, 20

_OVER = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W = "OVER (PARTITION BY series_id ORDER BY date)"
FEATURES_SQL = f"""{DAILY_SQL},
sens(series_id, rule, level, valid, critical) AS (VALUES ('CURVE', 'curve', 0.0, 4, false), ('2-HIGH', 'spread', 150000.0, 4, false), ('3-MEDIUM', 'activity', 170000.0, 21, true), ('4-NOT SPECIFIED', 'ratio', 0.0, 21, true), ('5-LOW', 'sentiment', 200000.0, 4, true), ('1-URGENT', 'hard', 480000.0, 4, false)),
allobs AS (SELECT * FROM daily UNION ALL SELECT 'CURVE', date, value - 150000 FROM daily WHERE series_id = '5-LOW'),
f0 AS (SELECT series_id, date, value, count(value) {_W} AS have, CASE WHEN count(value) {_OVER.format(n=MA - 1)} >= {MA} THEN avg(value) {_OVER.format(n=MA - 1)} END AS ma FROM allobs),
feat AS (SELECT series_id, date, date AS as_of, value, have, ma, coalesce(lag(value) {_W} < 0 AND value >= 0, false) AS crossed, value - coalesce(lag(value, {BACK}) {_W}, first_value(value) {_W}) AS slope,
 CASE WHEN count(value) {_OVER.format(n=3)} >= 4 THEN avg(value) {_OVER.format(n=3)} END AS mean_4, count(*) {_OVER.format(n=4)} = 5 AND bool_and(coalesce(value < ma, false)) {_OVER.format(n=4)} AS below_5 FROM f0),
bounds AS (SELECT min(date) AS a, max(date) AS z FROM daily),
days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
grid AS (SELECT days.date, sens.* FROM days, sens),
seen AS (SELECT g.*, f.as_of, f.value, coalesce(f.have, 0) AS have, f.ma, f.crossed, f.slope, f.mean_4, f.below_5 FROM grid g ASOF LEFT JOIN feat f ON g.series_id = f.series_id AND g.date >= f.date),
aged AS (SELECT *, date_diff('day', as_of, date) AS age, coalesce(date_diff('day', as_of, date) > valid, true) AS late, coalesce(date_diff('day', as_of, date) > valid + 1, true) AS stale FROM seen),
hits AS (SELECT *, coalesce(CASE rule WHEN 'curve' THEN crossed WHEN 'spread' THEN value >= level AND slope >= 0 WHEN 'activity' THEN value < level AND mean_4 < level WHEN 'ratio' THEN below_5 WHEN 'sentiment' THEN value < level ELSE value >= level END, false) AND NOT stale AS hit FROM aged),
scored AS (SELECT date, coalesce(bool_and(have > 0) FILTER (critical), true) AS ready, sum(CASE WHEN hit THEN CASE rule WHEN 'curve' THEN 2.0 WHEN 'spread' THEN 1.5 WHEN 'activity' THEN 1.0 WHEN 'hard' THEN 0.0 ELSE 0.5 END ELSE 0.0 END)::DOUBLE AS points,
 bool_or(rule = 'hard' AND hit) AS hard, bool_or(critical AND stale AND have > 0) AS sc, coalesce(string_agg(rule, ' | ' ORDER BY rule) FILTER (hit), '') AS triggers FROM hits GROUP BY date),
score AS (SELECT date, ready, CASE WHEN ready THEN points END AS raw, ready AND hard AS hard, ready AND sc AS stale_critical, triggers FROM scored)"""
#: The machine as a recursion over consecutive days. s: state, p: raw score of the day before, g2 .. l1: streaks.
STATES_SQL = f"""{FEATURES_SQL},
num AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) AS n FROM score),
fold AS (
 SELECT 0::BIGINT AS n, NULL::DATE AS date, 'NORMAL' AS state, NULL::DOUBLE AS raw_score, NULL::DOUBLE AS score, false AS held, NULL::VARCHAR AS prev_state, 0 AS g2, 0 AS g1, 0 AS l2, 0 AS l1
 UNION ALL
 SELECT n, date, CASE WHEN NOT ready THEN 'WARMUP' WHEN hard THEN 'DEFCON1' WHEN p <> 'DEFCON1' AND k1 >= 3 THEN 'DEFCON1' WHEN p = 'NORMAL' AND k2 >= 3 THEN 'DEFCON2' WHEN p = 'DEFCON2' AND j2 >= 5 THEN 'NORMAL' WHEN p = 'DEFCON1' AND j1 >= 10 THEN 'DEFCON2' ELSE p END,
  x, CASE WHEN ready THEN CASE WHEN hard THEN greatest(x, 3.5) ELSE x END END, h, CASE WHEN ready THEN p ELSE was END, k2, k1, j2, j1
 FROM (SELECT *, CASE WHEN x >= 2.0 THEN g2 + 1 ELSE 0 END AS k2, CASE WHEN x >= 3.5 THEN g1 + 1 ELSE 0 END AS k1, CASE WHEN x < 2.0 THEN l2 + 1 ELSE 0 END AS j2, CASE WHEN x <= 3.0 THEN l1 + 1 ELSE 0 END AS j1
  FROM (SELECT *, CASE WHEN ready THEN CASE WHEN h THEN before ELSE raw END END AS x FROM (
   SELECT d.n, d.date, d.ready, d.raw, d.hard, f.state AS was, f.raw_score AS before, f.g2, f.g1, f.l2, f.l1, CASE WHEN f.state = 'WARMUP' THEN 'NORMAL' ELSE f.state END AS p,
    coalesce(d.ready AND d.stale_critical AND f.state IN ('DEFCON1', 'DEFCON2') AND d.raw < f.raw_score, false) AS h
   FROM fold f JOIN num d ON d.n = f.n + 1))))"""


def with_curve(d: DataFrame) -> DataFrame:
    """The days' values and CURVE, which is made of one of the series as it passes, so that they are aggregated once."""
    own, curve = F.struct("series_id", "date", "value"), F.struct(F.lit("CURVE").alias("series_id"), "date", (F.col("value") - 150000).alias("value"))
    return d.select(F.inline(F.when(F.col("series_id") == "5-LOW", F.array(own, curve)).otherwise(F.array(own))))


def observations(spark, sf) -> DataFrame:
    return with_curve(daily(spark, sf))


def calendar_days(d: DataFrame) -> DataFrame:
    return prep.calendar(d.agg(F.min("date").alias("first"), F.max("date").alias("last")))


def sensor_days(spark, sf) -> DataFrame:
    dates = orders_obs(spark, sf).select(F.col("ts").cast("date").alias("date"))  # the bounds need no aggregate of the days
    return S.sensor_days(calendar_days(dates), observations(spark, sf), SENSORS, ma_window=MA, back=BACK)


def states(spark, sf) -> DataFrame:
    return S.fold_states(S.day_scores(sensor_days(spark, sf)).withColumn("scenario", F.lit("batch")))


@query(f"WITH {FEATURES_SQL} SELECT date, series_id, as_of, have, age, late, stale FROM aged")
def health_ready(spark, sf):
    return sensor_days(spark, sf).select("date", "series_id", "as_of", "have", F.col("age").cast("long"), "late", "stale")


@query(f"WITH {FEATURES_SQL} SELECT date, ready, raw, hard, stale_critical, triggers FROM score")
def component_scores(spark, sf):
    return S.day_scores(sensor_days(spark, sf))


@query(f"""WITH {FEATURES_SQL} SELECT date, sum(CASE WHEN coalesce(CASE rule WHEN 'curve' THEN crossed WHEN 'spread' THEN value >= level WHEN 'activity' THEN value < level WHEN 'ratio' THEN value < ma WHEN 'sentiment' THEN value < level END, false)
 THEN CASE rule WHEN 'curve' THEN 2.0 WHEN 'spread' THEN 1.5 WHEN 'activity' THEN 1.0 ELSE 0.5 END ELSE 0.0 END)::DOUBLE AS points FROM aged GROUP BY date HAVING bool_and(have > 0) FILTER (critical)""")
def component_scores_live(spark, sf):
    return S.day_scores(sensor_days(spark, sf), batch=False).filter("ready").select("date", F.col("raw").alias("points"))


@query(f"WITH RECURSIVE {STATES_SQL} SELECT date, state, raw_score, score, held, prev_state, g2 AS ge_2, g1 AS ge_1, l2 AS lt_2, l1 AS le_1 FROM fold WHERE n > 0")
def daily_states(spark, sf):
    return states(spark, sf).drop("scenario")


#: The machine without held scores.
HELD = "coalesce(d.ready AND d.stale_critical AND f.state IN ('DEFCON1', 'DEFCON2') AND d.raw < f.raw_score, false)"


@query(f"WITH RECURSIVE {STATES_SQL.replace(HELD, 'false')} SELECT date, state, raw_score, score, held, prev_state, g2 AS ge_2, g1 AS ge_1, l2 AS lt_2, l1 AS le_1 FROM fold WHERE n > 0")
def daily_states_composed(spark, sf):
    """The states without held scores, from tables of days that are put together in blocks, without a fold."""
    days = S.day_scores(sensor_days(spark, sf)).withColumn("scenario", F.lit("batch"))
    return S.composed_states(days, config=replace(DEFAULT, hold_last_score=False)).drop("scenario")


@query(f"WITH RECURSIVE {STATES_SQL} SELECT date, state, raw_score, g2 AS ge_2 FROM fold WHERE n > 0 AND date > DATE '2000-01-01'")
def daily_states_resumed(spark, sf):
    """The days after a stored part of the history, computed from its last row."""
    cut = F.lit("2000-01-01").cast("date")
    stored = states(spark, sf).filter(F.col("date") <= cut)
    scores = S.day_scores(sensor_days(spark, sf)).withColumn("scenario", F.lit("batch"))
    return S.resume_states(scores, stored).select("date", "state", "raw_score", "ge_2")


@query(f"""WITH RECURSIVE {STATES_SQL} SELECT f.date, f.state, len(string_split(CASE WHEN s.triggers = '' THEN NULL ELSE s.triggers END, ' | ')) AS n_triggers, f.score AS effective_score, f.held, f.prev_state, CASE f.state WHEN 'NORMAL' THEN 'SELL / DISTRIBUTE' WHEN 'DEFCON2' THEN 'REBALANCE / ADJUST' WHEN 'DEFCON1' THEN 'BUY / ACCUMULATE' ELSE 'WAIT / WARMUP' END AS action,
CASE f.state WHEN 'NORMAL' THEN 0.0 WHEN 'DEFCON2' THEN 40.0 WHEN 'DEFCON1' THEN 80.0 END::DOUBLE AS equity_pct FROM fold f JOIN score s USING (date) WHERE n > 0""")
def reasons_record(spark, sf):
    """The nested record of each day, read back from its JSON text."""
    scores = S.day_scores(sensor_days(spark, sf))
    action, equity = S.fixed_allocation(F.col("state"), F.lit("UNKNOWN"))
    none = F.lit(None).cast("double")
    rows = states(spark, sf).join(scores.select("date", "triggers"), "date").withColumns({"action": action, "equity": equity, "signal": F.lit("UNKNOWN"), "price": none, "ma": none})
    parsed = F.from_json("reasons_json", "triggers array<string>, effective_score double, held_last_score boolean, prev_state string, allocation struct<action: string, equity_pct: double>")
    rows = S.reasons(rows).withColumn("p", parsed)
    n = F.nullif(F.size("p.triggers"), F.lit(0)).cast("long")
    return rows.select("date", "state", n.alias("n_triggers"), "p.effective_score", F.col("p.held_last_score").alias("held"), "p.prev_state", "p.allocation.action", "p.allocation.equity_pct")


TREND_SQL = f"""rets AS (SELECT series_id, date, value, value / nullif(lag(value) {_W}, 0) - 1 AS ret FROM daily),
trend0 AS (SELECT series_id, date, value AS price, CASE WHEN count(value) {_OVER.format(n=199)} >= 200 THEN avg(value) {_OVER.format(n=199)} END AS ma, CASE WHEN count(ret) {_OVER.format(n=19)} >= 20 THEN stddev_samp(ret) {_OVER.format(n=19)} * sqrt(252) END AS vol_ann FROM rets),
trend AS (SELECT *, CASE WHEN price >= ma THEN 'UP' WHEN price < ma THEN 'DOWN' ELSE 'UNKNOWN' END AS signal FROM trend0)"""


def trends(spark, sf) -> DataFrame:
    return S.trend(daily(spark, sf))


@query(f"WITH {DAILY_SQL}, {TREND_SQL} SELECT series_id, date, round(price, 4) + 0.0 AS price, round(ma, 6) + 0.0 AS ma, signal, round(vol_ann, 5) + 0.0 AS vol_ann FROM trend")
def trend_signal(spark, sf):
    return trends(spark, sf).select("series_id", "date", r("price").alias("price"), r("ma", 6).alias("ma"), "signal", r("vol_ann", 5).alias("vol_ann"))


ALLOC_SQL = f"""{DAILY_SQL}, {TREND_SQL}, st AS (SELECT *, CASE day(date) % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'DEFCON2' WHEN 2 THEN 'DEFCON1' ELSE 'WARMUP' END AS state FROM trend)"""
_FIXED_W = "CASE WHEN state = 'NORMAL' THEN 0.0 WHEN state = 'DEFCON2' THEN CASE signal WHEN 'UP' THEN 0.5 WHEN 'DOWN' THEN 0.3 ELSE 0.4 END WHEN state = 'DEFCON1' THEN CASE signal WHEN 'UP' THEN 0.7 WHEN 'DOWN' THEN 1.0 ELSE 0.8 END END"
_FIXED_A = "CASE state WHEN 'NORMAL' THEN 'SELL / DISTRIBUTE' WHEN 'DEFCON2' THEN 'REBALANCE / ADJUST' WHEN 'DEFCON1' THEN 'BUY / ACCUMULATE' ELSE 'WAIT / WARMUP' END"


def with_state(rows: DataFrame) -> DataFrame:
    k = F.dayofmonth("date") % 4
    return rows.withColumn("state", F.when(k == 0, "NORMAL").when(k == 1, "DEFCON2").when(k == 2, "DEFCON1").otherwise("WARMUP"))


@query(f"WITH {ALLOC_SQL} SELECT series_id, date, state, signal, {_FIXED_A} AS action, CAST({_FIXED_W} AS DOUBLE) AS equity FROM st")
def allocation_fixed(spark, sf):
    action, equity = S.fixed_allocation(F.col("state"), F.col("signal"))
    return with_state(trends(spark, sf)).select("series_id", "date", "state", "signal", action.alias("action"), equity.alias("equity"))


@query(f"""WITH {ALLOC_SQL} SELECT series_id, date, state, CASE WHEN state = 'WARMUP' THEN 'WAIT / WARMUP' WHEN signal = 'DOWN' THEN 'DEFENSIVE / CASH' WHEN signal = 'UP' THEN CASE WHEN state = 'NORMAL' THEN 'BUY / ACCUMULATE' ELSE 'CAUTIOUS HOLD' END ELSE {_FIXED_A} END AS action,
round(CASE WHEN state = 'WARMUP' THEN NULL WHEN signal = 'DOWN' THEN 0.0 WHEN signal = 'UP' THEN least(2.0, greatest(0.0, CASE WHEN vol_ann > 0 THEN 0.41 / vol_ann ELSE 1.0 END)) ELSE {_FIXED_W} END, 6) + 0.0 AS equity FROM st""")
def allocation_voltarget(spark, sf):
    action, equity = S.target_allocation(F.col("state"), F.col("signal"), F.col("vol_ann"))
    return with_state(trends(spark, sf)).select("series_id", "date", "state", action.alias("action"), r(equity, 6).alias("equity"))


YIELD_SQL = """ship AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, 1 + 100 * l_discount AS value, l_orderkey, l_linenumber FROM lineitem),
yields AS (SELECT series_id, date, value FROM ship QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY l_orderkey DESC, l_linenumber DESC, value DESC) = 1)"""


@query(f"""WITH {YIELD_SQL}, a AS (SELECT series_id, date, value AS y, lag(value) {_W} AS b FROM yields)
SELECT series_id, date, round(product(1 + coalesce(b / 100 / 252 - 1.9 * (y - b) / 100, 0)) {_W}, 5) + 0.0 AS value FROM a""")
def bond_index(spark, sf):
    y = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"))
    y = y.agg(F.max(F.struct("l_orderkey", "l_linenumber", (1 + 100 * F.col("l_discount")).alias("value")))["value"].alias("value"))
    return P.bond_index(y, DEFAULT.bond2_duration).select("series_id", "date", r("value", 5).alias("value"))


@query(f"""WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS v, 1 + 100 * max(l_discount) AS y FROM lineitem GROUP BY 1), a AS (SELECT *, lag(y) OVER (ORDER BY date) AS b FROM p)
SELECT u.series_id, date, round(CASE u.series_id WHEN 'NASDAQ' THEN v WHEN 'GOLD' THEN v / 2 ELSE product(1 + coalesce(b / 100 / 252 - CASE u.series_id WHEN 'UST10Y' THEN 8.5 ELSE 1.9 END * (y - b) / 100, 0)) OVER (PARTITION BY u.series_id ORDER BY date) END, 5) + 0.0 AS value
FROM a, (VALUES ('NASDAQ'), ('GOLD'), ('UST10Y'), ('UST2Y')) u(series_id)""")
def price_matrix(spark, sf):
    """Prices and bond indices from a wide file of text."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("time")).agg(F.max("l_extendedprice").alias("close"), (1 + 100 * F.max("l_discount")).alias("y"))
    wide, path = lines.select("time", "close", (F.col("close") / 2).alias("XAUUSD spot"), F.col("y").alias("US10Y yield"), F.col("y").alias("US2Y yield")), shared_folder(spark, "prices")
    wide.write.option("header", True).csv(path)
    return files.price_matrix(spark, path).select("series_id", "date", r("value", 5).alias("value"))


#: Assets for the portfolio: three groups of orders, whose lines ship on nearly every day, as windows of 200 rows need them.
PRICE_SQL = "daily AS (SELECT 'A' || (l_orderkey % 3) AS series_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
ASSETS, RISK = ("A0", "A1", "A2"), ("A0", "A1")


def prices(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.concat(F.lit("A"), (F.col("l_orderkey") % 3).cast("string")).alias("series_id"), F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_extendedprice").alias("value"))


PORT_SQL = f"""{PRICE_SQL}, ds AS (SELECT DISTINCT date FROM daily), ids AS (SELECT DISTINCT series_id FROM daily), grid AS (SELECT ds.date, ids.series_id, value FROM ds CROSS JOIN ids LEFT JOIN daily USING (date, series_id)),
g1 AS (SELECT *, value / nullif(lag(value) {_W}, 0) - 1 AS ret FROM grid),
g2 AS (SELECT *, CASE WHEN count(value) {_OVER.format(n=199)} >= 200 THEN avg(value) {_OVER.format(n=199)} END AS ma, CASE WHEN count(ret) {_OVER.format(n=19)} >= 20 THEN stddev_samp(ret) {_OVER.format(n=19)} * sqrt(252) END AS vol_ann FROM g1),
g3 AS (SELECT *, greatest(0, CASE WHEN coalesce(value >= ma, false) AND coalesce(vol_ann > 0, false) THEN least(2.0, 0.35 / vol_ann) ELSE 0 END * CASE WHEN series_id IN ('A0', 'A1') THEN CASE WHEN day(date) % 4 = 3 THEN 0.0 ELSE 1.0 END ELSE 1.0 END) AS raw_weight FROM g2),
g4 AS (SELECT *, sum(raw_weight) OVER (PARTITION BY date) AS total FROM g3),
port AS (SELECT *, CASE WHEN total > 2.0 THEN raw_weight * 2.0 / total ELSE raw_weight END AS weight FROM g4)"""


def portfolio(spark, sf, multipliers: DataFrame | None = None) -> DataFrame:
    """multipliers: date, risk_multiplier; the latest of each day scales the risk assets."""
    rows, macro = with_state(P.price_grid(prices(spark, sf), ASSETS)), P.macro_multiplier(F.col("state"))
    if multipliers is not None:
        rows, macro = P.with_multiplier(rows, multipliers), macro * F.col("risk_multiplier")
    return P.scale_gross(P.asset_weights(rows, macro, RISK)).withColumn("portfolio", F.lit("all"))


@query(f"WITH {PORT_SQL} SELECT date, series_id, round(weight, 6) + 0.0 AS weight, round(sum(weight) OVER (PARTITION BY date), 6) + 0.0 AS gross, round(1 - sum(weight) OVER (PARTITION BY date), 6) + 0.0 AS cash FROM port")
def portfolio_weights(spark, sf):
    return portfolio(spark, sf).select("date", "series_id", r("weight", 6).alias("weight"), r("gross", 6).alias("gross"), r("cash", 6).alias("cash"))


@query("SELECT o_orderkey, CASE WHEN l = 1 THEN 1.2 WHEN l = 2 THEN 1.0 WHEN l >= 3 THEN 0.6 ELSE 2.0 END::DOUBLE AS cap, CASE WHEN l = 1 THEN 0.85 WHEN l = 2 THEN 0.7 WHEN l >= 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS multiplier FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN 1 WHEN o_orderkey % 7 = 5 THEN 0 ELSE o_orderkey % 7 END AS l FROM orders)")
def portfolio_overlay(spark, sf):
    k = F.col("o_orderkey") % 7
    cap, mult = P.fear_overlay(F.when(k < 5, k), (k == 6).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", cap.alias("cap"), mult.alias("multiplier"))


CURVE_SQL = f"""{PORT_SQL}, lagged AS (SELECT *, coalesce(lag(weight) {_W}, 0) AS held FROM port), pr AS (SELECT date, sum(weight) AS gross, sum(held * coalesce(ret, 0)) * 0.01 AS ret FROM lagged GROUP BY date),
pc AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS curve FROM pr), pd AS (SELECT *, curve / max(curve) OVER (ORDER BY date) - 1 AS dd FROM pc)"""


def curve(spark, sf) -> DataFrame:
    return P.backtest(portfolio(spark, sf).withColumn("ret", F.col("ret") * 0.01))


@query(f"WITH {CURVE_SQL} SELECT date, round(gross, 6) + 0.0 AS gross, round(ret, 7) + 0.0 AS ret, round(curve, 6) + 0.0 AS curve, round(dd, 6) + 0.0 AS dd FROM pd")
def portfolio_backtest(spark, sf):
    return curve(spark, sf).select("date", r("gross", 6).alias("gross"), r("ret", 7).alias("ret"), r("curve", 6).alias("curve"), r("dd", 6).alias("dd"))


@query(f"WITH {CURVE_SQL} SELECT round(pow(arg_max(curve, date), 252.0 / count(*)) - 1, 6) + 0.0 AS cagr, round(min(dd), 6) + 0.0 AS mdd, round(avg(gross), 6) + 0.0 AS avg_gross, count(*) AS n_days FROM pd")
def portfolio_metrics(spark, sf):
    return P.metrics(curve(spark, sf)).select(r("cagr", 6).alias("cagr"), r("mdd", 6).alias("mdd"), r("avg_gross", 6).alias("avg_gross"), "n_days")


@query(f"WITH {PORT_SQL} SELECT date, series_id, row_number() OVER (PARTITION BY date ORDER BY weight DESC, series_id) AS rank FROM port WHERE weight > 0 QUALIFY rank <= 2")
def topk_weights(spark, sf):
    return P.top_weights(portfolio(spark, sf), 2).select("date", "series_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PORT_SQL}, g AS (SELECT date, sum(weight) AS gross FROM port GROUP BY date) SELECT date, series_id, round(gross / 2, 6) + 0.0 AS gross, round(1 - gross / 2, 6) + 0.0 AS cash, round(weight / 2, 6) + 0.0 AS weight FROM port JOIN g USING (date)")
def basis_1x(spark, sf):
    return P.basis_1x(portfolio(spark, sf)).select("date", "series_id", r("gross", 6).alias("gross"), r("cash", 6).alias("cash"), r("weight", 6).alias("weight"))
