"""Queries of forecasts, exports, searches, records and calendars, which put several operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import scalars as X
from ..operators import cycles as C
from ..operators import models as M
from ..operators import prep
from ..operators import score as S
from ..operators import views as V
from . import cycles, market, views
from .base import DAILY_SQL, LEDGER_SQL, daily, events_ledger, query, r, table

INPUTS_SQL = f"""{DAILY_SQL}, w AS (SELECT date, max(value) FILTER (series_id = '1-URGENT') AS price, max(value) FILTER (series_id = '2-HIGH') AS spread, max(value) FILTER (series_id = '3-MEDIUM') AS copper,
 max(value) FILTER (series_id = '4-NOT SPECIFIED') AS other_copper, max(value) FILTER (series_id = '5-LOW') AS gold FROM daily GROUP BY date)"""


def states(spark, sf) -> DataFrame:
    """The states of one scenario: date, state."""
    return views.states(spark, sf).filter("scenario = '5-LOW'").select("date", "state")


@query(f"""WITH {INPUTS_SQL} SELECT date, round(price, 4) + 0.0 AS price, round(coalesce(copper, other_copper), 4) + 0.0 AS copper, round(coalesce(copper, other_copper) / nullif(gold, 0), 7) + 0.0 AS ratio,
 CASE WHEN gold < 100000 THEN 'NORMAL' WHEN gold < 200000 THEN 'DEFCON2' ELSE 'DEFCON1' END AS state FROM w WHERE gold IS NOT NULL""")
def forecast_inputs(spark, sf):
    """The wide frame of a forecast: last values a day, another series under its alias, the ratio filled, states joined."""
    names = {"1-URGENT": "price", "2-HIGH": "spread", "3-MEDIUM": "copper", "4-NOT SPECIFIED": "other_copper", "5-LOW": "gold"}
    wide = prep.pivot_wide(daily(spark, sf), list(names)).withColumnsRenamed(names)
    wide = prep.ratio_fill(prep.alias_merge(wide, "copper", "other_copper").withColumn("ratio", F.lit(None).cast("double")), "ratio", "copper", "gold")
    return wide.join(states(spark, sf), "date").select("date", r("price").alias("price"), r("copper").alias("copper"), r("ratio", 7).alias("ratio"), "state")


def newton_sql(rows: str, k: int, steps: int = 14) -> str:
    """CTEs of ridge logistic models of the rows (key, y, x1 .. xk) by Newton's steps: model has key, b0 .. bk."""
    xs, ids = ["1.0", *[f"x{i}" for i in range(1, k + 1)]], range(k + 1)
    out = [f"n0 AS MATERIALIZED (SELECT key, {', '.join(f'0.0::DOUBLE AS b{i}' for i in ids)} FROM {rows} GROUP BY key)"]
    for s in range(steps):
        z = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
        sums = [f"any_value(b{i}) AS b{i}" for i in ids]
        sums += [f"sum((y - p) * {xs[i]}) - {1.0 if i else 0.0} * any_value(b{i}) AS r{i}" for i in ids]
        sums += [f"sum(p * (1 - p) * {xs[i]} * {xs[j]}) + {1.0 if i == j and i else 0.0} AS a{i}{j}" for i in ids for j in range(i, k + 1)]
        inner = f"SELECT key, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-greatest(-35, least(35, {z})))) AS p FROM {rows} JOIN n{s} USING (key)) GROUP BY key"
        for m in ids:  # elimination below row m of the symmetric matrix
            changed = [f"a{i}{j} - a{m}{i} * a{m}{j} / a{m}{m} AS a{i}{j}" for i in range(m + 1, k + 1) for j in range(i, k + 1)] + [f"r{i} - a{m}{i} * r{m} / a{m}{m} AS r{i}" for i in range(m + 1, k + 1)]
            inner = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({inner})" if changed else inner
        for m in reversed(ids):
            rest = "".join(f" - a{m}{j} * d{j}" for j in range(m + 1, k + 1))
            inner = f"SELECT *, (r{m}{rest}) / a{m}{m} AS d{m} FROM ({inner})"
        out.append(f"n{s + 1} AS MATERIALIZED (SELECT key, {', '.join(f'b{i} + d{i} AS b{i}' for i in ids)} FROM ({inner}))")
    return ",\n".join([*out, f"model AS (SELECT * FROM n{steps})"])


def standard_sql(frame: str, columns: list[str], over: str) -> str:
    """Subquery with x1 .. xk: missing values at the median, then standardised."""
    filled = ", ".join(f"coalesce({c}, quantile_cont({c}, 0.5) OVER ({over}), 0) AS f{i}" for i, c in enumerate(columns, 1))
    scaled = ", ".join(f"(f{i} - avg(f{i}) OVER ({over})) / CASE WHEN stddev_pop(f{i}) OVER ({over}) > 1e-12 THEN stddev_pop(f{i}) OVER ({over}) ELSE 1 END AS x{i}" for i in range(1, len(columns) + 1))
    return f"(SELECT *, {scaled} FROM (SELECT *, {filled} FROM {frame}))"


_Z3 = "b0 + b1 * x1 + b2 * x2 + b3 * x3"
FORECAST_SQL = f"""{cycles.FEAT_SQL}, st AS (SELECT date, CASE WHEN value < 100000 THEN 'NORMAL' WHEN value < 200000 THEN 'DEFCON2' ELSE 'DEFCON1' END AS state FROM daily WHERE series_id = '5-LOW'),
wide AS (SELECT date, any_value(state) AS state, max(cycle_z) FILTER (series_id = '1-URGENT') AS nas_cz, max(cycle_z) FILTER (series_id = '2-HIGH') AS spread_cz, max(cycle_z) FILTER (series_id = '3-MEDIUM') AS ratio_cz, max(vol_z) FILTER (series_id = '1-URGENT') AS nas_vz FROM st JOIN feats USING (date) GROUP BY date),
lab AS MATERIALIZED (SELECT *, CAST(state <> 'NORMAL' AS INT) AS crisis, CAST(coalesce(nas_cz >= 0.8 AND spread_cz <= -0.2 AND ratio_cz >= 0.2 AND nas_vz <= 0.2, false) AS INT) AS euphoria FROM {standard_sql("wide", ["nas_cz", "spread_cz", "nas_vz"], "")}),
long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{t}_{k}' AS key, date, x1, x2, x3, lead({t}, {h}) OVER (ORDER BY date) AS y FROM lab" for t in ("crisis", "euphoria") for k, h in M.FORECAST_HORIZONS.items())}),
t AS MATERIALIZED (SELECT key, date, x1, x2, x3, y FROM long WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY key) >= 300),
{newton_sql("t", 3)},
prob AS (SELECT key, date, y, 1 / (1 + exp(-greatest(-35, least(35, {_Z3})))) AS p FROM long JOIN model USING (key)),
val AS (SELECT * FROM prob WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY key) > 500 AND row_number() OVER (PARTITION BY key ORDER BY date DESC) <= 1260),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, date) - 1 AS rk FROM val),
aucs AS (SELECT key, CASE WHEN count(*) < 10 OR sum(y) = 0 OR sum(1 - y) = 0 THEN NULL WHEN min(p) = max(p) THEN 0.5 ELSE (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) - 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM ranked GROUP BY key)"""
_ONE = lambda t, k: f"max(p) FILTER (key = '{t}_{k}')"
_AUC = lambda t, k: f"(SELECT any_value(auc) FROM aucs WHERE key = '{t}_{k}')"
FORECAST_COLUMNS = [f"p_{t}_{k}" for t in ("crisis", "euphoria") for k in M.FORECAST_HORIZONS]


@query(f"""WITH {FORECAST_SQL} SELECT l.date, {", ".join(f"round({_ONE(t, k)}, 6) + 0.0 AS p_{t}_{k}, round({_AUC(t, k)}, 6) + 0.0 AS auc_val_{t}_{k}, CASE WHEN {_AUC(t, k)} IS NOT NULL THEN round(least(1, greatest(0, ({_AUC(t, k)} - 0.5) / 0.5)), 6) + 0.0 END AS conf_{t}_{k}" for t in ("crisis", "euphoria") for k in M.FORECAST_HORIZONS)},
 {", ".join(f"round({_ONE('euphoria', k)} - {_ONE('crisis', k)}, 6) + 0.0 AS net_{k}" for k in M.FORECAST_HORIZONS)}, CASE WHEN (SELECT count(*) FROM model WHERE key IN ('crisis_1y', 'euphoria_1y')) > 0 THEN 'OK' ELSE 'WARMUP' END AS status FROM lab l LEFT JOIN prob USING (date) GROUP BY l.date""")
def forecast_daily(spark, sf):
    """Three horizons of both labels, from three of the features."""
    feats = cycles.features(spark, sf).filter(F.col("series_id").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
    of = lambda s, c: F.max(F.when(F.col("series_id") == s, F.col(c)))
    wide = feats.groupBy("date").agg(of("1-URGENT", "cycle_z").alias("nas_cz"), of("2-HIGH", "cycle_z").alias("spread_cz"), of("3-MEDIUM", "cycle_z").alias("ratio_cz"), of("1-URGENT", "vol_z").alias("nas_vz"))
    frame = wide.join(states(spark, sf), "date").withColumns({"crisis": M.crisis_now(F.col("state")), "euphoria": M.euphoria_now(*[F.col(c) for c in ("nas_cz", "spread_cz", "ratio_cz", "nas_vz")])})
    f = M.forecast(frame, ["nas_cz", "spread_cz", "nas_vz"])
    names = [f"{x}_{t}_{k}" for t in ("crisis", "euphoria") for k in M.FORECAST_HORIZONS for x in ("p", "auc_val", "conf")]
    return f.select("date", *[r(c, 6).alias(c) for c in [*names, *[f"net_{k}" for k in M.FORECAST_HORIZONS]]], "status")


LOGIT_SQL = f"""{cycles.FEAT_SQL.replace("SELECT series_id, date, CASE WHEN series_id IN", "SELECT series_id, date, value, CASE WHEN series_id IN")},
lab AS MATERIALIZED (SELECT series_id AS key, date, x1, x2, x3, lead(CAST(value > 150000 AS INT), 21) OVER (PARTITION BY series_id ORDER BY date) AS y FROM {standard_sql("(SELECT series_id, date, value, cycle_z, slope_1m, vol_z FROM feats)", ["cycle_z", "slope_1m", "vol_z"], "PARTITION BY series_id")}),
t AS MATERIALIZED (SELECT * FROM lab WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY key) >= 300), {newton_sql("t", 3)}"""


@query(f"WITH {LOGIT_SQL} SELECT key AS series_id, date, CASE WHEN b0 IS NOT NULL THEN round(1 / (1 + exp(-greatest(-35, least(35, {_Z3})))), 6) + 0.0 END AS p, CASE WHEN b0 IS NULL THEN 'WARMUP' ELSE 'OK' END AS status FROM lab LEFT JOIN model USING (key)")
def logit_probs(spark, sf):
    """Probability of a high price in 21 observations, from each series' own features; WARMUP without one for series of under 300 labels."""
    rows = cycles.features(spark, sf).withColumn("label", (F.col("value") > 150000).cast("double"))
    columns, rows = ["cycle_z", "slope_1m", "vol_z"], M.lead_label(rows, "label", [21], "series_id").persist()
    rows = M.standardised(rows, columns, ["series_id"])
    models = M.newton_logits(rows, ["series_id"], columns, "label_21")
    p, status = F.lit(None).cast("double"), F.lit("WARMUP")
    for (s,), b in models.items():
        p, status = F.when(F.col("series_id") == s, M.logit(columns, b)).otherwise(p), F.when(F.col("series_id") == s, "OK").otherwise(status)
    return rows.select("series_id", "date", r(p, 6).alias("p"), status.alias("status"))


_LEVEL = lambda p: f"CASE WHEN {p} IS NULL THEN 'unknown' WHEN {p} < 0.1 THEN 'very low' WHEN {p} < 0.25 THEN 'low' WHEN {p} < 0.5 THEN 'medium' WHEN {p} < 0.75 THEN 'high' ELSE 'very high' END"
_C = lambda h: _LEVEL(f"(CASE WHEN mf IS NULL THEN NULL WHEN macro_risk = 1 THEN 1.0 ELSE least(1, greatest(0, {cycles._CDF(h, 'lm', 'sg')})) END)")
_E = lambda h: _LEVEL(f"(CASE WHEN euphoria_trigger = 1 THEN 1.0 ELSE least(1, greatest(0, {cycles._CDF(h, 'le', '0.95')})) END)")
_Q = "0.6744897501960817"


@query(f"""WITH {cycles.TIMING_SQL} SELECT series_id, date, 'Estimates of ' || date || ', which name probabilities and promise no day.' || chr(10) ||
 'Crisis: most likely between ' || coalesce((date + CAST(floor(exp(lm - sg * {_Q})) AS INT)) || ' and ' || (date + CAST(floor(exp(lm + sg * {_Q})) AS INT)), 'unknown days') || ', median ' || coalesce((date + CAST(floor(med) AS INT))::VARCHAR, 'unknown') || '; one month ' || {_C(21)} || ', three months ' || {_C(63)} || ', six months ' || {_C(126)} || ', one year ' || {_C(252)} || '.' || chr(10) ||
 'Euphoria: most likely between ' || (date + CAST(floor(exp(le - 0.95 * {_Q})) AS INT)) || ' and ' || (date + CAST(floor(exp(le + 0.95 * {_Q})) AS INT)) || ', median ' || (date + CAST(floor(mede) AS INT)) || '; one week ' || {_E(5)} || ', one month ' || {_E(21)} || ', three months ' || {_E(63)} || ', one year ' || {_E(252)} || '.' || chr(10) ||
 'Neither is the same as a bull or bear phase, which prices alone decide.' AS text FROM z QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1""")
def timing_narrative(spark, sf):
    return M.narrative(cycles.timing_days(spark, sf), ["series_id"])


TEXT_SQL = f"""{market.PORT_SQL}, sums AS (SELECT date, sum(weight) AS gross FROM port GROUP BY date), lines AS (SELECT date, string_agg(format('{{}} {{:.1f}}%', series_id, weight * 100), ' | ' ORDER BY weight DESC, series_id) FILTER (weight > 0) AS parts FROM port GROUP BY date),
texts AS (SELECT date, concat_ws(' | ', parts, format('CASH {{:.1f}}%', (1 - gross) * 100), format('GROSS {{:.2f}}x', gross)) AS text FROM lines JOIN sums USING (date))"""


@query(f"""WITH {TEXT_SQL}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS scenario FROM orders) SELECT d.scenario, d.date, t.date AS as_of, t.text FROM d ASOF JOIN texts t ON d.date >= t.date WHERE lower(t.text) LIKE '%a1 %'""")
def portfolio_search(spark, sf):
    """Days whose portfolio as of then mentions an asset."""
    days = daily(spark, sf).select(F.col("series_id").alias("scenario"), "date")
    return V.portfolio_search(days, V.portfolio_text(market.portfolio(spark, sf)), "A1 ").select("scenario", "date", "as_of", "text")


def calendar_events(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), F.last_day(F.col("o_orderdate").cast("date")).alias("as_of"), F.when(k % 5 != 0, (k % 61).cast("double")).alias("months_until_fear"), ((k % 17).cast("double") - 2).alias("months_until_euphoria"))


EVENTS_SQL = """e AS (SELECT o_orderkey AS id, CAST(last_day(o_orderdate) AS DATE) AS as_of, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 61)::DOUBLE END AS mf, ((o_orderkey % 17)::DOUBLE - 2) AS me FROM orders),
p AS (SELECT *, CASE WHEN mf >= 0 THEN as_of + to_months(mf::INT) END AS fp, CASE WHEN me >= 0 THEN as_of + to_months(me::INT) END AS ep FROM e)"""


def _event_sql(uid: str, summary: str, text: str, which: str, before: int) -> str:
    day = f"date_trunc('month', {'fp' if which == 'fear' else 'ep'} - INTERVAL {before} MONTH)"
    return f"'BEGIN:VEVENT' || chr(10) || 'UID:{uid}@tidemark' || chr(10) || 'DTSTART;VALUE=DATE:' || strftime({day}, '%Y%m%d') || chr(10) || 'DTEND;VALUE=DATE:' || strftime({day} + INTERVAL 1 DAY, '%Y%m%d') || chr(10) || 'SUMMARY:{summary}' || chr(10) || 'DESCRIPTION:{text}' || chr(10) || 'END:VEVENT'"


@query(f"WITH {EVENTS_SQL} SELECT id, concat_ws(chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Tidemark//Cycles//EN', {', '.join(_event_sql(*e) for e in C.CALENDAR)}, 'END:VCALENDAR') || chr(10) AS ics FROM p")
def calendar_file(spark, sf):
    """A whole calendar file for each order."""
    return C.calendar_file(calendar_events(spark, sf)).select("id", "ics")


@query(f"WITH {EVENTS_SQL} SELECT id, CAST(last_day(as_of + to_months(k::INT)) AS DATE) AS month_end FROM (SELECT *, unnest(generate_series(0, 47)) AS k FROM p)")
def calendar_next(spark, sf):
    return C.next_months(C.month_calendar(calendar_events(spark, sf))).select("id", "month_end")


@query(f"""WITH {market.PORT_SQL}, hi AS (SELECT max(date) AS z FROM port), st AS (SELECT DISTINCT date FROM port WHERE day(date) % 3 <> 0), s AS (SELECT p.date, format('{{:.6f}}', sum(weight)) AS gross_exposure, format('{{:.6f}}', 1 - sum(weight)) AS cash_weight,
 {", ".join(f"format('{{:.6f}}', coalesce(max(weight) FILTER (series_id = '{a}'), 0)) AS w_{a}" for a in ("A0", "A1", "A2"))} FROM port p JOIN st USING (date), hi WHERE p.date > z - 30 GROUP BY p.date),
old AS (SELECT CAST(unnest(generate_series(z - 60, z, INTERVAL 1 DAY)) AS DATE) AS date FROM hi)
SELECT date, coalesce(gross_exposure, 'old') AS gross_exposure, CASE WHEN s.date IS NULL THEN 'old' ELSE cash_weight END AS cash_weight, w_A0, w_A1, w_A2, CASE WHEN s.date IS NULL THEN 'kept' END AS w_gone FROM old LEFT JOIN s USING (date)""")
def portfolio_recent(spark, sf):
    """The last 30 days that have a state, over an earlier export of 61 days; that export's weight of an asset that is gone stays in the days that it keeps."""
    rows = market.portfolio(spark, sf)
    have = rows.select("date").distinct().filter(F.dayofmonth("date") % 3 != 0)
    last = rows.agg(F.max("date").alias("last")).select(F.date_sub("last", 60).alias("first"), "last")
    old = prep.calendar(last).select("date", F.lit("old").alias("gross_exposure"), F.lit("old").alias("cash_weight"), F.lit("kept").alias("w_gone"))
    return sinks.recent_export(rows, have, ["A0", "A1", "A2"], old, days=30)


RECORD = "coalesce(nullif(o_orderkey % 4, 3), 3)"


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN format('{:.3f}', (o_orderkey % 9) / 8.0) WHEN 1 THEN format('{:.3f}', (o_orderkey % 90) / 100.0) ELSE '' END AS equity_weight, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::VARCHAR WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5)::VARCHAR ELSE '' END AS streak_ge_2,
 CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'one | hard defcon1' END AS triggers, CASE WHEN o_orderkey % 6 = 0 THEN '0' ELSE '1' END AS hard_defcon1, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'HOLD' END AS action FROM orders""")
def state_export(spark, sf):
    """States whose stored records are of several ages: percentages in place of weights, older names of streaks."""
    k = F.col("o_orderkey")
    allocation = F.struct(F.when(k % 4 == 0, (k % 9) / 8.0).alias("equity_weight"), F.when(k % 4 == 1, (k % 90).cast("double")).alias("equity_weight_pct"), F.when(k % 11 != 0, "HOLD").alias("action"))
    streaks = F.struct(F.when(k % 2 == 0, k % 7).alias("streak_ge_2"), F.when(k % 3 == 0, k % 5).alias("streak_ge_3"))
    record = F.struct(F.when(k % 6 != 0, F.array(F.lit("one"), F.lit("hard defcon1"))).alias("triggers"), allocation.alias("allocation"), streaks.alias("streaks"))
    rows = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderdate").cast("date").alias("as_of_date"), F.lit("NORMAL").alias("state"), F.lit(1.0).alias("score"), F.to_json(record).alias("reasons_json"))
    flat = sinks.flat_records(rows, ["id"])
    return flat.select("id", "equity_weight", "streak_ge_2", "triggers", "hard_defcon1", "action")


@query(f"""WITH {market.FEATURES_SQL} SELECT date, count(*) AS n_sensors, coalesce(string_agg(series_id, ', ' ORDER BY series_id) FILTER (critical AND stale AND have > 0), '') AS stale_critical, max(age) FILTER (series_id = '5-LOW') AS age_of_low, bool_or(stale) FILTER (series_id = '2-HIGH') AS high_is_stale FROM aged GROUP BY date""")
def health_record(spark, sf):
    """The health of a day's sensors as one nested record, read back from its JSON text."""
    rows = S.health(market.sensor_days(spark, sf)).withColumn("h", F.from_json("health_json", "map<string, struct<as_of: date, have: bigint, age: int, stale: boolean>>"))
    at = lambda s, f: F.element_at("h", s)[f]
    return rows.select("date", F.size("h").cast("long").alias("n_sensors"), F.array_join("stale_critical", ", ").alias("stale_critical"), at("5-LOW", "age").cast("long").alias("age_of_low"), at("2-HIGH", "stale").alias("high_is_stale"))


@query(f"""WITH {DAILY_SQL}, {market.TREND_SQL}, b AS (SELECT min(date) AS a, max(date) AS z FROM daily), days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b), p AS (SELECT d.date, s.series_id FROM days d CROSS JOIN (SELECT DISTINCT series_id FROM daily) s)
SELECT p.series_id, p.date, CASE WHEN p.date - t.date <= 1 THEN t.signal ELSE 'UNKNOWN' END AS signal, round(CASE WHEN p.date - t.date <= 1 THEN t.price END, 4) + 0.0 AS price FROM p ASOF LEFT JOIN trend t ON p.series_id = t.series_id AND p.date >= t.date""")
def trend_asof(spark, sf):
    """The trend of each calendar day, unknown where the price is older than a day."""
    d = daily(spark, sf)
    days = prep.calendar(d.select("series_id").distinct().crossJoin(d.agg(F.min("date").alias("first"), F.max("date").alias("last"))))  # a row of bounds
    return S.trend_as_of(days, market.trends(spark, sf), valid_days=1).select("series_id", "date", "signal", r("price").alias("price"))


@query(f"WITH {LEDGER_SQL} SELECT series_id, seq, time_utc_ms FROM ledger WHERE NOT coalesce(series_id = 'click' AND value = (SELECT max(value) FROM ledger WHERE series_id = 'click'), false)")
def without_test_rows(spark, sf):
    rows = events_ledger(spark, sf)
    top = rows.filter("series_id = 'click'").agg(F.max("value")).first()[0]
    return prep.without_test_rows(rows, "click", top).select("series_id", "seq", "time_utc_ms")


@query(f"WITH {LEDGER_SQL}, n AS (SELECT quantile_disc(time_utc_ms, 0.9) AS now FROM ledger) SELECT series_id, time_utc_ms, seq, rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time_utc_ms DESC, seq DESC, value DESC) AS rank FROM ledger, n WHERE time_utc_ms > now) WHERE rank <= 5")
def future_rows(spark, sf):
    rows = events_ledger(spark, sf)
    ms = rows.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY time_utc_ms)")).first()[0]
    return prep.future_rows(rows, int(ms)).select("series_id", "time_utc_ms", "seq", F.col("rank").cast("long").alias("rank"))


@query("""SELECT doc_id, length(coalesce(text, '')) AS n, CASE WHEN length(text) <= 1800 THEN right(text, 20) WHEN text IS NULL THEN '' ELSE right(left(text, 1785) || '…(truncated)', 20) END AS ending, CASE WHEN text IS NULL THEN '' WHEN length(text) <= 500 THEN right(text, 5) ELSE right(left(text, 500) || '…', 5) END AS preview FROM documents""")
def text_truncated(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n"), F.right(X.truncated(text), F.lit(20)).alias("ending"), F.right(X.preview(text), F.lit(5)).alias("preview"))


@query(f"""WITH {market.PORT_SQL}, {cycles.MULT_SQL.replace(DAILY_SQL + ",", "orders_daily AS (SELECT 1),")}, c AS (SELECT month_end AS date, multiplier FROM mult WHERE series_id = '1-URGENT'),
 g AS (SELECT p.* REPLACE (raw_weight * CASE WHEN p.series_id IN ('A0', 'A1') THEN coalesce(c.multiplier, 1.0) ELSE 1.0 END AS raw_weight) FROM port p ASOF LEFT JOIN c ON p.date >= c.date), h AS (SELECT *, sum(raw_weight) OVER (PARTITION BY date) AS t2 FROM g)
SELECT date, series_id, round(CASE WHEN t2 > 2.0 THEN raw_weight * 2.0 / t2 ELSE raw_weight END, 6) + 0.0 AS weight FROM h""")
def portfolio_cycles(spark, sf):
    """Weights whose risk assets are scaled by the risk multiplier of the latest month too."""
    multipliers = cycles.waves(spark, sf).filter("series_id = '1-URGENT'").select(F.col("month_end").alias("date"), "risk_multiplier")
    return market.portfolio(spark, sf, multipliers).select("date", "series_id", r("weight", 6).alias("weight"))


@query(f"""WITH {cycles.FIT_SQL} SELECT series_id, month_end, CASE WHEN months / (2 * pi() / w) IS NOT NULL AND w > 0 THEN round(-90 + 360 * least(1, greatest(0, 1 - months / (2 * pi() / w))), 3) + 0.0 END AS angle, abs(p) <= pi() / 10 AS near_peak, abs(abs(p) - pi()) <= pi() / 10 AS near_trough FROM eu""")
def phase_clock(spark, sf):
    from ..operators.windows import by, ffill

    o = cycles.outlooks(spark, sf).withColumn("p", ffill(F.col("euphoria_phase"), by("series_id", "month_end")))
    peak, trough = C.near_phase(F.col("p"))
    return o.select("series_id", "month_end", r(X.clock_angle(F.col("months_until_euphoria"), F.col("euphoria_period_months")), 3).alias("angle"), peak.alias("near_peak"), trough.alias("near_trough"))


@query(f"WITH {DAILY_SQL}, c AS (SELECT DISTINCT date FROM daily WHERE series_id = '1-URGENT') SELECT series_id, date FROM daily WHERE date IN (SELECT date FROM c)")
def days_with_close(spark, sf):
    """Days on which a reference series has a close."""
    d = daily(spark, sf)
    return d.select("series_id", "date").join(d.filter("series_id = '1-URGENT'").select("date"), "date", "left_semi")
