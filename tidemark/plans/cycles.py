"""Queries of cycles, windows and triggers, calendars and timing, with the windows that the operators default to."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..operators import cycles as C
from ..operators import models as M

from .base import DAILY_SQL, LONG_MONTHLY_SQL, daily, long_monthly, query, r, table

_OVER = "OVER (PARTITION BY series_id ORDER BY month_end ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W = "OVER (PARTITION BY series_id ORDER BY month_end)"
_DOVER = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_DW = "OVER (PARTITION BY series_id ORDER BY date)"
TREND, SMOOTH, LEAST = 120, 12, 40


def win(f: str, x: str, n: int, least: int, over: str = _OVER) -> str:
    return f"CASE WHEN count({x}) {over.format(n=n - 1)} >= {least} THEN {f}({x}) {over.format(n=n - 1)} END"


def detrended(spark, sf) -> DataFrame:
    return C.detrended(long_monthly(spark, sf))


DETREND_SQL = f"""{LONG_MONTHLY_SQL}, m1 AS (SELECT *, ln(CASE WHEN value > 0 THEN value END) AS logp FROM monthly),
m2 AS (SELECT *, logp - lag(logp) {_W} AS logret, {win("avg", "logp", TREND, TREND // 2)} AS trend_logp FROM m1),
m3 AS (SELECT *, abs(logret) AS vol_1m, logp - trend_logp AS price_cycle FROM m2), m4 AS (SELECT *, {win("avg", "vol_1m", SMOOTH, SMOOTH)} AS vol_12m FROM m3),
det AS (SELECT *, (price_cycle - {win("avg", "price_cycle", TREND, LEAST)}) / nullif({win("stddev_pop", "price_cycle", TREND, LEAST)}, 0) AS price_cycle_z, (vol_12m - {win("avg", "vol_12m", TREND, LEAST)}) / nullif({win("stddev_pop", "vol_12m", TREND, LEAST)}, 0) AS vol_z FROM m4)"""


@query(f"WITH {DETREND_SQL} SELECT series_id, month_end, round(logp, 6) + 0.0 AS logp, round(vol_1m, 6) + 0.0 AS vol_1m, round(price_cycle, 6) + 0.0 AS price_cycle, round(price_cycle_z, 5) + 0.0 AS price_cycle_z, round(vol_12m, 6) + 0.0 AS vol_12m, round(vol_z, 5) + 0.0 AS vol_z FROM det")
def cycle_detrend(spark, sf):
    d = detrended(spark, sf)
    return d.select("series_id", "month_end", r("logp", 6).alias("logp"), r("vol_1m", 6).alias("vol_1m"), r("price_cycle", 6).alias("price_cycle"), r("price_cycle_z", 5).alias("price_cycle_z"), r("vol_12m", 6).alias("vol_12m"), r("vol_z", 5).alias("vol_z"))


def band_sql(name: str) -> str:
    """CTEs <name>_0 to <name>_2 and <name>: series_id, month_end, c and s, the two parts of a wave, as sums over the window's rows and the band's bins."""
    value, window, shortest, longest = C.BANDS[name]
    angle = f"2 * pi() * k * age / {window}"
    return f"""{name}_0 AS (SELECT series_id, month_end, last_value({value} IGNORE NULLS) {_W} AS x, row_number() {_W} AS rn FROM det),
{name}_1 AS (SELECT a.series_id, a.month_end, b.x, a.rn - b.rn AS age, avg(b.x) OVER (PARTITION BY a.series_id, a.rn) AS m FROM {name}_0 a JOIN {name}_0 b ON a.series_id = b.series_id AND b.rn BETWEEN a.rn - {window - 1} AND a.rn),
{name}_2 AS (SELECT series_id, month_end, count(DISTINCT age) AS n, 2.0 / {window} * sum(coalesce(x - m, 0) * cos({angle})) AS c, 2.0 / {window} * sum(coalesce(x - m, 0) * sin({angle})) AS s, count(m) AS seen_m
 FROM {name}_1 CROSS JOIN (SELECT unnest([{", ".join(map(str, C.bins(window, shortest, longest)))}]) AS k) GROUP BY ALL),
{name} AS (SELECT series_id, month_end, CASE WHEN n = {window} AND seen_m > 0 THEN c END AS c, CASE WHEN n = {window} AND seen_m > 0 THEN s END AS s FROM {name}_2)"""


def waves(spark, sf) -> DataFrame:
    return C.cycle_table(long_monthly(spark, sf))


@query(f"WITH {DETREND_SQL}, {band_sql('wave_3y')} SELECT series_id, month_end, round(c, 6) + 0.0 AS wave, round(sqrt(c * c + s * s), 6) + 0.0 AS wave_amp, round(atan2(s, c), 4) + 0.0 AS wave_phase FROM wave_3y")
def band_component(spark, sf):
    b = C.band_component(detrended(spark, sf), C.BANDS["wave_3y"][0], "wave", *C.BANDS["wave_3y"][1:])
    return b.select("series_id", "month_end", r("wave", 6).alias("wave"), r("wave_amp", 6).alias("wave_amp"), r("wave_phase").alias("wave_phase"))


BANDS_SQL = ", ".join([DETREND_SQL, *map(band_sql, C.BANDS)])


@query(f"""WITH {BANDS_SQL} SELECT a.series_id, a.month_end, {", ".join(f"round({t}.c, 6) + 0.0 AS {n}, round(sqrt({t}.c * {t}.c + {t}.s * {t}.s), 6) + 0.0 AS {n}_amp, round(atan2({t}.s, {t}.c), 4) + 0.0 AS {n}_phase" for n, t in zip(C.BANDS, "abc"))}
FROM wave_3y a JOIN wave_7y b USING (series_id, month_end) JOIN vol_wave_10y c USING (series_id, month_end)""")
def cycle_bands(spark, sf):
    """The three waves of the table that is exported."""
    w = waves(spark, sf)
    return w.select("series_id", "month_end", *[r(f"{n}{x}", k).alias(f"{n}{x}") for n in C.BANDS for x, k in (("", 6), ("_amp", 6), ("_phase", 4))])


def outlooks(spark, sf) -> DataFrame:
    return C.fear_and_euphoria(waves(spark, sf))


def fit_sql(name: str, band: str, fit: int) -> str:
    """CTEs of the unwrapped phase's line: <name>: p (phase), amp, med, w (slope), r2, months."""
    line = lambda f: f"CASE WHEN count(u) {_OVER.format(n=fit - 1)} = {fit} THEN {f}(u, rn) {_OVER.format(n=fit - 1)} END"
    wide, least = max(60, 2 * fit), max(30, fit // 2)
    turn = lambda d: f"({d} + pi() - 2 * pi() * floor(({d} + pi()) / (2 * pi())) - pi())"
    return f"""{name}_0 AS (SELECT series_id, month_end, sqrt(c * c + s * s) AS amp, last_value(atan2(s, c) IGNORE NULLS) {_W} AS p, row_number() {_W} AS rn FROM {band}),
{name}_1 AS (SELECT *, p - lag(p) {_W} AS d FROM {name}_0), {name}_2 AS (SELECT *, p + sum(coalesce({turn("d")} - d, 0)) {_W} AS u FROM {name}_1),
{name}_3 AS (SELECT *, {line("regr_slope")} AS w, {line("regr_r2")} AS r2, CASE WHEN count(amp) {_OVER.format(n=wide - 1)} >= {least} THEN quantile_cont(amp, 0.5) {_OVER.format(n=wide - 1)} END AS med FROM {name}_2),
{name} AS (SELECT *, CASE WHEN abs({turn("p")}) <= pi() / 10 THEN 0.0 ELSE (-p - 2 * pi() * floor(-p / (2 * pi()))) / CASE WHEN w > 0 THEN w END END AS months,
 least(1, greatest(0, 0.6 * coalesce(least(1, greatest(0, (amp / nullif(med, 0) - 0.7) / 0.6)), 0) + 0.4 * coalesce(least(1, greatest(0, r2)), 0))) AS conf FROM {name}_3)"""


FIT_SQL = f"{BANDS_SQL}, {fit_sql('eu', 'wave_3y', 60)}, {fit_sql('fe', 'vol_wave_10y', 120)}"


@query(f"WITH {FIT_SQL} SELECT series_id, month_end, round(CASE WHEN w > 0 THEN w END, 5) + 0.0 AS omega, round(CASE WHEN w > 0 THEN 2 * pi() / w END, 3) + 0.0 AS period, round(r2, 5) + 0.0 AS r2 FROM eu")
def phase_fit(spark, sf):
    f = C.phase_fit(waves(spark, sf), "wave_3y_phase", "f", 60)
    return f.select("series_id", "month_end", r("f_omega", 5).alias("omega"), r("f_period", 3).alias("period"), r("f_r2", 5).alias("r2"))


@query(f"""WITH {FIT_SQL} SELECT series_id, month_end, round(months, 3) + 0.0 AS months_until, CAST(coalesce(months <= 24, false) AS INT) AS window_24m, round(conf, 4) + 0.0 AS confidence FROM eu""")
def fear_windows(spark, sf):
    o = outlooks(spark, sf)
    return o.select("series_id", "month_end", r("months_until_euphoria", 3).alias("months_until"), F.col("euphoria_window_24m").alias("window_24m"), r("confidence_euphoria").alias("confidence"))


@query(f"""WITH {FIT_SQL} SELECT e.series_id, e.month_end, round(f.months, 3) + 0.0 AS months_until_fear, CAST(coalesce(f.months <= 36, false) AS INT) AS fear_window_36m, round(CASE WHEN f.w > 0 THEN 2 * pi() / f.w END, 3) + 0.0 AS fear_period_months,
 round(f.conf, 4) + 0.0 AS confidence_fear, round((e.conf + f.conf) / 2, 4) + 0.0 AS confidence FROM eu e JOIN fe f USING (series_id, month_end)""")
def fear_outlook(spark, sf):
    """The fear side, from the long volatility wave, and the mean confidence."""
    o = outlooks(spark, sf)
    return o.select("series_id", "month_end", r("months_until_fear", 3).alias("months_until_fear"), "fear_window_36m", r("fear_period_months", 3).alias("fear_period_months"), r("confidence_fear").alias("confidence_fear"), r("confidence").alias("confidence"))


MULT_SQL = f"""{BANDS_SQL}, j AS (SELECT d.series_id, d.month_end, d.vol_z, b.c AS wave, b.c - lag(b.c) OVER (PARTITION BY d.series_id ORDER BY d.month_end) AS mom FROM det d JOIN wave_7y b USING (series_id, month_end)),
mult AS (SELECT series_id, month_end, least(1.15, greatest(0.6, CASE WHEN vol_z > 1 THEN 0.75 WHEN vol_z > 0.5 THEN 0.85 WHEN vol_z < -0.5 THEN 1.05 ELSE 1.0 END * CASE WHEN wave > 0 AND mom < 0 THEN 0.9 WHEN wave < 0 AND mom > 0 THEN 1.05 ELSE 1.0 END)) AS multiplier FROM j)"""


@query(f"""WITH {MULT_SQL}
SELECT series_id, month_end, round(multiplier, 6) + 0.0 AS multiplier FROM mult""")
def risk_multiplier(spark, sf):
    return waves(spark, sf).select("series_id", "month_end", r("risk_multiplier", 6).alias("multiplier"))


@query(f"WITH {DETREND_SQL}, {band_sql('wave_7y')} SELECT d.series_id, d.date, round(last_value(b.c IGNORE NULLS) OVER (PARTITION BY d.series_id ORDER BY d.date), 6) + 0.0 AS wave FROM daily d LEFT JOIN wave_7y b ON b.series_id = d.series_id AND b.month_end = last_day(d.date)")
def cycle_daily(spark, sf):
    days = daily(spark, sf).select("series_id", "date")
    return C.daily_expansion(days, waves(spark, sf), ["wave_7y"]).select("series_id", "date", r("wave_7y", 6).alias("wave"))


@query(f"""WITH {DETREND_SQL}, {band_sql('wave_7y')}, bd AS (SELECT series_id, min(date) AS a, max(date) AS z FROM daily GROUP BY 1), c AS (SELECT series_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM bd)
SELECT c.series_id, c.date, round(last_value(b.c IGNORE NULLS) OVER (PARTITION BY c.series_id ORDER BY c.date), 6) + 0.0 AS wave FROM c LEFT JOIN wave_7y b ON b.series_id = c.series_id AND b.month_end = last_day(c.date)""")
def cycle_calendar_days(spark, sf):
    """The same on every day of the calendar."""
    return C.calendar_expansion(daily(spark, sf), waves(spark, sf), ["wave_7y"]).select("series_id", "date", r("wave_7y", 6).alias("wave"))


TRIG_SQL = f"""{DAILY_SQL}, t0 AS (SELECT series_id, date, value, CASE WHEN day(date) % 3 = 0 THEN 'DEFCON2' WHEN day(date) % 3 = 1 THEN 'NORMAL' END AS st, CAST(month(date) % 2 AS INT) AS e36, CAST(month(date) % 3 = 0 AS INT) AS e24, CAST(month(date) AS DOUBLE) * 2 AS mu FROM daily),
t1 AS (SELECT *, {win("avg", "value", 200, 100, _DOVER)} AS sma, value / nullif(lag(value) {_DW}, 0) - 1 AS ret, value / nullif(lag(value, 21) {_DW}, 0) - 1 AS mf, value / nullif(lag(value, 126) {_DW}, 0) - 1 AS ms, value / nullif(lag(value, 252) {_DW}, 0) - 1 AS runup, last_value(st IGNORE NULLS) {_DW} AS state FROM t0),
t2 AS (SELECT *, value / nullif(sma, 0) - 1 AS ox, {win("stddev_samp", "ret", 63, 21, _DOVER)} * sqrt(252) AS va FROM t1),
t3 AS (SELECT *, (ox - {win("avg", "ox", 252, 126, _DOVER)}) / nullif({win("stddev_samp", "ox", 252, 126, _DOVER)}, 0) AS oz, (va - {win("avg", "va", 252, 126, _DOVER)}) / nullif({win("stddev_samp", "va", 252, 126, _DOVER)}, 0) AS vz FROM t2),
t4 AS (SELECT *, coalesce(oz > 1.6, false) AS ov, coalesce(mf < 0 AND ms > 0, false) AS slowing, coalesce(runup > 0.2, false) AS ran, coalesce(value < sma, false) AS broken, coalesce(vz > 1, false) AS wild, coalesce(vz <= 0.75, false) AS calm, coalesce(state IN ('DEFCON1', 'DEFCON2'), false) AS macro, mu <= 12 AS near FROM t3),
trig AS (SELECT *, CAST(macro AND (broken OR wild) AS INT) AS fear_trigger, CAST((e36 = 1 AND calm AND ov AND slowing AND ran) OR (e24 = 1 AND calm AND ov AND slowing) OR (near AND calm AND ov AND slowing) AS INT) AS euphoria_trigger,
 least(3, macro::INT + broken::INT + wild::INT) AS fear_level, near::INT + ov::INT + coalesce(runup > 0.35, false)::INT AS euphoria_level, macro::INT AS macro_risk FROM t4)"""


def trigger_days(spark, sf) -> DataFrame:
    k, m = F.dayofmonth("date") % 3, F.month("date")
    rows = daily(spark, sf).withColumns({"state": F.when(k == 0, "DEFCON2").when(k == 1, "NORMAL"), "euphoria_window_36m": m % 2, "euphoria_window_24m": (m % 3 == 0).cast("int"), "months_until_euphoria": m.cast("double") * 2})
    return C.triggers(rows)


@query(f"WITH {TRIG_SQL} SELECT series_id, date, fear_trigger, euphoria_trigger, fear_level, euphoria_level, macro_risk FROM trig")
def fear_triggers(spark, sf):
    return trigger_days(spark, sf).select("series_id", "date", "fear_trigger", "euphoria_trigger", "fear_level", "euphoria_level", "macro_risk")


@query("""WITH e AS (SELECT o_orderkey AS id, CAST(last_day(o_orderdate) AS DATE) AS as_of, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 61)::DOUBLE END AS mf, ((o_orderkey % 17)::DOUBLE - 2) AS me FROM orders),
p AS (SELECT *, CASE WHEN mf >= 0 THEN as_of + to_months(mf::INT) END AS fp, CASE WHEN me >= 0 THEN as_of + to_months(me::INT) END AS ep FROM e),
m AS (SELECT *, last_day(as_of + to_months(k::INT)) AS month_end FROM (SELECT *, unnest(generate_series(-12, 60)) AS k FROM p)),
f AS (SELECT *, coalesce(month_end BETWEEN fp - INTERVAL 36 MONTH AND fp, false)::INT AS fear_36m, coalesce(month_end BETWEEN fp - INTERVAL 24 MONTH AND fp, false)::INT AS fear_24m, coalesce(month_end BETWEEN ep - INTERVAL 36 MONTH AND ep, false)::INT AS euphoria_36m FROM m)
SELECT id, month_end, fear_36m, fear_24m, euphoria_36m, CASE WHEN fear_36m = 1 AND euphoria_36m = 1 THEN 'FEAR+EUPH' WHEN fear_36m = 1 THEN 'FEAR' WHEN euphoria_36m = 1 THEN 'EUPH' ELSE 'NONE' END AS label FROM f""")
def fear_calendar_all(spark, sf):
    """The month calendar of every order."""
    return fear_calendar_of(table(spark, sf, "orders"))


def fear_calendar_of(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    e = orders.select(k.alias("id"), F.last_day(F.col("o_orderdate").cast("date")).alias("as_of"), F.when(k % 5 != 0, (k % 61).cast("double")).alias("months_until_fear"), ((k % 17).cast("double") - 2).alias("months_until_euphoria"))
    return C.month_calendar(e).select("id", "month_end", "fear_36m", "fear_24m", "euphoria_36m", "label")


@query("""SELECT 'order-' || o_orderkey AS uid, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:order-' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(date_trunc('month', o_orderdate), '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(date_trunc('month', o_orderdate) + INTERVAL 1 DAY, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || chr(13) || chr(10) || 'END:VEVENT' AS event FROM orders""")
def calendar_events(spark, sf):
    o = table(spark, sf, "orders")
    return C.ics_lines(o.select(F.concat(F.lit("order-"), "o_orderkey").alias("uid"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").cast("date").alias("day")))


def _erf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x})))"
    return f"sign({x}) * (1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x})))"


_CDF = lambda h, mu, sg: f"0.5 * (1 + {_erf(f'(({math.log(h)} - {mu}) / ({sg} * sqrt(2.0)))')})"


TIMING_SQL = f"""{TRIG_SQL}, x AS (SELECT series_id, date, fear_trigger, fear_level, euphoria_trigger, euphoria_level, macro_risk, mu AS me, CASE WHEN day(date) % 7 <> 0 THEN mu * 3 END AS mf, (day(date) % 10) / 10.0 AS cf FROM trig),
y AS (SELECT *, CASE WHEN mf IS NOT NULL THEN greatest(1.0, greatest(mf * 21, 30) * CASE WHEN fear_trigger > 0 OR fear_level > 0 OR macro_risk > 0 THEN 0.35 ELSE 1.0 END) END AS med, 0.25 + (1 - cf) AS sg, greatest(1.0, greatest(me * 21, 7) * CASE WHEN euphoria_trigger > 0 OR euphoria_level > 0 THEN 0.35 ELSE 1.0 END) AS mede FROM x),
z AS (SELECT *, ln(med) AS lm, ln(mede) AS le FROM y)"""


@query(f"""WITH {TIMING_SQL}
SELECT series_id, date, CASE WHEN mf IS NULL THEN 'NO_FEATURES' WHEN cf < 0.25 THEN 'LOW_CONF' ELSE 'OK' END AS status_crisis, round(CASE WHEN mf IS NULL THEN NULL WHEN macro_risk = 1 THEN 1.0 ELSE least(1, greatest(0, {_CDF(63, "lm", "sg")})) END, 6) + 0.0 AS p_crisis_3m,
 round(CASE WHEN euphoria_trigger = 1 THEN 1.0 ELSE least(1, greatest(0, {_CDF(252, "le", "0.95")})) END, 6) + 0.0 AS p_euphoria_1y, round_even(med, 0) AS eta_days, date + CAST(floor(med) AS INT) AS eta_date, date + CAST(floor(exp(lm - sg * 0.6744897501960817)) AS INT) AS mode_start FROM z""")
def timing_probs(spark, sf):
    t = timing_days(spark, sf)
    return t.select("series_id", "date", "status_crisis", r("p_crisis_within_3m", 6).alias("p_crisis_3m"), r("p_euphoria_within_1y", 6).alias("p_euphoria_1y"), F.col("eta_crisis_median_days").alias("eta_days"), F.col("eta_crisis_median_date").alias("eta_date"), F.col("crisis_mode_start").alias("mode_start"))


def timing_days(spark, sf) -> DataFrame:
    day = F.dayofmonth("date")
    rows = trigger_days(spark, sf).withColumns({"months_until_fear": F.when(day % 7 != 0, F.col("months_until_euphoria") * 3), "confidence_fear": (day % 10) / 10.0, "confidence_euphoria": F.lit(0.3)})
    return M.timing(rows)


FEAT_SQL = f"""{DAILY_SQL}, c0 AS (SELECT series_id, date, CASE WHEN series_id IN ('1-URGENT', '2-HIGH') THEN ln(CASE WHEN value > 0 THEN value END) ELSE value END AS x FROM daily),
c1 AS (SELECT *, x - {win("avg", "x", 756, 378, _DOVER)} AS resid, x - lag(x) {_DW} AS dx FROM c0),
c2 AS (SELECT *, resid / nullif({win("stddev_pop", "resid", 756, 378, _DOVER)}, 0) AS cycle_z, {win("stddev_pop", "dx", 63, 31, _DOVER)} AS vol FROM c1),
feats AS (SELECT *, cycle_z - lag(cycle_z, 21) {_DW} AS slope_1m, (vol - {win("avg", "vol", 756, 378, _DOVER)}) / nullif({win("stddev_pop", "vol", 756, 378, _DOVER)}, 0) AS vol_z FROM c2)"""


def features(spark, sf) -> DataFrame:
    return M.cycle_features(daily(spark, sf), ["1-URGENT", "2-HIGH"])


@query(f"WITH {FEAT_SQL} SELECT series_id, date, round(cycle_z, 5) + 0.0 AS cycle_z, round(slope_1m, 5) + 0.0 AS slope_1m, round(vol_z, 5) + 0.0 AS vol_z FROM feats")
def feature_zscores(spark, sf):
    return features(spark, sf).select("series_id", "date", r("cycle_z", 5).alias("cycle_z"), r("slope_1m", 5).alias("slope_1m"), r("vol_z", 5).alias("vol_z"))


@query(f"WITH {FEAT_SQL} SELECT series_id, date, CAST(coalesce(cycle_z >= 0.8 AND vol_z <= 0.2, false) AS INT) AS euphoria FROM feats")
def euphoria_label(spark, sf):
    return features(spark, sf).select("series_id", "date", F.coalesce((F.col("cycle_z") >= 0.8) & (F.col("vol_z") <= 0.2), F.lit(False)).cast("int").alias("euphoria"))


@query("""WITH p AS (SELECT o_orderpriority AS series_id, o_orderkey, o_totalprice AS p, CASE WHEN (o_orderkey * 7919) % 11 < 3 OR o_totalprice > 350000 THEN 1 ELSE 0 END AS y FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p, o_orderkey) - 1 AS rk FROM p)
SELECT series_id, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) - 1) / 2) / (sum(y) * sum(1 - y)), 6) + 0.0 AS auc FROM k GROUP BY 1""")
def auc_score(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), "o_orderkey", F.col("o_totalprice").alias("p"))
    rows = o.withColumn("y", (((F.col("o_orderkey") * 7919) % 11 < 3) | (F.col("p") > 350000)).cast("int"))
    return M.auc(rows, "y", "p", "o_orderkey", ["series_id"]).select("series_id", r("auc", 6).alias("auc"))
