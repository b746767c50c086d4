"""Queries over the ledger and daily series: scans, parsing, windows, joins, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import prep, scans
from ..operators import windows as W
from ..sources import files
from .base import DAILY_SQL, LEDGER_SQL, MONTHLY_SQL, ORACLES, daily, events_ledger, monthly, ms_of, query, r, table



def w():
    """Each series in time order; made when asked for, as it needs a session."""
    return W.by("series_id", "date")


DAY = "OVER (PARTITION BY series_id ORDER BY date)"
OVER = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def over(n: int) -> str:
    return OVER.format(n=n - 1)


@query(f"WITH {LEDGER_SQL} SELECT series_id, time_utc_ms, interval, round(value, 4) + 0.0 AS value FROM ledger")
def observations_scan(spark, sf):
    return events_ledger(spark, sf).select("series_id", "time_utc_ms", "interval", r("value").alias("value"))


@query(f"WITH {LEDGER_SQL} SELECT series_id, time_utc_ms, seq FROM ledger WHERE series_id IN ('click', 'view') AND interval = '1D'")
def in_filter(spark, sf):
    return events_ledger(spark, sf).filter(F.col("series_id").isin("click", "view") & (F.col("interval") == "1D")).select("series_id", "time_utc_ms", "seq")


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value, 4) + 0.0 AS value FROM daily WHERE date < DATE '2000-01-01' ORDER BY date DESC, series_id LIMIT 30")
def recent_limit(spark, sf):
    return daily(spark, sf).filter(F.col("date") < F.lit("2000-01-01").cast("date")).orderBy(F.desc("date"), "series_id").limit(30).select("series_id", "date", r("value").alias("value"))


@query(f"WITH {LEDGER_SQL} SELECT series_id, time_utc_ms, interval, round(value, 4) + 0.0 AS value, seq FROM ledger QUALIFY row_number() OVER (PARTITION BY series_id, time_utc_ms, interval ORDER BY received_at DESC, seq DESC) = 1")
def dedupe_lww(spark, sf):
    return prep.dedupe_lww(events_ledger(spark, sf)).select("series_id", "time_utc_ms", "interval", r("value").alias("value"), "seq")


@query(f"WITH {LEDGER_SQL} SELECT series_id, time_utc_ms, interval, round(value, 4) + 0.0 AS value, seq FROM ledger WHERE series_id IN ('click', 'purchase') AND interval = '1D'")
def series_scan(spark, sf):
    """The rows of some series; of the ids one is blank and one unknown."""
    rows = files.scan_series(events_ledger(spark, sf), ["click", "", None, "purchase", "nothing"], "1D")
    return rows.select("series_id", "time_utc_ms", "interval", r("value").alias("value"), "seq")


@query(f"WITH {LEDGER_SQL} SELECT series_id, seq, time_utc_ms, CASE WHEN seq % 3 = 0 THEN time_utc_ms ELSE epoch_us(received_at) // 1000 END AS arrival_ms FROM ledger")
def event_times(spark, sf):
    """Each observation's own time and its time by arrival, where every third arrival can't be read."""
    text = F.when(F.col("seq") % 3 == 0, F.when(F.col("seq") % 2 == 0, "soon")).otherwise(F.col("received_at").cast("string"))
    rows = events_ledger(spark, sf).withColumn("text", text)
    own, came = (F.unix_millis(S.event_time(F.col("time_utc_ms"), F.col("text"), by)) for by in (False, True))
    return rows.select("series_id", "seq", own.alias("time_utc_ms"), came.alias("arrival_ms"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value, 4) + 0.0 AS value FROM daily")
def daily_last(spark, sf):
    return daily(spark, sf).select("series_id", "date", r("value").alias("value"))


@query("WITH e AS (SELECT event_type AS series_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS date, ts, event_id, value FROM events) SELECT series_id, date, round(value, 4) + 0.0 AS value FROM e QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY ts DESC, event_id DESC) = 1")
def daily_last_local(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "value", F.col("event_id").alias("seq"))
    return prep.daily_last(e, "Asia/Seoul").select("series_id", "date", r("value").alias("value"))


@query(f"""WITH {DAILY_SQL} SELECT date, round(max(value) FILTER (series_id = '1-URGENT'), 4) + 0.0 AS urgent, round(max(value) FILTER (series_id = '5-LOW'), 4) + 0.0 AS low FROM daily GROUP BY date""")
def pivot_wide(spark, sf):
    return prep.pivot_wide(daily(spark, sf), ["1-URGENT", "5-LOW"]).select("date", r("`1-URGENT`").alias("urgent"), r("`5-LOW`").alias("low"))


@query(f"WITH {DAILY_SQL} SELECT date, series_id, round(value, 4) + 0.0 AS value FROM daily WHERE series_id IN ('1-URGENT', '2-HIGH', '5-LOW')")
def unpivot_long(spark, sf):
    ids = ["1-URGENT", "2-HIGH", "5-LOW"]
    return prep.unpivot_long(prep.pivot_wide(daily(spark, sf), ids), ids).select("date", "series_id", r("value").alias("value"))


@query(f"""WITH {DAILY_SQL}, p AS (SELECT date, max(value) FILTER (series_id = '1-URGENT') AS a, max(value) FILTER (series_id = '2-HIGH') AS b FROM daily GROUP BY date) SELECT date, round(coalesce(a, b), 4) + 0.0 AS urgent FROM p""")
def alias_merge(spark, sf):
    return prep.alias_merge(prep.pivot_wide(daily(spark, sf), ["1-URGENT", "2-HIGH"]), "1-URGENT", "2-HIGH").select("date", r("`1-URGENT`").alias("urgent"))


@query(f"""WITH {DAILY_SQL}, p AS (SELECT date, max(value) FILTER (series_id = '1-URGENT') AS a, max(value) FILTER (series_id = '2-HIGH') AS b, max(value) FILTER (series_id = '5-LOW') / 1000 AS c FROM daily GROUP BY date) SELECT date, round(coalesce(c, a / nullif(b, 0)), 6) + 0.0 AS ratio FROM p""")
def ratio_fill(spark, sf):
    p = prep.pivot_wide(daily(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"]).withColumn("ratio", F.col("5-LOW") / 1000)
    return prep.ratio_fill(p, "ratio", "1-URGENT", "2-HIGH").select("date", r("ratio", 6).alias("ratio"))


@query("""WITH e AS (SELECT event_id, upper(event_type) AS s, epoch_us(ts) // 1000 AS ms, event_id % 4 AS k FROM events) SELECT event_id, k <> 3 AS valid, CASE WHEN k <> 3 THEN CASE s WHEN 'VIEW' THEN 'PAGE_VIEW' ELSE s END END AS series_id,
CASE WHEN k = 1 THEN ms WHEN k <> 3 THEN ms // 1000 * 1000 END AS time_utc_ms FROM e""")
def json_loose_parse(spark, sf):
    """Payloads of four shapes made from the events: aliases, bare times, epoch seconds, and broken text."""
    e = table(spark, sf, "events")
    ms, kind = ms_of(F.col("ts")), F.col("event_id") % 4
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(kind == 0, F.concat(F.lit('{"series_id": "'), "event_type", F.lit('", "time_utc": '), iso, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"seriesId": "'), "event_type", F.lit('", "time": '), ms.cast("string"), F.lit("}")))
    raw = raw.when(kind == 2, F.concat(F.lit('{"series_id": "'), "event_type", F.lit('", "time utc": "'), F.floor(ms / 1000).cast("string"), F.lit('"}'))).otherwise(F.lit("{broken"))
    rows = e.select("event_id", S.loose_json(raw).alias("json"))
    return rows.select("event_id", F.col("json").isNotNull().alias("valid"), S.canonical_series(S.payload_field(F.col("json"), "series_id"), {"VIEW": "PAGE_VIEW"}).alias("series_id"), S.to_ms(S.payload_field(F.col("json"), "time_utc")).alias("time_utc_ms"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 ELSE (epoch_us(ts) // 1000000) * 1000 END AS time_utc_ms FROM events")
def ts_normalise(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_id") % 3
    ms = ms_of(F.col("ts"))
    text = F.when(kind == 0, ms.cast("string")).when(kind == 1, F.floor(ms / 1000).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", S.to_ms(text).alias("time_utc_ms"))


@query("SELECT o_orderkey, CASE upper(trim(o_orderpriority)) WHEN '1-URGENT' THEN 'URGENT' WHEN '5-LOW' THEN 'LOW' ELSE upper(trim(o_orderpriority)) END AS series_id FROM orders")
def series_canonical(spark, sf):
    raw = F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" "))
    return table(spark, sf, "orders").select("o_orderkey", S.canonical_series(raw, {"1-URGENT": "URGENT", "5-LOW": "LOW"}).alias("series_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 4) + 0.0 END AS value FROM events")
def value_cast(spark, sf):
    text = F.when(F.col("event_id") % 10 == 0, "n/a").when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", r(S.num(text)).alias("value"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(20)} >= 20 THEN round(avg(value) {over(20)}, 4) + 0.0 END AS ma FROM daily")
def sma_full(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.mean(F.col("value"), w(), 20)).alias("ma"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(120)} >= 60 THEN round(value / nullif(avg(value) {over(120)}, 0), 7) + 0.0 END AS to_ma FROM daily")
def sma_partial(spark, sf):
    rows = W.rolling(daily(spark, sf), "series_id", "date", 120, {"ma": ("mean", F.col("value"), 60)})
    return rows.select("series_id", "date", r(F.col("value") / F.nullif("ma", F.lit(0.0)), 7).alias("to_ma"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(20)} >= 20 THEN round(stddev_samp(value) {over(20)}, 3) + 0.0 END AS sd FROM daily")
def roll_std_samp(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.std(F.col("value"), w(), 20), 3).alias("sd"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(63)} >= 21 THEN round(stddev_pop(value) {over(63)}, 3) + 0.0 END AS sd FROM daily")
def roll_std_pop(spark, sf):
    rows = W.rolling(daily(spark, sf), "series_id", "date", 63, {"sd": ("std_pop", F.col("value"), 21)})
    return rows.select("series_id", "date", r("sd", 3).alias("sd"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(60)} >= 20 THEN round((value - avg(value) {over(60)}) / nullif(stddev_pop(value) {over(60)}, 0), 6) + 0.0 END AS z FROM daily")
def roll_zscore(spark, sf):
    rows = W.rolling(daily(spark, sf), "series_id", "date", 60, {"z": ("z_pop", F.col("value"), 20)})
    return rows.select("series_id", "date", r("z", 6).alias("z"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, CASE WHEN count(value) {over(60)} >= 30 THEN round(quantile_cont(value, 0.5) {over(60)}, 4) + 0.0 END AS med FROM daily")
def roll_median(spark, sf):
    rows = W.rolling_median(daily(spark, sf), "series_id", "date", 60, "med", F.col("value"), 30)
    return rows.select("series_id", "date", r("med").alias("med"))


@query(f"""WITH {DAILY_SQL}, a AS (SELECT series_id, date, value / nullif(lag(value) {DAY}, 0) - 1 AS ret FROM daily),
b AS (SELECT series_id, date, list(ret) FILTER (ret IS NOT NULL) {over(21)} AS xs FROM a),
c AS (SELECT series_id, date, len(xs) AS n, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM b),
d AS (SELECT series_id, date, n, x, pow(1 - 2.0 / 21, n - i) AS k FROM c),
e AS (SELECT series_id, date, max(n) AS n, sum(k) AS sw, sum(k * k) AS sw2, sum(k * x) AS swx, sum(k * x * x) AS swxx FROM d GROUP BY ALL)
SELECT series_id, a.date, CASE WHEN n >= 2 THEN round(sqrt(greatest(0, (swxx / sw - pow(swx / sw, 2)) * sw * sw / nullif(sw * sw - sw2, 0))), 5) + 0.0 END AS ewma FROM a LEFT JOIN e USING (series_id, date)""")
def ewma_vol(spark, sf):
    rows = daily(spark, sf).withColumn("ret", W.pct_change(F.col("value"), w()))
    return rows.select("series_id", "date", r(W.ewma_std(F.col("ret"), w()), 5).alias("ewma"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value - lag(value, 21) {DAY}, 4) + 0.0 AS d21 FROM daily")
def diff_n(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.diff(F.col("value"), w(), 21)).alias("d21"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value / nullif(lag(value, 126) {DAY}, 0) - 1, 6) + 0.0 AS p126 FROM daily")
def pct_change_n(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.pct_change(F.col("value"), w(), 126), 6).alias("p126"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(lead(value, 63) {DAY}, 4) + 0.0 AS ahead FROM daily")
def lead_label(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(F.lead("value", 63).over(w())).alias("ahead"))


@query(f"WITH {DAILY_SQL}, g AS (SELECT series_id, date, CASE WHEN day(date) % 3 <> 0 THEN value END AS value FROM daily) SELECT series_id, date, round(last_value(value IGNORE NULLS) {DAY}, 4) + 0.0 AS filled FROM g")
def ffill_series(spark, sf):
    gaps = daily(spark, sf).withColumn("value", F.when(F.dayofmonth("date") % 3 != 0, F.col("value")))
    return gaps.select("series_id", "date", r(W.ffill(F.col("value"), w())).alias("filled"))


@query(f"WITH {DAILY_SQL}, a AS (SELECT series_id, date, 1 + coalesce(0.001 * (value / nullif(lag(value) {DAY}, 0) - 1), 0) AS g FROM daily) SELECT series_id, date, round(product(g) {DAY}, 5) + 0.0 AS curve FROM a")
def cum_product(spark, sf):
    rows = daily(spark, sf).withColumn("g", 1 + F.coalesce(0.001 * W.pct_change(F.col("value"), w()), F.lit(0.0)))
    return rows.select("series_id", "date", r(W.cumulative_product(F.col("g"), w()), 5).alias("curve"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value / max(value) {DAY} - 1, 6) + 0.0 AS dd FROM daily")
def drawdown(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.drawdown(F.col("value"), w()), 6).alias("dd"))


@query(f"WITH {DAILY_SQL}, a AS (SELECT series_id, date, value > 150000 AS f, row_number() {DAY} AS n FROM daily) SELECT series_id, date, n - coalesce(max(CASE WHEN NOT f THEN n END) {DAY}, 0) AS streak FROM a")
def streaks(spark, sf):
    return W.with_streak(daily(spark, sf), F.col("value") > 150000, "series_id", "date", "streak").select("series_id", "date", F.col("streak").cast("long"))


@query(f"""WITH {DAILY_SQL}, a AS (SELECT series_id, date, count(value) {over(20)} >= 20 AND value < avg(value) {over(20)} AS f FROM daily)
SELECT series_id, date, count(*) {over(5)} = 5 AND bool_and(f) {over(5)} AS below FROM a""")
def consecutive_below_ma(spark, sf):
    rows = daily(spark, sf).withColumn("ma", W.mean(F.col("value"), w(), 20))
    return rows.select("series_id", "date", W.all_of_last(F.col("ma").isNotNull() & (F.col("value") < F.col("ma")), w(), 5).alias("below"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, coalesce(lag(value - 150000) {DAY} < 0 AND value >= 150000, false) AS crossed FROM daily")
def cross_up(spark, sf):
    rows = daily(spark, sf).withColumn("x", F.col("value") - 150000)
    return rows.select("series_id", "date", W.cross_up(F.col("x"), w()).alias("crossed"))


@query(f"WITH {DAILY_SQL} SELECT series_id, date, round(value - coalesce(lag(value, 20) {DAY}, first_value(value) {DAY}), 4) + 0.0 AS slope FROM daily")
def slope_lookback(spark, sf):
    return daily(spark, sf).select("series_id", "date", r(W.slope(F.col("value"), w())).alias("slope"))


@query(f"""WITH {DAILY_SQL}, b AS (SELECT max(date) AS as_of FROM daily), l AS (SELECT series_id, max(date) AS d FROM daily GROUP BY 1)
SELECT series_id, CAST(date_diff('day', d, as_of) AS INT) AS age, date_diff('day', d, as_of) > 4 AS late, date_diff('day', d, as_of) > 5 AS stale FROM l, b""")
def age_stale(spark, sf):
    d = daily(spark, sf)
    last = d.groupBy("series_id").agg(F.max("date").alias("d"))
    age = F.datediff(F.lit(d.agg(F.max("date")).first()[0]), "d")
    return last.select("series_id", age.alias("age"), (age > 4).alias("late"), (age > 5).alias("stale"))


ALL_PROBES_SQL = DAILY_SQL + ", ends AS (SELECT min(date) AS a, max(date) AS z FROM daily), days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM ends), probes AS (SELECT series_id, date FROM (SELECT DISTINCT series_id FROM daily), days), facts AS (SELECT series_id, date, date AS as_of, value FROM daily)"


def all_probes(spark, sf):
    """Every series on every day from the table's first date to its last, and all facts."""
    facts = daily(spark, sf)
    ends = facts.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return prep.calendar(facts.select("series_id").distinct().crossJoin(ends)), facts


@query(f"WITH {ALL_PROBES_SQL} SELECT p.series_id, p.date, f.as_of, round(f.value, 4) + 0.0 AS value FROM probes p ASOF LEFT JOIN facts f ON p.series_id = f.series_id AND p.date >= f.date")
def asof_join_all(spark, sf):
    days, facts = all_probes(spark, sf)
    return prep.as_of(days, facts, ["series_id"], ["value"]).select("series_id", "date", "as_of", r("value").alias("value"))


@query(f"""WITH {ALL_PROBES_SQL}, b AS (SELECT p.series_id, p.date, f.as_of AS bd, f.value AS bv FROM probes p ASOF LEFT JOIN facts f ON p.series_id = f.series_id AND p.date >= f.date),
a AS (SELECT p.series_id, p.date, f.as_of AS ad, f.value AS av FROM probes p ASOF LEFT JOIN facts f ON p.series_id = f.series_id AND p.date <= f.date), c AS (SELECT *, ad IS NULL OR date - bd <= ad - date AS early FROM b JOIN a USING (series_id, date))
SELECT series_id, date, CASE WHEN early THEN bd ELSE ad END AS as_of, round(CASE WHEN early THEN bv ELSE av END, 4) + 0.0 AS value FROM c""")
def nearest_join_all(spark, sf):
    days, facts = all_probes(spark, sf)
    return prep.nearest(days, facts, ["series_id"], ["value"]).select("series_id", "date", "as_of", r("value").alias("value"))


#: Rows of a block in the queries that cut series into blocks, so that the given tables have several.
BLOCK = 1500


@query(ORACLES["asof_join_all"])
def asof_join_blocks(spark, sf):
    """The same join for series of any length: no task reads a whole one."""
    days, facts = all_probes(spark, sf)
    return scans.as_of(days, facts, ["series_id"], ["value"], rows_per_block=BLOCK).select("series_id", "date", "as_of", r("value").alias("value"))


@query(ORACLES["nearest_join_all"])
def nearest_join_blocks(spark, sf):
    days, facts = all_probes(spark, sf)
    return scans.nearest(days, facts, ["series_id"], ["value"], rows_per_block=BLOCK).select("series_id", "date", "as_of", r("value").alias("value"))


@query(f"""WITH {DAILY_SQL}, a AS (SELECT *, CASE WHEN day(date) % 3 <> 0 THEN value END AS v, value > 150000 AS f, row_number() {DAY} AS n FROM daily)
SELECT series_id, date, round(last_value(v IGNORE NULLS) {DAY}, 4) + 0.0 AS filled, round(sum(v) {DAY}, 2) + 0.0 AS total, round(product(1 + 0.001 * coalesce(v / 200000 - 1, 0)) {DAY}, 5) + 0.0 AS curve, round(value / max(value) {DAY} - 1, 6) + 0.0 AS dd,
 n - coalesce(max(CASE WHEN NOT f THEN n END) {DAY}, 0) AS streak FROM a""")
def series_scans(spark, sf):
    """Forward fill, sum, product, drawdown and streak of series that are cut into blocks."""
    c, rows = F.col, daily(spark, sf).withColumn("v", F.when(F.dayofmonth("date") % 3 != 0, F.col("value")))
    growth = 1 + 0.001 * F.coalesce(c("v") / 200000 - 1, F.lit(0.0))
    stats = {"filled": ("ffill", c("v")), "total": ("sum", c("v")), "curve": ("product", growth), "top": ("max", c("value")), "streak": ("streak", c("value") > 150000)}
    rows = scans.scan(rows, ["series_id"], "date", scans.time_blocks(rows, "date", BLOCK), stats)
    return rows.select("series_id", "date", r("filled").alias("filled"), r("total", 2).alias("total"), r("curve", 5).alias("curve"), r(c("value") / c("top") - 1, 6).alias("dd"), "streak")


@query(f"""WITH {DAILY_SQL}, s AS (SELECT series_id, date, CASE WHEN value > 200000 THEN 'DEFCON2' ELSE 'NORMAL' END AS state FROM daily WHERE day(date) = 15)
SELECT d.series_id, d.date, coalesce(last_value(s.state IGNORE NULLS) OVER (PARTITION BY d.series_id ORDER BY d.date), 'WARMUP') AS state FROM daily d LEFT JOIN s USING (series_id, date)""")
def state_ffill_join(spark, sf):
    d = daily(spark, sf)
    states = d.filter(F.dayofmonth("date") == 15).select("series_id", "date", F.when(F.col("value") > 200000, "DEFCON2").otherwise("NORMAL").alias("state"))
    return prep.left_ffill(d, states, ["series_id"], "state", "WARMUP").select("series_id", "date", "state")


@query(f"""WITH {DAILY_SQL}, o AS (SELECT series_id, date, value FROM daily WHERE date < DATE '1998-01-01'), n AS (SELECT series_id, date, value * 2 AS value FROM daily WHERE date >= DATE '1997-06-01')
SELECT series_id, date, round(coalesce(n.value, o.value), 4) + 0.0 AS value FROM n FULL JOIN o USING (series_id, date)""")
def merge_precedence(spark, sf):
    d = daily(spark, sf)
    new = d.filter(F.col("date") >= F.lit("1997-06-01").cast("date")).withColumn("value", F.col("value") * 2)
    return prep.merge_rows(new, d.filter(F.col("date") < F.lit("1998-01-01").cast("date")), ["series_id", "date"]).select("series_id", "date", r("value").alias("value"))


@query(f"""WITH {DAILY_SQL}, n AS (SELECT series_id, date, CASE WHEN day(date) % 2 = 0 THEN value * 2 END AS value FROM daily)
SELECT series_id, date, round(coalesce(n.value, o.value), 4) + 0.0 AS value FROM n FULL JOIN daily o USING (series_id, date)""")
def merge_cells(spark, sf):
    d = daily(spark, sf)
    new = d.withColumn("value", F.when(F.dayofmonth("date") % 2 == 0, F.col("value") * 2))
    return prep.merge_cells(new, d, ["series_id", "date"]).select("series_id", "date", r("value").alias("value"))


@query(f"""WITH {DAILY_SQL}, b AS (SELECT min(date) AS a, max(date) AS z FROM daily), c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b)
SELECT c.date, round(d.value, 4) + 0.0 AS value FROM c LEFT JOIN (SELECT * FROM daily WHERE series_id = '1-URGENT') d USING (date)""")
def calendar_left_join(spark, sf):
    d = daily(spark, sf)
    days = prep.calendar(d.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    return days.join(d.filter("series_id = '1-URGENT'").select("date", "value"), "date", "left").select("date", r("value").alias("value"))


@query(f"WITH {MONTHLY_SQL} SELECT series_id, month_end, round(value, 4) + 0.0 AS value FROM monthly")
def month_close(spark, sf):
    return monthly(spark, sf).select("series_id", "month_end", r("value").alias("value"))


@query(f"WITH {DAILY_SQL} SELECT series_id, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) + 1 = count(*) AS contiguous FROM daily GROUP BY 1")
def contiguity(spark, sf):
    return prep.contiguity(daily(spark, sf), ["series_id"])


@query(f"""WITH {DAILY_SQL}, c(asset, series_id, priority) AS (VALUES ('FAST', '0-NONE', 1), ('FAST', '1-URGENT', 2), ('FAST', '2-HIGH', 3), ('SLOW', '5-LOW', 1)),
k AS (SELECT c.* FROM c WHERE series_id IN (SELECT series_id FROM daily)), p AS (SELECT asset, arg_min(series_id, priority) AS series_id FROM k GROUP BY 1)
SELECT asset, series_id, date, round(value, 4) + 0.0 AS value FROM daily JOIN p USING (series_id)""")
def candidate_lookup(spark, sf):
    c = spark.createDataFrame([("FAST", "0-NONE", 1), ("FAST", "1-URGENT", 2), ("FAST", "2-HIGH", 3), ("SLOW", "5-LOW", 1)], "asset string, series_id string, priority int")
    return prep.first_candidate(daily(spark, sf), c).select("asset", "series_id", "date", r("value").alias("value"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice - 150000 > 0 THEN ln(o_totalprice - 150000) END, 6) + 0.0 AS safe_log, round(1 / (1 + exp(-greatest(-35, least(35, (o_totalprice - 150000) / 1000)))), 8) + 0.0 AS sigmoid,
round((o_totalprice % 7) / 7 * 2 * pi() - 2 * pi() * floor(((o_totalprice % 7) / 7 * 2 * pi() - 1 + pi()) / (2 * pi())) - 1, 6) + 0.0 AS circular, round_even(o_totalprice / 1000, 0) AS half_even, floor(o_totalprice / 1000 + 0.5)::BIGINT AS half_up FROM orders""")
def scalar_functions(spark, sf):
    x = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", r(S.safe_log(x - 150000), 6).alias("safe_log"), r(S.sigmoid((x - 150000) / 1000), 8).alias("sigmoid"),
        r(S.circular_distance((x % 7) / 7 * S.TAU, 1.0), 6).alias("circular"), F.bround(x / 1000, 0).alias("half_even"), S.half_up(x / 1000).alias("half_up"),
    )


@query("""WITH p AS (SELECT o_orderkey, o_totalprice / 600000 AS p FROM orders) SELECT o_orderkey, CASE WHEN p < 0.1 THEN 'very low' WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'medium' WHEN p < 0.75 THEN 'high' ELSE 'very high' END AS level,
CASE WHEN p - 0.3 >= 0.15 THEN 'Strong overheat bias' WHEN p - 0.3 >= 0.05 THEN 'Overheat bias' WHEN p - 0.3 <= -0.15 THEN 'Strong risk-off bias' WHEN p - 0.3 <= -0.05 THEN 'Risk-off bias' ELSE 'Mixed/neutral' END AS bias FROM p""")
def net_bias(spark, sf):
    p = F.col("o_totalprice") / 600000
    return table(spark, sf, "orders").select("o_orderkey", S.level_label(p).alias("level"), S.bias_label(p - 0.3).alias("bias"))
