"""Dashboard queries: mixes, roll-ups, segments, ranges, search, pages, calendars, bull and bear phases; and sink and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views as V
from .base import DAILY_SQL, daily, query, r, table

STATE_SQL = f"""{DAILY_SQL}, st AS (SELECT series_id AS scenario, date, CASE WHEN value < 100000 THEN 'NORMAL' WHEN value < 200000 THEN 'DEFCON2' ELSE 'DEFCON1' END AS state, CASE WHEN value < 300000 THEN value / 100000 END AS score, 'price ' || series_id AS triggers, value FROM daily)"""


def states(spark, sf) -> DataFrame:
    v = F.col("value")
    return daily(spark, sf).select(
        F.col("series_id").alias("scenario"), "date", F.when(v < 100000, "NORMAL").when(v < 200000, "DEFCON2").otherwise("DEFCON1").alias("state"),
        F.when(v < 300000, v / 100000).alias("score"), F.concat(F.lit("price "), "series_id").alias("triggers"), "value",
    )


@query(f"WITH {STATE_SQL}, d(state) AS (VALUES ('NORMAL'), ('DEFCON2'), ('DEFCON1'), ('WARMUP')), c AS (SELECT state, count(*) AS n FROM st GROUP BY 1) SELECT state, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100 / greatest(sum(coalesce(n, 0)) OVER (), 1), 4) + 0.0 AS pct FROM d LEFT JOIN c USING (state)")
def state_mix(spark, sf):
    return V.state_mix(states(spark, sf)).select("state", "n", r("pct").alias("pct"))


def _rollup_sql(bucket: str) -> str:
    return f"""WITH {STATE_SQL}, b AS (SELECT *, {bucket} AS bucket, day(date) % 2 = 0 AS trading FROM st),
m AS (SELECT scenario, bucket, state, count(*) AS n, min(date) AS first FROM b GROUP BY ALL), t AS (SELECT scenario, bucket, state FROM m QUALIFY row_number() OVER (PARTITION BY scenario, bucket ORDER BY n DESC, first) = 1),
a AS (SELECT scenario, bucket, avg(score) AS score, count(*) AS n_days, max(date) AS last, max(date) FILTER (trading) AS traded, arg_max(triggers, date) AS tr FROM b GROUP BY ALL)
SELECT scenario, bucket, coalesce(traded, last) AS date, state, round(score, 11) + 0.0 AS score, n_days, n_days || ' days aggregated. Last: ' || tr AS triggers FROM a JOIN t USING (scenario, bucket)"""


def rollup(spark, sf, period: str) -> DataFrame:
    rows = states(spark, sf).withColumn("trading", F.dayofmonth("date") % 2 == 0)
    return V.rollup(rows, period).withColumn("score", r("score", 11))


@query(_rollup_sql("CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE)"))
def period_rollup(spark, sf):
    return rollup(spark, sf, "week")


@query(_rollup_sql("last_day(date)"))
def month_rollup(spark, sf):
    return rollup(spark, sf, "month")


@query(f"""WITH {STATE_SQL}, a AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM st WINDOW w AS (PARTITION BY scenario ORDER BY date)),
g AS (SELECT *, sum(c) OVER (PARTITION BY scenario ORDER BY date) AS run FROM a), s AS (SELECT scenario, run, state, min(date) AS start, max(date) AS last FROM g GROUP BY ALL)
SELECT scenario, state, start, coalesce(lead(start) OVER (PARTITION BY scenario ORDER BY run), last + 1) AS "end", CAST(coalesce(lead(start) OVER (PARTITION BY scenario ORDER BY run), last + 1) - start AS INT) AS days FROM s""")
def state_segments(spark, sf):
    return V.segments(states(spark, sf))


@query(f"""WITH {STATE_SQL}, a AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM st WINDOW w AS (PARTITION BY scenario ORDER BY date)),
g AS (SELECT *, sum(c) OVER (PARTITION BY scenario ORDER BY date) AS run FROM a), s AS (SELECT scenario, run, state, min(date) AS start, max(date) AS last FROM g GROUP BY ALL),
e AS (SELECT scenario, state, start, coalesce(lead(start) OVER (PARTITION BY scenario ORDER BY run), last) AS "end" FROM s) SELECT *, CAST("end" - start AS INT) AS days FROM e WHERE state IN ('DEFCON1', 'DEFCON2')""")
def state_areas(spark, sf):
    """Runs of the states that are shown, the last of which ends with its last day."""
    return V.segments(states(spark, sf), past_end=False, only=["DEFCON1", "DEFCON2"])


def warming(spark, sf) -> DataFrame:
    """The states, the first 30 days of each scenario in WARMUP."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("scenario").orderBy("date"))
    return states(spark, sf).withColumn("state", F.when(n <= 30, "WARMUP").otherwise(F.col("state")))


WARMING_SQL = f"{STATE_SQL}, wm AS (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY scenario ORDER BY date) <= 30 THEN 'WARMUP' ELSE state END AS state) FROM st)"


@query(f"""WITH {WARMING_SQL}, b AS (SELECT scenario, min(date) AS a, max(date) AS z, min(date) FILTER (state <> 'WARMUP') AS ready FROM wm GROUP BY 1),
p AS (SELECT scenario, 'calendar' AS years, unnest(['max', 'default', '1y', '5y', '10y']) AS preset, unnest([a, coalesce(ready, a), CAST(z - INTERVAL 1 YEAR AS DATE), CAST(z - INTERVAL 5 YEAR AS DATE), CAST(z - INTERVAL 10 YEAR AS DATE)]) AS f, a, z FROM b
 UNION ALL SELECT scenario, 'days', unnest(['max', 'default', '1y', '5y', '10y']), unnest([a, coalesce(ready, a), z - 365, z - 1825, z - 3650]), a, z FROM b)
SELECT scenario, years, preset, greatest(a, f) AS start, z AS "end" FROM p""")
def range_presets(spark, sf):
    """The days of each preset, by years of the calendar and by 365 days."""
    rows = [V.range_presets(warming(spark, sf), by_calendar=c).withColumn("years", F.lit("calendar" if c else "days")) for c in (True, False)]
    return rows[0].unionByName(rows[1])


@query(f"""WITH {WARMING_SQL}, b AS (SELECT scenario, min(date) AS a, max(date) AS z FROM wm GROUP BY 1), w AS (SELECT scenario, date, date - 400 AS s, date + CAST((day(date) - 10) * 60 AS INT) AS e FROM wm),
k AS (SELECT *, greatest(a, s) AS start FROM w JOIN b USING (scenario)) SELECT scenario, date, start, CASE WHEN least(z, e) < start THEN start ELSE least(z, e) END AS "end" FROM k""")
def range_clamp(spark, sf):
    """For each day a range around it, clamped to the days that there are."""
    from pyspark.sql import Window as W

    all_ = W.partitionBy("scenario")
    rows = warming(spark, sf).select("scenario", "date", F.min("date").over(all_).alias("a"), F.max("date").over(all_).alias("z"))
    start, end = V.clamp_range(F.col("a"), F.col("z"), F.date_sub("date", 400), F.date_add("date", ((F.dayofmonth("date") - 10) * 60).cast("int")))
    return rows.select("scenario", "date", start.alias("start"), end.alias("end"))


@query(f"""WITH {WARMING_SQL}, f AS (SELECT scenario, date, state, value > 150000 AS hit, state IN ('DEFCON1', 'WARMUP') AS shown, day(date) % 4 <> 0 AS open FROM wm),
d AS (SELECT *, CASE WHEN hit AND shown AND open THEN 0 WHEN shown AND open THEN 1 WHEN open THEN 2 ELSE 3 END AS dropped FROM f)
SELECT p.scenario, p.date, p.dropped, CAST(count(q.date) FILTER (CASE p.dropped WHEN 0 THEN q.hit AND q.shown AND q.open WHEN 1 THEN q.shown AND q.open WHEN 2 THEN (q.shown OR q.state = p.state) AND q.open ELSE q.shown OR q.state = p.state END) // 200 AS INT) AS page
FROM d p LEFT JOIN d q ON q.scenario = p.scenario AND q.date > p.date GROUP BY ALL""")
def relaxed_pages(spark, sf):
    """For every day the filters that must go until it is seen, and its page then."""
    return V.relaxed_pages(warming(spark, sf), F.col("value") > 150000, ["DEFCON1", "WARMUP"], F.dayofmonth("date") % 4 != 0)


@query(f"""WITH {STATE_SQL}, f AS (SELECT scenario, date, coalesce(score > 1.5, false) AS fl FROM st), a AS (SELECT *, CASE WHEN fl <> lag(fl) OVER (PARTITION BY scenario ORDER BY date) THEN 1 ELSE 0 END AS c FROM f),
g AS (SELECT *, sum(c) OVER (PARTITION BY scenario ORDER BY date) AS run FROM a), s AS (SELECT scenario, run, fl, min(date) AS start, max(date) AS last FROM g GROUP BY ALL), e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY scenario ORDER BY run), last) AS fin FROM s)
SELECT scenario, start, fin AS "end" FROM e WHERE fl""")
def flag_ranges(spark, sf):
    return V.flag_ranges(states(spark, sf).withColumn("flag", F.col("score") > 1.5), "flag")


@query(f"WITH {STATE_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY scenario) AS c, row_number() OVER (PARTITION BY scenario ORDER BY date) AS rn FROM st) SELECT scenario, date, state FROM n WHERE (rn - 1) % greatest(1, CAST(ceil(c / 100.0) AS BIGINT)) = 0")
def downsample(spark, sf):
    from ..operators.windows import downsample as op

    return op(states(spark, sf), "scenario", "date", 100).select("scenario", "date", "state")


@query(f"WITH {STATE_SQL} SELECT scenario, date, state FROM st ORDER BY date DESC, scenario LIMIT 200 OFFSET 200")
def page_rows(spark, sf):
    return V.page(states(spark, sf), 2, tie="scenario").select("scenario", "date", "state")


@query(f"WITH {STATE_SQL} SELECT scenario, date, state, score FROM st WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND state IN ('DEFCON1', 'DEFCON2')")
def range_filter(spark, sf):
    return V.in_range(states(spark, sf), F.lit("1996-01-01").cast("date"), F.lit("1998-12-31").cast("date"), ["DEFCON1", "DEFCON2"]).select("scenario", "date", "state", "score")


@query(f"WITH {STATE_SQL} SELECT scenario, date, state FROM st WHERE lower(triggers) LIKE '%urg%' OR lower(state) LIKE '%urg%'")
def text_search(spark, sf):
    return V.text_search(states(spark, sf), "URG", ["triggers", "state"]).select("scenario", "date", "state")


@query(f"""WITH {STATE_SQL}, d AS (SELECT * FROM st WHERE date <= DATE '1999-07-04' QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY date DESC) = 1) SELECT scenario, date AS as_of, state, score FROM d""")
def date_detail(spark, sf):
    rows = states(spark, sf).filter(F.col("date") <= F.lit("1999-07-04").cast("date"))
    best = rows.groupBy("scenario").agg(F.max(F.struct("date", "state", "score")).alias("d"))
    return best.select("scenario", F.col("d.date").alias("as_of"), "d.state", "d.score")


_Y = "year(date)"
TRADING_SQL = """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders), c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
y AS (SELECT unnest(range(1994, 2004))::INT AS y), e0 AS (SELECT y, y % 19 AS ga, y // 100 AS gb, y % 100 AS gc FROM y),
e1 AS (SELECT *, (19 * ga + gb - gb // 4 - (gb - (gb + 8) // 25 + 1) // 3 + 15) % 30 AS gh FROM e0), e2 AS (SELECT *, (32 + 2 * (gb % 4) + 2 * (gc // 4) - gh - gc % 4) % 7 AS gl FROM e1),
e3 AS (SELECT y, gh + gl - 7 * ((ga + 11 * gh + 22 * gl) // 451) + 114 AS g FROM e2), e AS (SELECT y, make_date(y, (g // 31)::INT, (g % 31 + 1)::INT) AS easter FROM e3),
f AS (SELECT make_date(y, m, d) AS h FROM y, (VALUES (1, 1), (6, 19), (7, 4), (12, 25)) v(m, d)),
days AS (SELECT y, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM y),
h AS (SELECT CASE dayofweek(h) WHEN 6 THEN h - 1 WHEN 0 THEN h + 1 ELSE h END AS d FROM f UNION SELECT easter - 2 FROM e
 UNION SELECT d FROM days WHERE (month(d) IN (1, 2) AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND dayofweek(d) = 1 AND day(d) >= 25) OR (month(d) = 9 AND dayofweek(d) = 1 AND day(d) <= 7) OR (month(d) = 11 AND dayofweek(d) = 4 AND day(d) BETWEEN 22 AND 28))
SELECT date, dayofweek(date) NOT IN (0, 6) AND date NOT IN (SELECT d FROM h) AS trading FROM c"""


@query(TRADING_SQL)
def trading_calendar(spark, sf):
    from ..operators.prep import calendar

    o = table(spark, sf, "orders")
    days = calendar(o.agg(F.min(F.col("o_orderdate").cast("date")).alias("first"), F.max(F.col("o_orderdate").cast("date")).alias("last")))
    return days.select("date", V.trading_day(F.col("date")).alias("trading"))


BULL_SQL = f"""{DAILY_SQL}, n AS MATERIALIZED (SELECT series_id, date, 1000 + value / 1000 AS value, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM daily),
f AS (SELECT series_id, rn, date, 'BULL' AS regime, date AS start, value AS level, NULL::VARCHAR AS done, NULL::DATE AS done_start FROM n WHERE rn = 1
 UNION ALL
 SELECT series_id, rn, date, CASE WHEN turn THEN CASE regime WHEN 'BULL' THEN 'BEAR' ELSE 'BULL' END ELSE regime END, CASE WHEN turn THEN date ELSE start END, CASE WHEN turn THEN value ELSE lv END, CASE WHEN turn THEN regime END, CASE WHEN turn THEN start END
 FROM (SELECT *, CASE regime WHEN 'BULL' THEN value <= lv * 0.8 ELSE value >= lv * 1.2 END AS turn FROM (
  SELECT n.series_id, n.rn, n.date, n.value, f.regime, f.start, CASE f.regime WHEN 'BULL' THEN greatest(f.level, n.value) ELSE least(f.level, n.value) END AS lv FROM f JOIN n ON n.series_id = f.series_id AND n.rn = f.rn + 1))),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rn DESC) = 1),
seg AS (SELECT series_id, done AS regime, done_start AS start, date AS "end", false AS open FROM f WHERE done IS NOT NULL UNION ALL SELECT series_id, regime, start, date, true FROM l)"""


def closes(spark, sf) -> DataFrame:
    return daily(spark, sf).withColumn("value", 1000 + F.col("value") / 1000)


@query(f'WITH RECURSIVE {BULL_SQL} SELECT series_id, regime, start, "end", open, CAST("end" - start AS INT) AS days FROM seg')
def bull_bear(spark, sf):
    return V.bull_bear(closes(spark, sf))


@query(f"""WITH RECURSIVE {BULL_SQL}, d AS (SELECT *, CAST("end" - start AS INT) AS days FROM seg), c AS (SELECT * FROM d WHERE NOT open AND days >= 20 QUALIFY row_number() OVER (PARTITION BY series_id, regime ORDER BY start DESC) <= 12),
t AS (SELECT series_id, regime, quantile_cont(days, 0.5) AS typical FROM c GROUP BY ALL), g AS (SELECT d.*, coalesce(typical, CASE d.regime WHEN 'BULL' THEN 252.0 ELSE 126.0 END) AS ty FROM d LEFT JOIN t USING (series_id, regime) WHERE open)
SELECT series_id, regime, ty::DOUBLE AS typical, round(least(1, greatest(0, days / nullif(ty, 0))), 6) + 0.0 AS progress, start + CAST(floor(ty + 0.5) AS INT) AS switch, start + CAST(floor(ty + 0.5) AS INT) - greatest(1, CAST(floor(ty * 0.2 + 0.5) AS INT)) AS window_start FROM g""")
def phase_gauge(spark, sf):
    g = V.phase_gauge(V.bull_bear(closes(spark, sf)))
    return g.select("series_id", "regime", "typical", r("progress", 6).alias("progress"), "switch", "window_start")


@query(f"""WITH {STATE_SQL}, t AS (SELECT * FROM st WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY date DESC) <= 120) SELECT scenario, count(*) >= 30 AND bool_and(score >= 0.05) AS saturated FROM t GROUP BY 1""")
def saturation_check(spark, sf):
    return V.all_at_least(states(spark, sf), "scenario", "score", floor=0.05)


@query(f"""WITH {DAILY_SQL}, t AS (SELECT * FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') SELECT series_id, round((arg_max(value, date) - arg_min(value, date)) / nullif(arg_min(value, date), 0) * 100, 4) + 0.0 AS pct FROM t GROUP BY 1""")
def range_return(spark, sf):
    d = V.range_return(daily(spark, sf), F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return d.select("series_id", r("pct").alias("pct"))


@query(f"""WITH {STATE_SQL} SELECT scenario, min(date) FILTER (state <> 'NORMAL') AS first_alert, max(date) AS last_date, greatest(min(date), max(date) - INTERVAL 5 YEAR)::DATE AS start_5y FROM st GROUP BY 1""")
def default_range(spark, sf):
    s = states(spark, sf).groupBy("scenario").agg(F.min(F.when(F.col("state") != "NORMAL", F.col("date"))).alias("first_alert"), F.max("date").alias("last_date"), F.min("date").alias("a"))
    return s.select("scenario", "first_alert", "last_date", F.greatest("a", F.add_months("last_date", -60)).alias("start_5y"))


@query(f"""WITH {STATE_SQL} SELECT scenario, date, page FROM (SELECT scenario, date, (row_number() OVER (PARTITION BY scenario ORDER BY date DESC) - 1) // 200 AS page FROM st)""")
def page_of(spark, sf):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("date"))) - 1
    return states(spark, sf).select("scenario", "date", F.floor(n / 200).alias("page"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) + 0.0 AS qty, round(avg(l_discount), 6) + 0.0 AS discount FROM lineitem GROUP BY ALL""")
def flag_summary(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty"), r(F.avg("l_discount"), 6).alias("discount"))


@query("""WITH o AS (SELECT n_name, r_name, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) + 0.0 AS total FROM o GROUP BY ALL""")
def dimension_lookup(spark, sf):
    """Dimensions by key; nation and region are fixed tables of a few rows, and Spark broadcasts what is small enough by its statistics."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    per = o.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    named = per.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", "n", r("total", 2).alias("total"))
