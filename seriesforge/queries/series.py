"""Queries over events and orders as time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import forecast as fc
from ..operators import series as s
from . import query, rounded, table

_METRICS = [("count", "*"), ("sum", "value"), ("avg", "value")]


def _gapfill_sql(freq: str, step: str) -> str:
    return f"""
WITH a AS (SELECT event_type, date_trunc('{freq}', ts)::TIMESTAMP AS period, count(*) AS count_all, sum(value) AS sum_value, avg(value) AS avg_value FROM events GROUP BY 1, 2),
e AS (SELECT event_type, min(period) AS lo, max(period) AS hi FROM a GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL {step})) AS period FROM e)
SELECT g.event_type, g.period, coalesce(count_all, 0) AS count_all, round(coalesce(sum_value, 0), 4) AS sum_value, round(coalesce(avg_value, 0), 4) AS avg_value
FROM g LEFT JOIN a ON a.event_type = g.event_type AND a.period = g.period"""


def _gapfill(spark, sf_dir, freq):
    return rounded(s.aggregate(table(spark, sf_dir, "events"), "ts", freq, _METRICS, ["event_type"])).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(_gapfill_sql("hour", "1 HOUR"))
def gapfill_hourly(spark, sf_dir):
    return _gapfill(spark, sf_dir, "hour")


@query(_gapfill_sql("day", "1 DAY"))
def gapfill_daily(spark, sf_dir):
    return _gapfill(spark, sf_dir, "day")


@query(_gapfill_sql("week", "7 DAY"))
def gapfill_weekly(spark, sf_dir):
    return _gapfill(spark, sf_dir, "week")


@query("""
WITH a AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_orderstatus, sum(o_totalprice) AS v, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1, 2),
e AS (SELECT o_orderstatus, min(period) AS a, max(period) AS b FROM a GROUP BY 1),
g AS (SELECT o_orderstatus, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS period FROM e)
SELECT g.o_orderstatus, g.period, round(coalesce(v, 0), 2) AS sum_o_totalprice, coalesce(lo, 0) AS min_o_totalprice, coalesce(hi, 0) AS max_o_totalprice FROM g LEFT JOIN a USING (o_orderstatus, period)""")
def gapfill_monthly(spark, sf_dir):
    df = s.aggregate(table(spark, sf_dir, "orders"), "o_orderdate", "month", [("sum", "o_totalprice"), ("min", "o_totalprice"), ("max", "o_totalprice")], ["o_orderstatus"])
    return rounded(df, 2).withColumn("period", F.col("period").cast("timestamp_ntz"))


def _daily(spark, sf_dir):
    """Daily sums of value by event type; five short series."""
    return s.aggregate(table(spark, sf_dir, "events"), "ts", "day", [("sum", "value"), ("count", "*")], ["event_type"]).withColumn("period", F.col("period").cast("timestamp_ntz"))


_DAILY = """WITH a AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
e AS (SELECT event_type, min(period) AS lo, max(period) AS hi FROM a GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS period FROM e),
d AS (SELECT g.event_type, g.period, coalesce(v, 0) AS sum_value, coalesce(n, 0) AS count_all FROM g LEFT JOIN a USING (event_type, period))"""


@query(f"{_DAILY} SELECT min(count_all) AS min, max(count_all) AS max, round(avg(count_all), 4) AS mean, CAST(sum(count_all) AS BIGINT) AS sum, count(*) FILTER (WHERE count_all = 0) AS zeros FROM d")
def series_summary(spark, sf_dir):
    return rounded(s.series_summary(_daily(spark, sf_dir), "count_all"))


@query("SELECT ts::TIMESTAMP AS ts, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id DESC) = 1")
def keep_last_daily(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return s.keep_last(df, "day", "event_id", ["user_id"]).select("ts", "event_id", "user_id")


@query("""
WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) / 1000000.0 AS x FROM events), d AS (SELECT event_type, x - lag(x) OVER (PARTITION BY event_type ORDER BY x) AS d FROM t),
m AS (SELECT event_type, count(*) AS n_times, median(d) AS m FROM d GROUP BY 1)
SELECT event_type, n_times, round(m, 4) AS median_step, CASE WHEN n_times < 3 THEN 'unknown' WHEN m <= 1800 THEN 'minute' WHEN m <= 7200 THEN 'hourly' WHEN m <= 172800 THEN 'daily' WHEN m <= 864000 THEN 'weekly' WHEN m <= 3888000 THEN 'monthly' WHEN m <= 10368000 THEN 'quarterly' ELSE 'yearly' END AS frequency FROM m""")
def frequency(spark, sf_dir):
    return rounded(s.frequency(table(spark, sf_dir, "events"), "ts", ["event_type"]))


@query("""
WITH t AS (SELECT DISTINCT o_orderpriority, epoch_us(o_orderdate) / 1000000.0 AS x FROM orders), d AS (SELECT *, x - lag(x) OVER (PARTITION BY o_orderpriority ORDER BY x) AS d FROM t),
m AS (SELECT o_orderpriority, median(d) AS m FROM d GROUP BY 1)
SELECT d.o_orderpriority, count(*) AS n, any_value(m) AS median_step, count(*) FILTER (WHERE d > 2 * m) AS n_gaps, CAST(floor((max(x) - min(x)) / any_value(m)) AS BIGINT) + 1 AS expected,
  round(least(1.0, count(*) / (floor((max(x) - min(x)) / any_value(m)) + 1)), 4) AS completeness FROM d JOIN m USING (o_orderpriority) GROUP BY 1""")
def quality_gaps(spark, sf_dir):
    return rounded(s.gaps(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderpriority"]))


_ROLL = f"""{_DAILY}, r AS (SELECT *, CASE WHEN count(sum_value) OVER f = 5 THEN avg(sum_value) OVER f END AS m FROM d WINDOW f AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
x AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY period ROWS UNBOUNDED PRECEDING), first_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS expected FROM r),
z AS (SELECT *, sum_value - expected AS residual, abs(sum_value - expected) / nullif(stddev_pop(sum_value - expected) OVER (PARTITION BY event_type), 0) AS z FROM x)"""


@query(f"{_ROLL} SELECT event_type, period, round(expected, 4) AS expected FROM x")
def rolling_mean_filled(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("period")
    df = _daily(spark, sf_dir).withColumn("_m", s.rolling_mean("sum_value", 5, w)).withColumn("expected", s.filled(F.col("_m"), w))
    return rounded(df.select("event_type", "period", "expected"))


@query(f"""{_ROLL} SELECT event_type, period, round(sum_value, 4) AS sum_value, count_all, round(expected, 4) AS expected, round(residual, 4) AS residual, round(z, 4) AS z_score,
CASE WHEN z >= 4 THEN 'critical' WHEN z >= 3 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM z WHERE z > 2.0""")
def rolling_zscore(spark, sf_dir):
    return rounded(s.zscores(_daily(spark, sf_dir), "sum_value", "period", ["event_type"], 5, "high"))


@query("""
WITH v AS (SELECT event_id, user_id, ts, abs(value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z FROM events)
SELECT event_id, user_id, CASE WHEN z >= 4 THEN 'critical' WHEN z >= 3 THEN 'high' WHEN z >= 2.5 THEN 'medium' ELSE 'low' END AS severity FROM v
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY CASE WHEN z >= 4 THEN 0 WHEN z >= 3 THEN 1 WHEN z >= 2.5 THEN 2 ELSE 3 END, event_id) = 1""")
def dedupe_deviations(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    df = table(spark, sf_dir, "events").withColumn("z", F.abs(F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))
    df = df.withColumn("severity", s.severity(F.col("z"))).withColumn("start", F.date_trunc("day", "ts"))
    return s.most_severe(df, ["user_id", "start"], "severity", "event_id").select("event_id", "user_id", "severity")


@query("SELECT event_type, count(*) AS n FROM events e JOIN (SELECT event_type AS t, max(ts) AS hi FROM events GROUP BY 1) m ON m.t = e.event_type WHERE ts >= hi - INTERVAL 7 DAY GROUP BY 1")
def lookback_window(spark, sf_dir):
    return s.lookback(table(spark, sf_dir, "events"), "ts", 7, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i > floor(n * 0.8)")
def tail_rows(spark, sf_dir):
    return s.tail_rows(table(spark, sf_dir, "events"), "event_id", ["event_type"]).select("event_id")


_TREND = f"""{_DAILY}, xy AS (SELECT event_type, sum_value AS y, CAST(row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS DOUBLE) AS x FROM d),
t AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, sqrt(greatest(0, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se, avg(y) AS mean FROM xy GROUP BY 1)"""


@query(f"{_TREND} SELECT event_type, n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(se, 4) AS slope_stderr, CASE WHEN abs(slope) < 0.5 * se THEN 'flat' WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM t")
def linear_trend(spark, sf_dir):
    return rounded(s.trend(_daily(spark, sf_dir), "sum_value", "period", ["event_type"]))


@query(f"""{_TREND}, q AS (SELECT event_type, stddev_pop(y - intercept - slope * x) AS sg FROM xy JOIN t USING (event_type) GROUP BY 1),
f AS (SELECT event_type, CAST(step AS INT) AS step, intercept + slope * (n - 1 + step) AS point, sg * sqrt(step) AS w, mean FROM t JOIN q USING (event_type), (SELECT unnest(range(1, 8)) AS step))
SELECT event_type, step, round(point, 3) AS point, round(point - 1.2815515655446004::DOUBLE * w, 3) AS lower_80, round(point + 1.2815515655446004::DOUBLE * w, 3) AS upper_80, round(point - 1.959963984540054::DOUBLE * w, 3) AS lower_95, round(point + 1.959963984540054::DOUBLE * w, 3) AS upper_95,
  2 * 1.2815515655446004::DOUBLE * w <= 0.5 * abs(mean) AS trustworthy FROM f""")
def linear_forecast(spark, sf_dir):
    return rounded(fc.linear_forecast(_daily(spark, sf_dir), "sum_value", "period", ["event_type"], 7), 3)


@query(f"""{_TREND}, r AS (SELECT event_type, x, y - intercept - slope * x AS r, CAST(x AS BIGINT) % 7 AS ph FROM xy JOIN t USING (event_type)), ph AS (SELECT event_type, ph, avg(r) AS s FROM r GROUP BY 1, 2),
q AS (SELECT r.event_type, stddev_pop(r - s) AS sg FROM r JOIN ph ON ph.event_type = r.event_type AND ph.ph = r.ph GROUP BY 1),
f AS (SELECT t.event_type, CAST(step AS INT) AS step, intercept + slope * (n - 1 + step) + s AS point, sg * sqrt(step) AS w, mean FROM t JOIN q USING (event_type), (SELECT unnest(range(1, 15)) AS step) JOIN ph ON ph.event_type = t.event_type AND ph.ph = (n - 1 + step) % 7)
SELECT event_type, step, round(point, 3) AS point, round(point - 1.2815515655446004::DOUBLE * w, 3) AS lower_80, round(point + 1.2815515655446004::DOUBLE * w, 3) AS upper_80, round(point - 1.959963984540054::DOUBLE * w, 3) AS lower_95, round(point + 1.959963984540054::DOUBLE * w, 3) AS upper_95,
  2 * 1.2815515655446004::DOUBLE * w <= 0.5 * abs(mean) AS trustworthy FROM f""")
def seasonal_forecast(spark, sf_dir):
    return rounded(fc.project(_daily(spark, sf_dir), "sum_value", "period", ["event_type"], 14, period=7), 3)


@query(f"""{_DAILY}, xy AS (SELECT event_type, sum_value AS y, CAST(row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS DOUBLE) AS x, count(*) OVER (PARTITION BY event_type) AS n FROM d),
w AS (SELECT event_type, regr_slope(y, x) AS b FROM xy GROUP BY 1), r AS (SELECT event_type, count(*) AS c, regr_slope(y, x) AS b FROM xy WHERE x >= n - greatest(floor(n / 5.0), 10) GROUP BY 1)
SELECT event_type, round(w.b, 4) AS baseline_slope, c AS recent_n, round(r.b, 4) AS recent_slope, abs(r.b - w.b) >= 0.1 * abs(w.b) AS differs FROM w JOIN r USING (event_type)""")
def recent_scenario(spark, sf_dir):
    return rounded(fc.recent_scenario(_daily(spark, sf_dir), "sum_value", "period", ["event_type"]))


@query(f"""{_DAILY}, xy AS (SELECT event_type, sum_value AS y, CAST(row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS DOUBLE) AS x, count(*) OVER (PARTITION BY event_type) AS n FROM d),
t AS (SELECT event_type, count(*) AS m, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM xy WHERE x < n - 6 GROUP BY 1),
sgm AS (SELECT event_type, stddev_pop(y - a - b * x) AS sg FROM xy JOIN t USING (event_type) WHERE x < n - 6 GROUP BY 1),
p AS (SELECT event_type, x - m + 1 AS step, y, a + b * x AS f, sg FROM xy JOIN t USING (event_type) JOIN sgm USING (event_type) WHERE x >= n - 6),
er AS (SELECT *, CASE WHEN y <> 0 THEN abs((y - f) / y) END AS err FROM p)
SELECT event_type, round(avg(err), 4) AS mape, round(avg(CAST(abs(y - f) <= 1.2815515655446004::DOUBLE * sg * sqrt(step) AS INT)), 4) AS coverage_80, round(avg(CAST(abs(y - f) <= 1.959963984540054::DOUBLE * sg * sqrt(step) AS INT)), 4) AS coverage_95,
  CAST(coalesce(min(CASE WHEN err > 0.25 THEN step END) - 1, count(*)) AS BIGINT) AS trustworthy_steps FROM er GROUP BY 1""")
def backtest_mape(spark, sf_dir):
    return rounded(fc.backtest(_daily(spark, sf_dir), "sum_value", "period", ["event_type"], 6))


@query("""
WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, count(*) AS n, avg((value - mu) ^ 2) AS m2, avg((value - mu) ^ 3) AS m3, avg((value - mu) ^ 4) AS m4 FROM m GROUP BY 1)
SELECT event_type, n, round(sqrt(m2), 4) AS std, round(m3 / (m2 * sqrt(m2)), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis FROM c""")
def moments(spark, sf_dir):
    return rounded(s.moments(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("""WITH x AS (SELECT o_orderpriority AS k, ln(o_totalprice) AS v FROM orders UNION ALL SELECT 'squares', (o_totalprice / 1000) ^ 2 FROM orders UNION ALL SELECT 'few', o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5)),
m AS (SELECT k, v, avg(v) OVER (PARTITION BY k) AS mu FROM x), c AS (SELECT k, count(*) AS n, avg((v - mu) ^ 2) AS m2, avg((v - mu) ^ 3) AS m3, avg((v - mu) ^ 4) AS m4 FROM m GROUP BY 1), d AS (SELECT k, n, m3 / (m2 * sqrt(m2)) AS s, m4 / (m2 * m2) - 3 AS q FROM c)
SELECT k, n, CASE WHEN n < 10 THEN 'unknown' WHEN abs(s) < 0.5 AND abs(q) < 1.0 THEN 'normal' WHEN abs(s) >= 0.5 THEN 'skewed' ELSE 'heavy-tailed' END AS distribution FROM d""")
def residual_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    few = o.orderBy("o_orderkey").limit(5)
    x = o.select(F.col("o_orderpriority").alias("k"), F.log("o_totalprice").alias("v")).unionByName(o.select(F.lit("squares").alias("k"), F.pow(F.col("o_totalprice") / 1000, F.lit(2)).alias("v"))).unionByName(few.select(F.lit("few").alias("k"), F.col("o_totalprice").alias("v")))
    return s.residual_profile(x, "v", ["k"]).select("k", "n", "distribution")


@query(f"{_DAILY}, p AS (SELECT event_type, count_all AS a, lag(count_all) OVER (PARTITION BY event_type ORDER BY period) AS b FROM d) SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(corr(a, b), 4) END AS autocorr FROM p GROUP BY 1")
def autocorr(spark, sf_dir):
    return rounded(s.autocorrelation(_daily(spark, sf_dir), "count_all", "period", ["event_type"], 20))


@query("""
WITH b AS (SELECT event_type, count(*) AS n, datediff('day', min(ts), max(ts)) + 1 AS p FROM events GROUP BY 1),
a AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, sum(value) AS v FROM events JOIN b USING (event_type) WHERE n > 2 * p GROUP BY 1, 2),
e AS (SELECT event_type, min(period) AS lo, max(period) AS hi FROM a GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS period FROM e)
SELECT event_type, period, round(coalesce(v, 0), 4) AS sum_value FROM g LEFT JOIN a USING (event_type, period)
UNION ALL SELECT event_type, ts::TIMESTAMP, round(value, 4) FROM events JOIN b USING (event_type) WHERE n <= 2 * p""")
def resample_dense(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return rounded(s.resample(df, "ts", "day", ["value"], ["event_type"])).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("""
WITH x AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, abs(CASE WHEN coalesce(value, 0) = 0 THEN 1.0 ELSE value END) AS m FROM events),
a AS (SELECT event_type, period, sum(m) AS v FROM x GROUP BY 1, 2), e AS (SELECT event_type, min(period) AS lo, max(period) AS hi FROM a GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS period FROM e)
SELECT event_type, period, round(coalesce(v, 0), 4) AS sum_magnitude_abs FROM g LEFT JOIN a USING (event_type, period)""")
def daily_magnitude(spark, sf_dir):
    return rounded(s.daily_magnitude(table(spark, sf_dir, "events"), "ts", "value", ["event_type"])).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("""
WITH m AS (SELECT event_type, (isodow(ts) - 1) AS phase, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, CAST(phase AS INT) AS phase, round(v, 4) AS phase_mean, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, phase) = 1 AS is_peak FROM m""")
def seasonal_profile(spark, sf_dir):
    return rounded(s.seasonal_profile(table(spark, sf_dir, "events"), "ts", "value", ["event_type"]))


@query("""
WITH m AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type FROM events)
SELECT event_type, round(list_sum(list(coalesce(v, 0) ORDER BY i)), 3) AS total, len(list(i)) AS n, round(list(coalesce(v, 0) ORDER BY i)[13], 4) AS at_noon FROM (SELECT k.event_type, i, v FROM k CROSS JOIN (SELECT unnest(range(24)) AS i) r LEFT JOIN m ON m.event_type = k.event_type AND m.h = r.i) GROUP BY 1""")
def seasonal_vector(spark, sf_dir):
    df = s.seasonal_vector(table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "hour")
    return df.select("event_type", fixed(F.aggregate("seasonal", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.size("seasonal").cast("long").alias("n"), fixed(F.get("seasonal", F.lit(12)), 4).alias("at_noon"))


@query(f"""{_ROLL} SELECT event_type, round(greatest(0, 1 - var_samp(residual) / var_samp(sum_value)), 4) AS variance_explained FROM z GROUP BY 1""")
def variance_explained(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("period")
    df = _daily(spark, sf_dir).withColumn("_m", s.rolling_mean("sum_value", 5, w))
    df = df.withColumn("residual", F.col("sum_value") - s.filled(F.col("_m"), w))
    return rounded(s.variance_explained(df, "sum_value", "residual", ["event_type"]))


@query("""
WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 OR event_id < 3 THEN NULL ELSE value END AS v FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM x),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni, first_value(v IGNORE NULLS) OVER a AS nv FROM n
  WINDOW b AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE coalesce(pv, nv) END, 4) AS value_filled FROM k""")
def interpolate(spark, sf_dir):
    hole = (F.col("event_id") % 7 == 0) | (F.col("event_id") < 3)
    df = table(spark, sf_dir, "events").withColumn("value", F.when(~hole, F.col("value")))
    return rounded(s.interpolate(df, "value", "event_id", ["event_type"]).select("event_id", "value_filled"))
