"""Queries that divide rows into segments and judge them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as sg
from . import query, rounded, table


@query("SELECT o_orderpriority AS segment, count(*) AS n, min(o_orderdate)::TIMESTAMP AS first_ts, max(o_orderdate)::TIMESTAMP AS last_ts, round(avg(o_totalprice), 2) AS mean_o_totalprice, round(stddev_samp(o_totalprice), 2) AS std_o_totalprice FROM orders GROUP BY 1")
def segment_preview(spark, sf_dir):
    return rounded(sg.preview(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", ["o_totalprice"]), 2)


@query("""WITH n AS (SELECT count(*) AS n, min(epoch_us(o_orderdate)) / 1e6 AS a, max(epoch_us(o_orderdate)) / 1e6 AS b FROM orders GROUP BY o_orderstatus)
SELECT round(greatest(0, 1 - stddev_samp(n) / avg(n) / 2), 6) AS balance, count(*) AS n_segments, round(avg(b - a) / (max(b) - min(a)), 6) AS coverage, round(avg(CAST(n >= 1000 AS INT)), 6) AS size FROM n""")
def score_balance_coverage_size(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(sg.balance(o, "o_orderstatus").join(sg.coverage(o, "o_orderstatus", "o_orderdate")).join(sg.size_share(o, "o_orderstatus", 1000)), 6)


_KW = """WITH x AS (SELECT event_type AS g, value AS v FROM events), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x),
p AS (SELECT g, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(CAST(c AS DOUBLE) ^ 3 - c) AS ties FROM (SELECT count(*) AS c FROM x GROUP BY v)),
k AS (SELECT sum(s * s / n) AS ss, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM p)"""


@query(f"{_KW} SELECT 'value' AS \"column\", round((12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n ^ 3 - n)), 4) AS h, k FROM k, t")
def kruskal_h(spark, sf_dir):
    return rounded(sg.kruskal(table(spark, sf_dir, "events"), "event_type", ["value"]))


def _score(c: str) -> str:
    """The four parts and the score of one column; the tail of an even number of degrees is a finite sum."""
    return f"""SELECT '{c}' AS "column", n_segments, CASE WHEN exp(-h / 2) * list_sum(list_transform(range(0, CAST((k - 1) // 2 AS BIGINT)), lambda i: pow(h / 2, i) / factorial(CAST(i AS INT)))) < 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS differentiation, balance, coverage, size FROM
 (SELECT round(greatest(0, 1 - stddev_samp(n) / avg(n) / 2), 6) AS balance, count(*) AS n_segments, round(avg(b - a) / (max(b) - min(a)), 6) AS coverage, round(avg(CAST(n >= 50 AS INT)), 6) AS size FROM (SELECT count(*) AS n, min(epoch_us(o_orderdate)) / 1e6 AS a, max(epoch_us(o_orderdate)) / 1e6 AS b FROM orders GROUP BY {c})),
 (SELECT (12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n ^ 3 - n)) AS h, k FROM (SELECT sum(s * s / n) AS ss, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM (SELECT g, sum(r) AS s, count(*) AS n FROM (SELECT {c} AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders) GROUP BY 1)), (SELECT sum(CAST(c AS DOUBLE) ^ 3 - c) AS ties FROM (SELECT count(*) AS c FROM orders GROUP BY o_totalprice)))"""


@query(f"""WITH a AS ({_score("o_orderstatus")} UNION ALL {_score("o_orderpriority")}), b AS (SELECT *, {sg.WEIGHTS["differentiation"]} * differentiation + {sg.WEIGHTS["balance"]} * balance + {sg.WEIGHTS["coverage"]} * coverage + {sg.WEIGHTS["size"]} * size AS score FROM a)
SELECT "column", n_segments, differentiation, round(balance, 4) AS balance, round(coverage, 4) AS coverage, size, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, "column") AS INT) AS rank FROM b""")
def suggest_segments(spark, sf_dir):
    return rounded(sg.rank(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderdate", ["o_totalprice"]), 4)


@query("""WITH m AS (SELECT l_quantity AS x, avg(l_quantity) OVER () AS al, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS a, avg(l_quantity) OVER (PARTITION BY l_linenumber) AS b, avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linenumber) AS ab FROM lineitem)
SELECT round(var_samp(x - ab), 4) AS cross_var, round(var_samp(x - (a + b - al)), 4) AS additive_var, round(var_samp(x - ab) / var_samp(x - (a + b - al)), 4) AS ratio, var_samp(x - ab) / var_samp(x - (a + b - al)) < 0.9 AS interacts FROM m""")
def interaction(spark, sf_dir):
    return rounded(sg.interaction(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity"))


@query("WITH m AS (SELECT user_id AS s, avg(value) AS m FROM events GROUP BY 1) SELECT arg_max(s, struct_pack(m := m, s := s)) AS high, arg_min(s, struct_pack(m := m, s := s)) AS low, round(max(m) / min(m), 4) AS ratio FROM m HAVING max(m) / min(m) > 1.5")
def extreme_segments(spark, sf_dir):
    return rounded(sg.extremes(table(spark, sf_dir, "events"), "user_id", "value"))


@query("""WITH s AS (SELECT o_orderstatus || ' > ' || o_orderpriority AS segment, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 20)
SELECT trim(regexp_replace(lower('seg_orders_' || segment), '[^a-z0-9]+', '_', 'g'), '_') AS segment_id, segment, n FROM s""")
def segments(spark, sf_dir):
    return sg.listing(sg.create(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 20, "orders"))


@query("""WITH d AS (SELECT o_orderstatus AS segment, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2), w AS (SELECT datediff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) + 1 AS c FROM orders),
a AS (SELECT segment, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS days_active, datediff('day', min(day), max(day)) + 1 AS span_days, avg(n) AS avg_daily, median(n) AS median_daily, coalesce(stddev_samp(n), 0) AS std_daily, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.9) AS p90 FROM d GROUP BY 1),
b AS (SELECT a.*, std_daily / avg_daily AS cv, days_active / c * 100 AS day_coverage_pct, (span_days - days_active) / span_days * 100 AS zero_day_pct, span_days / 365.25 AS annual_cycles FROM a, w)
SELECT segment, n_rows, days_active, CAST(span_days AS INT) AS span_days, round(avg_daily, 4) AS avg_daily, median_daily, round(std_daily, 4) AS std_daily, round(p10, 4) AS p10, round(p90, 4) AS p90, round(cv, 4) AS cv, round(day_coverage_pct, 4) AS day_coverage_pct, round(zero_day_pct, 4) AS zero_day_pct, round(annual_cycles, 4) AS annual_cycles,
CASE WHEN avg_daily >= 10 AND day_coverage_pct >= 50 AND annual_cycles >= 2 AND days_active >= 365 THEN 'HIGH' WHEN avg_daily >= 3 AND day_coverage_pct >= 30 AND annual_cycles >= 1 AND days_active >= 180 THEN 'MEDIUM' WHEN avg_daily >= 1 AND day_coverage_pct >= 10 AND annual_cycles >= 0.5 AND days_active >= 90 THEN 'LOW' ELSE 'INSUFFICIENT' END AS tier,
CASE WHEN zero_day_pct > 90 OR (days_active < 180 AND avg_daily < 1.5) THEN 'monthly' WHEN zero_day_pct > 50 OR avg_daily < 3 THEN 'weekly' ELSE 'daily' END AS granularity,
round(greatest(0, 1 - (CASE WHEN cv > 2 THEN 0.25 WHEN cv > 1.5 THEN 0.15 WHEN cv > 1 THEN 0.05 ELSE 0 END + CASE WHEN zero_day_pct > 50 THEN 0.15 WHEN zero_day_pct > 30 THEN 0.05 ELSE 0 END + CASE WHEN days_active < 365 THEN 0.2 WHEN days_active < 730 THEN 0.1 ELSE 0 END)), 4)::DOUBLE AS confidence,
CAST(avg_daily < 5 AS INT) + CAST(zero_day_pct > 50 AS INT) + CAST(cv > 1.5 AS INT) + CAST(annual_cycles < 2 AS INT) + CAST(annual_cycles < 1 AS INT) AS n_warnings FROM b""")
def relevance(spark, sf_dir):
    return rounded(sg.relevance(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate"))
