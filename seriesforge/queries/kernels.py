"""Queries that run series kernels; tests hold them against planted series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import signals as sg
from ..operators.series import aggregate
from . import query, rounded, table


def _daily(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "orders"), "o_orderdate", "day", [("sum", "o_totalprice")], ["o_orderpriority"]).withColumn("period", F.to_date("period"))


@query()
def stl_baseline(spark, sf_dir):
    return rounded(sg.decompose(_daily(spark, sf_dir), ["o_orderpriority"], "period", "sum_o_totalprice"), 2)


def _savgol_sql(window: int = 7) -> str:
    """Each row's weights over its window, for the middle and for both ends, from the normal equations."""
    x = np.vander(np.arange(window, dtype=float), 3, increasing=True)
    hat = x @ np.linalg.solve(x.T @ x, x.T)
    return ", ".join(f"({i}, [{', '.join(repr(float(v)) for v in row)}]::DOUBLE[])" for i, row in enumerate(hat))


_DAILY = """d AS (SELECT o_orderpriority, o_orderdate::DATE AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), e AS (SELECT o_orderpriority, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
f AS (SELECT g.o_orderpriority, g.day, coalesce(v, 0.0) AS v FROM (SELECT o_orderpriority, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e) g LEFT JOIN d ON d.o_orderpriority = g.o_orderpriority AND d.day = g.day),
o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM f)"""


@query(f"""WITH {_DAILY}, h(spot, w) AS (VALUES {_savgol_sql()}), p AS (SELECT *, least(greatest(i - 3, 0), n - 7) AS lo FROM o),
s AS (SELECT p.o_orderpriority, p.day, p.v, sum(w[CAST(q.i - p.lo + 1 AS BIGINT)] * q.v) AS smooth FROM p JOIN h ON h.spot = p.i - p.lo JOIN o q ON q.o_orderpriority = p.o_orderpriority AND q.i BETWEEN p.lo AND p.lo + 6 GROUP BY 1, 2, 3)
SELECT o_orderpriority, day AS period, round(v, 2) AS sum_o_totalprice, round(smooth, 3) AS smooth FROM s""")
def savgol_trend(spark, sf_dir):
    out = sg.smooth(_daily(spark, sf_dir), ["o_orderpriority"], "period", "sum_o_totalprice")
    return out.select("o_orderpriority", "period", fixed("sum_o_totalprice", 2).alias("sum_o_totalprice"), fixed("smooth", 3).alias("smooth"))


@query()
def change_points(spark, sf_dir):
    """Mean prices by day, three times as high from July 1998 on, in standard deviations."""
    day = F.to_date("o_orderdate")
    price = F.col("o_totalprice") * F.when(day >= F.lit("1998-07-01").cast("date"), 3).otherwise(1)
    daily = table(spark, sf_dir, "orders").groupBy("o_orderpriority", day.alias("period")).agg(F.avg(price).alias("v"))
    ends = daily.groupBy("o_orderpriority").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scaled = daily.join(F.broadcast(ends), "o_orderpriority").withColumn("z", F.round((F.col("v") - F.col("m")) / F.col("s"), 6))
    return rounded(sg.change_points(scaled, ["o_orderpriority"], "period", "z"), 4)


@query()
def matrix_profile(spark, sf_dir):
    return rounded(sg.discords(_daily(spark, sf_dir), ["o_orderpriority"], "period", "sum_o_totalprice"), 4)


@query()
def detect_deviations(spark, sf_dir):
    out = sg.analyse(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", ["o_totalprice"], lookback=90.0)
    return sg.deviation_rows(out).withColumn("magnitude", fixed("magnitude", 4)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
