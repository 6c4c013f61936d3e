"""Interpolation over ranges of the order against a plain loop, and its work on one long key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesforge.operators import series


def plain(rows):
    """Values by position of one key, in order."""
    known = [i for i, v in enumerate(rows) if v is not None]
    out = []
    for i, v in enumerate(rows):
        p, q = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
        if v is not None or p is None or q is None:
            out.append(v if v is not None else rows[p] if p is not None else rows[q] if q is not None else None)
        else:
            out.append(rows[p] + (rows[q] - rows[p]) * (i - p) / (q - p))
    return out


def test_interpolate_across_ranges(spark):
    rng = random.Random(1)
    lists = {k: [None if rng.random() < share else round(rng.random() * 100, 2) for _ in range(n)] for k, n, share in (("a", 300, 0.5), ("b", 200, 0.98), (None, 40, 0.3), ("none", 50, 1.0), ("one", 1, 0.0))}
    lists["gap"] = [None] * 5 + [1.0] + [None] * 600 + [601.0 + 1] + [None] * 5
    rows = [(k, i * 3, v) for k, vs in lists.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = series.interpolate(df, "v", "t", ["k"])
    assert out.columns == ["k", "t", "v", "v_filled"]
    got = {(r.k, r.t): r.v_filled for r in out.collect()}
    want = {(k, i * 3): v for k, vs in lists.items() for i, v in enumerate(plain(vs))}
    assert got.keys() == want.keys() and all((got[x] is None and v is None) or abs(got[x] - v) < 1e-9 for x, v in want.items())


def frames(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_looks_ahead_row_by_row(spark):
    df = spark.range(10).selectExpr("id", "id % 2 AS k", "CAST(id AS double) AS v")
    for out in (series.interpolate(df, "v", "id", ["k"]), df.select(series.filled(F.col("v"), Window.partitionBy("k").orderBy("id")).alias("x"))):
        assert "currentrow$(), unboundedfollowing$()" not in frames(out)
    got = spark.createDataFrame([(1, None), (2, None), (3, 5.0), (4, None)], "id int, v double").select("id", series.filled(F.col("v"), Window.orderBy("id")).alias("x"))
    assert [r.x for r in got.orderBy("id").collect()] == [5.0, 5.0, 5.0, 5.0]
