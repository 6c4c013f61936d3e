"""Counts of distinct values, effects of segments and text search, against plain computations; and what their tasks hold."""

import datetime as dt
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from seriesforge.operators import inspect, profile, registry, segments


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def mixed(spark, n=400):
    rng = random.Random(2)
    rows = [(i, f"n{i % 150}", [0.0, -0.0, float("nan"), 1.5, None][i % 5], float(i % 90) - 45, dt.datetime(2024, 10, 27) + dt.timedelta(minutes=i % 200), bool(i % 2), None) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, name string, z double, x double, at timestamp, flag boolean, none string")


@pytest.mark.parametrize("few", [0, 100, 20_000])
def test_distinct_counts_however_they_are_counted(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW_VALUES", few)
    df = mixed(spark)
    want = {c: df.agg(F.count_distinct(c)).first()[0] for c in df.columns}
    got = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert {c: r["n_distinct"] for c, r in got.items()} == want
    assert got["none"]["n_null"] == 400 and got["z"]["n_null"] == 80 and got["id"]["kind"] == "int"
    seen = {r["column"]: r for r in inspect.columns(df).collect()}
    assert {c: r["n_distinct"] for c, r in seen.items()} == want and seen["id"]["max"] == "399" and seen["name"]["min"] == "n0"
    if few == 100:
        assert "count(distinct id" not in plan_of(profile.column_stats(df)) and "count(distinct id" not in plan_of(inspect.columns(df))


def test_first_values_of_each_task(spark):
    rng = random.Random(4)
    values = [f"v{rng.randrange(500)}" for _ in range(3000)] + ["é", "Z", "", None]
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(5)
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    for n in (1, 5, 20):
        assert [r.value for r in profile.samples(df, "c", n).orderBy("value").collect()] == want[:n]
    assert profile.samples(df.where("c is null"), "c", 5).collect() == []


def test_interaction_from_cells(spark):
    rng = random.Random(6)
    rows = [(a, b, 5.0 * (a == "p") + 3.0 * b + (9.0 if a == "p" and b == 2 else 0.0) + rng.random()) for a in "pqr" for b in range(4) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame([*rows, (None, 1, 2.0), ("p", None, 2.0), ("p", 1, None)], "a string, b int, v double")
    mean = lambda keep: st.mean(v for a, b, v in rows if keep(a, b))
    of_a, of_b = {x: mean(lambda a, b, x=x: a == x) for x in "pqr"}, {x: mean(lambda a, b, x=x: b == x) for x in range(4)}
    of_ab = {(x, y): mean(lambda a, b, x=x, y=y: (a, b) == (x, y)) for x in "pqr" for y in range(4)}
    every = mean(lambda a, b: True)
    cross, add = st.variance(v - of_ab[a, b] for a, b, v in rows), st.variance(v - (of_a[a] + of_b[b] - every) for a, b, v in rows)
    out = segments.interaction(df, "a", "b", "v")
    r = out.first()
    assert r.cross_var == pytest.approx(cross, rel=1e-9) and r.additive_var == pytest.approx(add, rel=1e-9) and r.ratio == pytest.approx(cross / add, rel=1e-9) and r.interacts
    assert "Window" not in plan_of(out)
    assert segments.interaction(df.where("a = 'z'"), "a", "b", "v").first().cross_var is None


def test_ranks_are_spread_by_value(spark):
    df = spark.createDataFrame([("ab"[i % 2], float(i % 50)) for i in range(400)], "g string, v double")
    assert plan_of(segments.kruskal(df, "g", ["v"])).count("RepartitionByExpression") >= 2


def test_copies_of_a_text_are_not_embedded_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(c):
        @F.pandas_udf("array<double>")
        def run(texts):
            seen.add(len(texts))
            return texts.map(lambda t: [float(len(t)), 1.0 + t.count("e"), 2.0])

        return run(c)

    rows = [(i, ["red", "green tree", "blue", None][i % 4]) for i in range(200)]
    got = registry.nearest_texts(spark.createDataFrame(rows, "id int, t string"), F.col("t"), "red", 60, "id", embed).collect()
    assert seen.value <= 20
    assert [r.id for r in got[:50]] == list(range(0, 200, 4)) and len(got) == 60 and got[0].similarity == pytest.approx(1.0)
    assert [r.id for r in got[50:]] == list(range(2, 42, 4))
