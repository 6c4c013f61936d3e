"""Correlation methods against plain loops over all pairs, and the rows and tasks that their joins make."""

import datetime as dt
import random
from itertools import combinations

import pyarrow as pa
import pytest

from seriesforge.operators import correlate as co

T0 = dt.datetime(2024, 1, 1)
KIND = "signal_id string, source_id string, signal_type string, ts_start timestamp, ts_end timestamp, confidence double, latitude double, longitude double, entity_values map<string,string>"


def signals(spark, rows):
    """(source, start s, end s, confidence, lat, lon, entities) of each signal."""
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame([(f"s{i:05}", r[0], "point_anomaly", at(r[1]), at(r[2]), *r[3:]) for i, r in enumerate(rows)], KIND)


def joined_rows(df):
    """The rows that come out of the largest join of a collected frame."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name or name.startswith("ShuffleQueryStage"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def pairs_of(df, *cols):
    return {tuple(r) for r in df.select("signal_a_id", "signal_b_id", *cols).collect()}


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.67, 0.9, 1.0])
def test_entities_equal_all_pairs(spark, least):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.choice((0, 1, 2, 3, 4, 12))
        rows.append((rng.choice("xyz"), 0, 0, 0.5, None, None, {f"k{j}": rng.choice(("a", "a", "b", None)) for j in range(n)}))
    rows += [("x", 0, 0, 0.5, None, None, None), ("y", 0, 0, 0.5, None, None, {f"k{j}": "a" for j in range(12)})]
    got = pairs_of(co.entity_alignment(signals(spark, rows), least), "strength")
    want = set()
    for i, j in ((i, j) for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] < rows[j][0]):
        a, b = rows[i][6] or {}, rows[j][6] or {}
        m = sum(1 for k, v in a.items() if v is not None and b.get(k) == v)
        if m and round(m / max(len(a), len(b)), 4) >= least:
            want.add((f"s{i:05}", f"s{j:05}", round(m / max(len(a), len(b)), 4)))
    assert got == want


def test_a_frequent_entity_makes_no_pairs_that_fail(spark):
    rows = [("xy"[i % 2], 0, 0, 0.5, None, None, {"bucket": "one", "user": str(i // 2)}) for i in range(2000)]
    df = co.entity_alignment(signals(spark, rows), 0.9)
    assert len(df.collect()) == 1000 and joined_rows(df) <= 2000


def test_signatures_cover_what_must_agree():
    for n in (1, 2, 5, 10, 24):
        for least in (0.3, 0.5, 0.8, 0.9, 1.0):
            must, combos = co._subsets(n, least)
            k = len(combos[0])
            assert len(combos) <= max(co.SIGNATURES, n) and combos == list(combinations(range(n - must + k), k)) and k <= must


@pytest.mark.parametrize("least", [0.0, 0.3, 0.8, 0.9, 1.0])
def test_times_equal_all_pairs(spark, least):
    rng = random.Random(5)
    rows = []
    for i in range(250):
        s = rng.randrange(0, 20_000)
        end = rng.choice((None, s, s + 40, s + rng.randrange(0, 4000), s + 3000, s - rng.randrange(1, 500)))
        rows.append((rng.choice("xyz"), s, end, rng.choice((None, 0.0, -0.5, 0.3, 0.45, 0.5, 0.6, 0.7, 0.9, 1.0)), None, None, None))
    got = pairs_of(co.co_occurrence(signals(spark, rows), 60.0, least), "strength", "confidence")
    want = set()
    for i, j in ((i, j) for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] < rows[j][0]):
        (_, s, e, c, *_), (_, t, f, d, *_) = rows[i], rows[j]
        e, f = s if e is None else e, t if f is None else f
        if max(0, t - e, s - f) > 60:
            continue
        share = max(0, min(e, f) - max(s, t)) / max(e - s, f - t, 1)
        sure = min(1.0, (0.5 + share * 0.5) * min(c or 0.5, d or 0.5) / 0.5)
        if round(sure, 4) >= least:
            want.add((f"s{i:05}", f"s{j:05}", round(share, 4), round(sure, 4)))
    assert {p[:2] for p in got} == {p[:2] for p in want}
    near = {p[:2]: p[2:] for p in want}
    assert all(abs(p[2] - near[p[:2]][0]) < 2e-4 and abs(p[3] - near[p[:2]][1]) < 2e-4 for p in got)


def test_pairs_in_time_are_spread_over_tasks(spark):
    rows = [("xy"[i % 2], i * 60, i * 60 + 600, 0.9, None, None, None) for i in range(400)]
    df = co.co_occurrence(signals(spark, rows), 60.0, 0.3)
    assert df.rdd.getNumPartitions() == 4


def test_places_equal_all_pairs_and_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(co, "PLACE_ROWS", 3)
    rng = random.Random(7)
    spots = [(0.0, 179.9), (0.0, -179.9), (89.9, 10.0), (89.9, -170.0), (0.0, 0.0), (0.3, 0.2), (-60.0, 5.0), (-60.2, 5.1), (None, 1.0)]
    rows = [(rng.choice("xyz"), 0, 0, 0.5, *rng.choice(spots), None) for _ in range(150)]
    df = co.spatial_alignment(signals(spark, rows), 50.0, 0.3)
    from math import asin, cos, radians, sin, sqrt

    def km(a, b, c, d):
        return 2 * 6371 * asin(sqrt(min(1.0, sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2)))

    known = [i for i, r in enumerate(rows) if r[4] is not None]
    want = sorted((f"s{i:05}", f"s{j:05}") for i in known for j in known if rows[i][0] < rows[j][0] and km(*rows[i][4:6], *rows[j][4:6]) <= 50)
    assert sorted((r.signal_a_id, r.signal_b_id) for r in df.collect()) == want
    assert df.rdd.getNumPartitions() == 4
    join = co.spatial_alignment(signals(spark, [("xy"[i % 2], 0, 0, 0.5, 1.0, 2.0, None) for i in range(60)]), 50.0)
    assert len(join.collect()) == 900 and joined_rows(join) < 900


def test_edges_are_thinned_to_a_forest(spark):
    n = 60
    edges = pa.RecordBatch.from_pylist([{"a": f"n{i:02}", "b": f"n{j:02}"} for i, j in combinations(range(n), 2)] + [{"a": "lone", "b": "lone"}] * 3 + [{"a": None, "b": "n00"}])
    kept = [r for b in co._forest(iter([edges, edges])) for r in b.to_pylist()]
    assert len([r for r in kept if r["a"] and r["a"] != r["b"]]) == n - 1 and kept.count({"a": "lone", "b": "lone"}) == 1
    rows = [(f"n{i:02}", f"n{j:02}") for i, j in combinations(range(30), 2)] + [("z1", "z2"), ("q", "q"), ("z2", "z3")]
    got = {r.node: r.component for r in co.components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {**{f"n{i:02}": "n00" for i in range(30)}, "z1": "z1", "z2": "z1", "z3": "z1", "q": "q"}


def test_first_correlations_get_ids_last(spark):
    from oracle import DATA

    from seriesforge.queries import QUERIES

    plan = QUERIES["first_correlations"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("Sort")
