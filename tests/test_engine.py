"""Operators against literals, planted series and small tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import kernels as k
from seriesforge.functions import stats
from seriesforge.functions import text as tx
from seriesforge.operators import clean, correlate, extract, normalize, profile, registry, segments, series
from seriesforge.plans import executor, manifest
from seriesforge.sources import readers, sinks


@pytest.mark.parametrize(
    "raw, want, pack",
    [("Corona_Lt", "corona light", None), ("Corona Light 12pk", "corona light", "12pk"), ("bud_lt", "bud light", None), ("CORONA LT 12PK", "corona light", "12pk"), ("", "", None), (None, "none", None), ("coca-cola_zero", "coca cola zero", None), ("7up 16.5 oz.", "7up", "16.5 oz")],
)
def test_normalize_literals(spark, raw, want, pack):
    row = spark.createDataFrame([(raw,)], "x string").select(tx.normalize(F.col("x")).alias("n"), tx.pack_info(F.col("x")).alias("p")).first()
    assert (row.n, row.p) == (want, pack)


@pytest.mark.parametrize(
    "names, threshold, clusters, canonical",
    [
        (["Corona Light", "corona light", "CORONA LIGHT"], 80, 1, "Corona Light"),
        (["corona_lt", "Corona Light", "CORONA LT 12PK"], 75, 1, "Corona Light"),
        (["Corona Light", "Bud Light", "Miller Lite"], 80, 3, None),
        (["Corona Light 12pk", "Corona Light", "corona_lt"], 75, 1, "Corona Light"),
        (["corona_lt", "Corona Light", "Corona Light 12pk", "bud_lt", "Bud Light", "BUD LIGHT 24PK"], 80, 2, None),
    ],
)
def test_clusters(spark, names, threshold, clusters, canonical):
    rows = normalize.cluster_names(spark.createDataFrame([(n,) for n in names], "raw string"), threshold).collect()
    assert len({r.cluster for r in rows}) == clusters and len(rows) == len(names)
    assert canonical is None or {r.canonical for r in rows} == {canonical}


def test_enrichment_keeps_rows(spark):
    df = spark.createDataFrame([("corona_lt", 1), ("Corona Light", 2), ("Bud Light", 3), (None, 4), ("else", 5)], "name string, n int")
    rules = {"corona": {"brand": "Corona"}, "bud": {"brand": "Budweiser"}, "default": {"brand": "Unknown"}}
    lookup = normalize.build_lookup(normalize.cluster_names(df.where("n < 4").select(F.col("name").alias("raw")), 75), rules, ["brand"])
    got = {r.n: r.norm_name_brand for r in normalize.lookup_enrich(df, lookup, "name", ["brand"]).collect()}
    assert got == {1: "Corona", 2: "Corona", 3: "Budweiser", 4: None, 5: None}


def test_fuzzy_pairs_lose_none(spark):
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("abc "), rng.integers(2, 9))).strip() or "a" for _ in range(60)})
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if tx.token_sort_ratio(a, b) >= 82}
    got = normalize.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "raw string"), 82.0).collect()
    assert {(r.a, r.b) for r in got} == want


def test_tail_probabilities():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)


def test_decomposition_finds_season_and_slope():
    x = np.arange(210)
    y = 0.5 * x + 10 * np.sin(2 * math.pi * x / 7) + np.random.default_rng(0).normal(0, 0.5, 210)
    trend, seasons, rest = k.mstl(y, [7, 365])
    assert list(seasons) == [7] and np.allclose(trend + seasons[7] + rest, y)
    assert np.polyfit(x, trend, 1)[0] == pytest.approx(0.5, abs=0.02) and rest.std() < 1.0


def test_confidence_of_a_large_cluster_is_of_all_pairs(spark):
    names = ["abcdefghijklmnop", "ABCDEFGHIJKLMNOP"] + [f"abcdefghijklmnop {a}{b}" for a in "qrstuvwxyzacegi" for b in "qrstuvwxyzacegi"]
    rows = normalize.cluster_names(spark.createDataFrame([(n,) for n in names], "raw string"), 80).collect()
    texts = sorted({r.normalized for r in rows})
    pairs = [tx.token_sort_ratio(a, b) for i, a in enumerate(texts) for b in texts[:i]]
    assert len(texts) > 200 and {r.cluster for r in rows} == {0}
    assert {r.confidence for r in rows} == {round(sum(pairs) / len(pairs) / 100, 3)}


def test_change_point_and_discord():
    rng = np.random.default_rng(1)
    y = np.r_[rng.normal(0, 1, 60), rng.normal(8, 1, 60)]
    assert any(abs(p - 60) <= 2 for p in k.pelt(y, np.log(120) * 1.0, 6, 1))
    z = np.sin(np.arange(400) / 5) + rng.normal(0, 0.02, 400)
    z[200:215] = 0
    assert any(180 <= at <= 216 for at, _ in k.discords(z))


def test_change_points_of_a_long_series_are_the_direct_search():
    rng = np.random.default_rng(7)
    n, size = 2403, 240
    y = np.r_[rng.normal(0, 1, 801), rng.normal(3, 1, 1002), rng.normal(-1, 1, 600)]
    penalty = math.log(n) * float(y.var())
    d = (y[:, None] - y[None, :]) ** 2
    s = np.zeros((n + 1, n + 1))
    s[1:, 1:] = np.exp(-d / np.median(d[np.triu_indices(n, 1)])).cumsum(0).cumsum(1)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for b in range(size, n + 1):
        a = np.arange(0, b - size + 1)
        total = best[a] + (b - a) - (s[b, b] - 2 * s[a, b] + s[a, a]) / (b - a) + penalty
        best[b], last[b] = total.min(), total.argmin()
    want, at = [], n
    while last[at] > 0:
        at = int(last[at])
        want.append(at)
    assert len(want) == 2 and k.pelt(y, penalty, size, 1) == want[::-1]


def test_discords_of_a_long_series_keep_their_place():
    y = np.sin(np.arange(900) / 5) + np.random.default_rng(1).normal(0, 0.02, 900)
    y[700:715] = 0
    assert any(680 <= at <= 716 for at, _ in k.discords(y, 400))
    assert k.discords(y, 400) == [(500 + at, s) for at, s in k.discords(y[500:], 400)]


def test_matrix_profile_brute():
    y = np.random.default_rng(2).normal(size=60)
    m, n = 6, 55
    std = np.array([(y[i : i + m] - y[i : i + m].mean()) / y[i : i + m].std() for i in range(n)])
    want = [min(np.linalg.norm(std[i] - std[j]) for j in range(n) if abs(i - j) > 1) for i in range(n)]
    assert np.allclose(k.matrix_profile(y, m), want, atol=1e-6)


def test_smoothing_keeps_parabola_and_adf():
    x = np.arange(30.0)
    assert np.allclose(k.savgol(x**2 - 3 * x, 7), x**2 - 3 * x)
    rng = np.random.default_rng(5)
    assert k.adf(rng.normal(size=300))[1] and not k.adf(np.cumsum(rng.normal(size=300)))[1]


def test_asof_ties_and_nulls(spark):
    d = dt.date
    left = spark.createDataFrame([(1, d(2024, 1, 5)), (1, d(2023, 1, 1)), (None, d(2024, 1, 5)), (2, None), (1, d(2024, 1, 9))], "k int, __date date")
    right = spark.createDataFrame([(1, dt.datetime(2024, 1, 5, 9), "a"), (1, dt.datetime(2024, 1, 5, 11), "b"), (None, dt.datetime(2024, 1, 1), "n"), (2, dt.datetime(2024, 1, 1), "c")], "k int, t timestamp, v string")
    got = {(r.k, r["__date"]): r.s_v for r in executor.join_asof(left, right, "k", "s", "t").collect()}
    assert got == {(1, d(2024, 1, 5)): "b", (1, d(2023, 1, 1)): None, (None, d(2024, 1, 5)): None, (2, None): None, (1, d(2024, 1, 9)): "b"}


def test_chained_mapping():
    assert clean.chained({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}


def test_clean_reports_errors(spark):
    df = spark.createDataFrame([(" x ", "$1,200.50"), (None, "12%")], "a string, b string")
    out, applied, errors = clean.clean(df, [{"operation": "normalize_text", "column": "a"}, {"operation": "coerce_numeric", "column": "b"}, {"operation": "nothing", "column": "a"}])
    assert [tuple(r) for r in out.collect()] == [("x", 1200.5), (None, 12.0)] and len(applied) == 2 and len(errors) == 1


def test_detect(spark):
    df = spark.createDataFrame([("Red", "1"), ("red ", "2"), ("RED", None), ("Red", None), ("blue", None)], "c string, n string")
    kinds = {(i["column"], i["issue"]) for i in clean.detect(df)}
    assert {("n", "high_null_rate"), ("n", "numeric_as_string"), ("c", "case_variants")} <= kinds


def test_roles(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", ["a", "b"][i % 2], float(i) * 1.5, 20240101 + i % 20) for i in range(100)]
    got = {r.column: r.role for r in profile.roles(spark.createDataFrame(rows, "id long, day string, kind string, v double, ymd int")).collect()}
    assert got == {"id": "IDENTIFIER", "day": "TIME", "kind": "DISCRIMINATOR", "v": "VALUE", "ymd": "TIME"}


def test_chains():
    assert profile.chains([("store", "city"), ("city", "region"), ("store", "region")]) == [["store", "city", "region"]]


def test_segment_ids_do_not_collide(spark):
    df = spark.createDataFrame([("A b",)] * 3 + [("a-B",)] * 3 + [("nan",)] * 5 + [("small",)], "c string")
    got = segments.listing(segments.create(df, ["c"], 2)).collect()
    assert len({r.segment_id for r in got}) == 2 and {r.segment for r in got} == {"A b", "a-B"}


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r.node: r.component for r in correlate.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_spatial_at_dateline_and_poles(spark):
    pts = [("a", "s1", 0.0, 179.99), ("b", "s2", 0.0, -179.99), ("c", "s1", 89.99, 10.0), ("d", "s2", 89.99, -170.0), ("e", "s2", 45.0, 0.0), ("f", "s1", 0.0, 0.0), ("g", "s2", 0.3, 0.3)]
    df = spark.createDataFrame([(i, s, "point_anomaly", la, lo) for i, s, la, lo in pts], "signal_id string, source_id string, signal_type string, latitude double, longitude double")
    assert {(r.signal_a_id, r.signal_b_id) for r in correlate.spatial_alignment(df, 50.0, 0.0).collect()} == {("a", "b"), ("c", "d"), ("f", "g")}


def test_manifest():
    m = manifest.check({"data_path": "x", "dataset_name": "d", "timestamp_col": "t", "scenarios": [{"segment_by": "c"}], "clean": {"auto_detect": False}})
    assert m["clean"] == {"auto_detect": False, "apply_operations": []} and m["scenarios"][0]["segment_by"] == ["c"] and manifest.duration_days("12w") == 84
    with pytest.raises(ValueError):
        manifest.check({"data_path": "x", "dataset_name": "d", "timestamp_col": "t"})


def test_rules_from_json_and_directory(spark, tmp_path):
    rules = extract.from_json('{"name": "n", "include": ["ale"], "outputs": {"kind": [["ipa", "IPA"], ["ale", "Ale"]]}, "otherwise": {"kind": "other"}, "exclude": ["ginger"]}')
    df = spark.createDataFrame([("$5.00 Pale ALE",), ("IPA ale",), ("Ginger ale",), (None,)], "x string")
    assert sorted(r.kind for r in extract.extract(df, "x", rules).collect()) == ["Ale", "IPA"]
    sinks.export(df, f"{tmp_path}/d/a.parquet")
    (tmp_path / "d" / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d" / "c.json").write_text("{}")
    frames, errors = readers.scan_directory(spark, str(tmp_path / "d"))
    assert "b" in frames and not any("c.json" in p for p in errors)


def test_embeddings(spark):
    devs = spark.createDataFrame([("s", dt.datetime(2024, 1, 1), "high", "point_anomaly", 3.0), ("s", dt.datetime(2024, 1, 9), "critical", "trend_shift", -5.0)], "k string, start timestamp, severity string, kind string, z_score double")
    v = registry.deviation_embedding(devs, "k").first().embedding
    assert len(v) == 47 and v[:4] == [0.0, 0.0, 0.5, 0.5] and v[23] == 0.4 and v[27:30] == [0.5, 0.0, 0.5]


def test_gap_fill_empty_and_single(spark):
    df = spark.createDataFrame([], "t timestamp, v double")
    assert series.aggregate(df, "t", "day", [("sum", "v")]).count() == 0
