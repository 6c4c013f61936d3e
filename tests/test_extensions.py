"""Windows, batch runs, graphs, plans, models behind callables, spellings and size limits."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import kernels as k
from seriesforge.functions import text as tx
from seriesforge.operators import clean, correlate, graph, normalize, profile, series, signals
from seriesforge.plans import batch, executor, manifest
from seriesforge.sources import readers, sinks


def test_discords_count_from_the_first_point():
    rng = np.random.default_rng(1)
    y = np.sin(np.arange(6000) / 5) + rng.normal(0, 0.02, 6000)
    y[5500:5530] = 0
    assert any(5300 <= at <= 5530 for at, _ in k.discords(y))


def test_a_long_series_keeps_its_resolution():
    y = np.r_[np.zeros(1001), np.ones(1000) * 9] + np.random.default_rng(3).normal(0, 0.3, 2001)
    assert k.pelt(y, np.log(2001) * 1.0, 50, 1) == [1001]


def test_components_of_a_long_chain(spark):
    n = 10_000
    edges = spark.range(n - 1).selectExpr("(id * 7919) % 10007 AS a", "((id + 1) * 7919) % 10007 AS b")
    assert correlate.components(edges).agg(F.count_distinct("component"), F.count("*")).first()[:] == (1, n)


def test_climb_has_no_depth_limit_and_ends_on_circles(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(25)] + [("25", "20")], "child string, parent string")
    got = {r.ancestor: r.depth for r in profile.climb(edges, spark.createDataFrame([("0",)], "node string")).collect()}
    assert got == {str(i): i for i in range(26)}


def test_exact_medians(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=5001), np.r_[rng.integers(0, 5, 3000), [10**6] * 2001]
    rows = [(float(x), int(y), None if i % 3 else float(x), None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b long, c double, d double")
    got = profile.exact_medians(df, ["a", "b", "c", "d"], most=50)
    assert got["a"] == np.median(a) and got["b"] == np.median(b) and got["c"] == np.median(a[::3]) and got["d"] is None
    even = spark.range(1000).selectExpr("cast(id as double) AS v")
    assert profile.exact_medians(even, ["v"], most=10) == {"v": 499.5} and profile.exact_medians(even.limit(0), ["v"]) == {"v": None}


def test_asof_carries_over_stretches_and_hot_keys(spark):
    rng = np.random.default_rng(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(int(n))
    left = [(int(x) if x < 3 else 0, day(n), i) for i, (x, n) in enumerate(zip(rng.integers(0, 9, 400), rng.integers(0, 1500, 400)))] + [(None, day(5), 900), (1, None, 901)]
    right = [(int(x), day(n), int(v)) for x, n, v in zip(rng.integers(0, 3, 12), rng.integers(0, 1500, 12), range(12))]
    a = spark.createDataFrame(left, "k int, __date date, id int")
    b = spark.createDataFrame(right, "k int, t date, v int")
    got = {r.id: r.s_v for r in executor.join_asof(a, b, "k", "s", "t").collect()}
    want = {}
    for key, d, i in left:
        hits = [(t, v) for kk, t, v in right if key is not None and d is not None and kk == key and t <= d]
        want[i] = max(hits)[1] if hits else None
    assert got == want


def test_plans_join_on_the_fewest_values_and_no_measure(spark):
    big = spark.createDataFrame([(i, i % 3, i % 50, float(i), dt.datetime(2024, 1, 1)) for i in range(100)], "id int, few int, many int, price double, t timestamp")
    small = spark.createDataFrame([(float(i), i % 50, i % 3, "x") for i in range(60)], "price double, many int, few int, note string")
    plan = executor.build([executor.Dataset("big", big, "t"), executor.Dataset("small", small)])
    assert plan.primary.name == "big" and plan.supplementary[0].join_key == "few"
    lookup = spark.createDataFrame([("1", "one", "odd")], "raw_value string, product string, kind string")
    executor.attach(plan, {"few": lookup, "price": lookup}, ["product", "kind"], ["few", "many"])
    assert plan.segment_by == ["norm_few_product", "norm_few_kind"] and "segment by norm_few_product" in executor.describe(plan)
    plan.supplementary.clear()
    assert {(r.few, r.norm_few_kind) for r in executor.execute(plan).collect()} == {(0, None), (1, "odd"), (2, None)}


def _manifest(**more):
    return {"data_path": "none", "dataset_name": "shop", "timestamp_col": "t", "value_cols": ["v"], "scenarios": [{"name": "by_kind", "segment_by": "kind", "min_segment_size": 10}], **more}


def test_batch_honours_its_manifest(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(2)
    rows = []
    for kind in ("a", "b"):
        for i in range(140):
            v = 10 + 3 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 0.3) + (40 if i in (20, 130) else 0)
            rows.append((kind, start + dt.timedelta(i), float(v), " x " if i % 2 else "x"))
    df = spark.createDataFrame(rows, "kind string, t timestamp, v double, note string")
    recent = batch.run_all(spark, _manifest(deviations={"lookback_window": "30d"}), df)
    found = {r["at"] for r in signals.deviation_rows(recent.results).where("kind = 'point_anomaly'").collect()}
    assert {130} <= found <= {129, 130, 131} and {i["issue"] for i in recent.issues} >= {"case_variants"} and recent.correlations is None
    whole = batch.run_all(spark, _manifest(deviations={"lookback_window": None}, clean={"auto_detect": False}, freq="daily"), df)
    assert {20, 130} <= {r["at"] for r in signals.deviation_rows(whole.results).collect()} and whole.issues == []
    assert {r.n for r in batch.run(spark, _manifest(freq="weekly"), df).collect()} == {20}
    linked = batch.run_all(spark, _manifest(deviations={"lookback_window": "30d"}, correlate={"least": 0.1}), df)
    kinds = {r.correlation_type for r in linked.correlations.collect()}
    assert {"temporal_co_occurrence", "pattern_similarity"} <= kinds and linked.insights.count() >= 1
    said = batch.write(linked, str(tmp_path / "run"))
    assert said["scenarios"]["by_kind"]["n_series"] == 2 and (tmp_path / "run" / "results" / "scenario=by_kind").is_dir()
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/run/batch_summary.json").collect()))["operations_failed"] == 0
    assert manifest.duration_days("36h") == 1.5


def test_windows_of_a_series():
    days = np.arange(100.0)
    assert signals.window_start(days, 9, None) == 90 and signals.window_start(days, None, 49.0) == 50
    assert signals.window_start(days, None, 500.0) == 80 and signals.window_start(days, None, None) == 0 and signals.window_start(days[:0], 9, None) == 0
    assert series.seasonal_periods("hourly") == (24, 168) and series.seasonal_periods("yearly") == (7,)


def test_graph_files(spark, tmp_path):
    df = spark.createDataFrame([("a<b", "x", 1.0), ("c&d", "x", 2.0), ("e", "y", 3.0), (None, "z", 4.0)], "shop string, town string, v double")
    nodes, edges = graph.build({"sales": df, "towns": df.select("town")}, {"sales": ["shop", "town"], "towns": ["town"]}, {"sales": ["v"]})
    assert graph.join_path(edges, "sales", "towns") == {"join_type": "direct", "columns": ["town"]} and graph.join_path(edges, "sales", "none") is None
    assert {(r.parent, tuple(r.children)) for r in graph.hierarchy(edges, "shop").collect()} == {("town=x", ("shop=a<b", "shop=c&d")), ("town=y", ("shop=e",))}
    graph.save(nodes, edges, str(tmp_path / "g"))
    back = graph.load(spark, str(tmp_path / "g"))
    assert graph.to_json(*back) == graph.to_json(nodes, edges) == graph.to_json(*graph.from_json(spark, graph.to_json(nodes, edges)))
    import xml.etree.ElementTree as et

    root = et.fromstring(graph.to_graphml(nodes, edges))
    space = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(list(root.iter(f"{space}node"))) == nodes.count() and len(list(root.iter(f"{space}edge"))) == edges.count()
    assert graph.bridge({"a": ["b"], "b": ["c", "d"], "d": ["a"]}, "a", "d") == ["a", "b", "d"] and graph.bridge({}, "a", "b") is None


def test_model_answers():
    calls = []

    def ask(text):
        calls.append(text)
        return 'Sure:\n```json\n[{"pattern": "ale", "kind": "beer"}, {"kind": "none"}]\n```'

    rules = normalize.rules_from_model(ask, [f"n{i}" for i in range(250)], ["kind"], known={"kind": ["beer", "wine"]})
    assert rules == {"ale": {"kind": "beer"}} and len(calls) == 2 and "beer, wine" in calls[0] and "n99" in calls[1]
    assert normalize.parse_rows("no list") == [] and normalize.parse_rows("[broken") == [] and normalize.parse_rows("[1, {}]") == [{}]
    op = normalize.mapping_from_model(lambda _: '[{"canonical": "Red", "names": ["red", "RED", "Red", "unknown"]}]', "c", ["red", "RED", "Red"])
    assert op == {"operation": "entity_resolution", "column": "c", "mapping": {"red": "Red", "RED": "Red"}}


def test_sequence_similarity(spark):
    from difflib import SequenceMatcher

    pairs = [("Corona Light", "corona lite"), ("abc", ""), ("", ""), (None, "x"), ("Bud", "Dub")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(tx.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    want = [None if a is None else SequenceMatcher(None, a.lower(), b.lower()).ratio() * 100 for a, b in pairs]
    assert got == want
    rows = normalize.sequence_clusters(spark.createDataFrame([("Red Wine",), ("red wine",), ("RED WINE",), ("Beer",), (None,)], "raw string")).collect()
    assert {(r.raw, r.canonical) for r in rows} == {("Red Wine", "Red Wine"), ("red wine", "Red Wine"), ("RED WINE", "Red Wine"), ("Beer", "Beer")}


def test_fuzzy_duplicates_are_reported(spark):
    df = spark.createDataFrame([("Miller Lite",), ("Miller Lit",), ("Corona",), (None,)], "c string")
    assert clean.fuzzy_duplicates(df, "c") == {"Miller Lit": "Miller Lite"}
    issue = next(i for i in clean.detect(df) if i["issue"] == "fuzzy_duplicates")
    out, _, errors = clean.clean(df, [{"operation": issue["operation"], "column": issue["column"], "mapping": issue["mapping"]}])
    assert {r.c for r in out.collect()} == {"Miller Lite", "Corona", None} and not errors
    many = spark.range(300).selectExpr("concat('name ', id) AS c")
    assert clean.fuzzy_duplicates(many, "c") == {} and clean.narrative([]).startswith("clean")


def test_correlations_in_order(spark):
    rows = [("pattern_similarity", "a", "b"), ("temporal_co_occurrence", "x", "z"), ("temporal_co_occurrence", "x", "y"), ("entity_alignment", "c", "d")]
    df = spark.createDataFrame(rows, "correlation_type string, signal_a_id string, signal_b_id string")
    assert [r.signal_b_id for r in correlate.first_correlations(df, 3).collect()] == ["y", "z", "d"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    sinks.export(df, f"{tmp_path}/d")
    sinks.clear(df, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 0 and spark.read.parquet(f"{tmp_path}/d").columns == ["x", "y"]
    assert readers.create_as(spark, "t_ext", df) == 2 and readers.table_exists(spark, "t_ext") and not readers.table_exists(spark, "t_none")
    (tmp_path / "about.yaml").write_text("domain: pos\ngeography: US\n")
    assert readers.dataset_descriptor(spark, f"{tmp_path}/about.yaml") == {"domain": "pos", "geography": "US"}
    assert "cents?" in sinks.data_notes([{"column": "price", "role": "VALUE", "n_distinct": 3, "n_null": 0, "mean": 250.0}], "d", 3)


def test_shared_folder_needs_a_setting_on_clusters():
    from types import SimpleNamespace

    from seriesforge.session import shared_folder

    conf = SimpleNamespace(get=lambda _: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None, applicationId="a")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=sc))


def test_stages_go_on_where_they_stopped(spark, tmp_path):
    from seriesforge.plans import stages

    rows = [(i, ["Red Ale", "red ale", "Stout"][i % 3], float(i % 17) * 1.25, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(600)]
    spark.createDataFrame(rows, "id int, name string, amount double, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/sales")
    stem = next((tmp_path / "in" / "sales").glob("*.parquet")).stem
    lake = stages.Lake(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"names": {stem: "sales"}, "normalize_columns": ["name"], "values": {"sales": "amount"}})
    assert lake.read_state() == {"done": [], "results": {}}
    stages.profile(lake)
    lake.edit({"results": {"profile": {"note": "seen"}}})
    state = stages.run(lake)
    assert state["done"] == ["profile", "normalize", "plan"] and state["results"]["profile"]["note"] == "seen"
    assert state["results"]["profile"]["times"] == {"sales": ["at"]} and state["results"]["normalize"]["canonicals"] == {"name": 2}
    made = state["results"]["plan"]["manifest"]
    assert made["timestamp_col"] == "at" and made["value_cols"] == ["amount"] and made["normalization"]["enrichment_columns"] == ["name"]
    assert state["results"]["plan"]["segment_estimates"]["name_product"] == 2 and "segment by norm_name_product" in state["results"]["plan"]["plan"]


def test_forecast_dispatch(spark):
    from seriesforge.operators import forecast

    y = [10 + i + (5 if i % 7 == 0 else 0) for i in range(70)]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, i int, v double")
    got = {r.step: r.point for r in forecast.project(df, "v", "i", ["k"], 14, period=7).collect()}
    assert all(abs(got[s] - (10 + 69 + s + (5 if (69 + s) % 7 == 0 else 0))) < 0.5 for s in got)
    line = forecast.project(df, "v", "i", ["k"], 3, "linear", 7).collect()
    assert sorted(map(tuple, line)) == sorted(map(tuple, forecast.linear_forecast(df, "v", "i", ["k"], 3).collect()))
    with pytest.raises(ValueError):
        forecast.project(df, "v", "i", ["k"], 3, "magic")


def test_fuzzy_pairs_lose_none(spark):
    rng = np.random.default_rng(15)
    names = {" ".join("".join(rng.choice(list("abcde"), int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 4)))) for _ in range(150)}
    names |= {"", " ", "a", "A", "aa", "aab", "Bud Light", "bud light", "light bud", "Bud Ligth", "zz"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "raw string")
    for threshold in (60.0, 82.0, 100.0):
        want = {}
        for a in names:
            for b in names:
                if a < b and (s := tx.token_sort_ratio(a.lower(), b.lower())) >= threshold:
                    want[a, b] = pytest.approx(s)
        assert {(r.a, r.b): r.score for r in normalize.fuzzy_pairs(df, threshold).collect()} == want


def test_jobs_are_recorded(spark, tmp_path):
    from seriesforge.plans import jobs

    runs = jobs.Runs(spark, f"{tmp_path}/runs")
    assert runs.table().count() == 0
    done = runs.run("profile", lambda run_id: {"id": run_id})
    with pytest.raises(KeyError):
        runs.run("analysis", lambda _: {}["none"])
    got = {r.kind: r for r in runs.table().collect()}
    assert (got["profile"].run_id, got["profile"].state, json.loads(got["profile"].detail)) == (done, "done", {"id": done})
    assert got["analysis"].state == "failed" and "none" in got["analysis"].detail and got["analysis"].ended >= got["analysis"].started
    runs._add("left", "analysis", "started", {})
    assert {r.run_id: r.ended for r in runs.table().where("state = 'started'").collect()} == {"left": None}


def test_demo_lake_is_made_by_rule(spark, tmp_path):
    from seriesforge.plans import demo

    paths = demo.write(spark, str(tmp_path))
    sales = readers.scan(spark, paths["sales"])
    assert sales.count() == 91 * len(demo.ITEMS) * len(demo.SHOPS) and sorted(map(tuple, sales.collect())) == sorted(map(tuple, readers.scan(spark, demo.write(spark, str(tmp_path / "again"))["sales"]).collect()))
    assert {r.role for r in profile.roles(sales).where("column = 'day'").collect()} == {"TIME"}


def test_clusters_in_rounds_are_those_of_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(16)
    names = {"".join(rng.choice(list("abcd"), int(rng.integers(1, 9)))) + (" " + "".join(rng.choice(list("xyz"), 2)) if i % 3 else "") for i in range(120)}
    names |= {"Corona Light", "corona_lt", "CORONA LIGHT 12pk", "Bud Light", "bud  light", "", " "}
    df = spark.createDataFrame([(n, str(i % 2)) for i, n in enumerate(sorted(names))], "raw string, part string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for threshold in (60.0, 80.0):
        want = rows(normalize.cluster_names(df, threshold)), rows(normalize.cluster_names(df, threshold, "part"))
        with monkeypatch.context() as m:
            m.setattr(normalize, "LEADER_NAMES", 1)
            assert (rows(normalize.cluster_names(df, threshold)), rows(normalize.cluster_names(df, threshold, "part"))) == want
