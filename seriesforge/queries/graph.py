"""Queries over the graph of the lake: orders, customers and suppliers by nation, nations by region."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import narratives as nr
from ..operators import normalize, registry
from ..operators import segments as sg
from ..operators import signals as si
from ..session import shared_folder
from . import query, rounded, table


def _lake(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    customers = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("_k")).select("nation", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("_k")).select("nation", "s_acctbal")
    offices = region.select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("double").alias("staff"))
    frames = {"customers": customers, "suppliers": suppliers, "places": place.drop("_k"), "offices": offices, "parts": table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_retailprice")}
    discs = {"customers": ["nation", "segment"], "suppliers": ["nation"], "places": ["nation", "region"], "offices": ["region"], "parts": ["brand"]}
    return gr.build(frames, discs, {"customers": ["c_acctbal"], "suppliers": ["s_acctbal"], "offices": ["staff"], "parts": ["p_retailprice"]})


_PLACE = """c AS (SELECT DISTINCT n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT DISTINCT n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey), v AS (SELECT 'nation' AS d, nation AS x FROM p UNION SELECT 'nation', nation FROM c UNION SELECT 'region', r_name FROM region UNION SELECT 'segment', segment FROM c UNION SELECT 'brand', p_brand FROM part)"""


@query(f"""WITH {_PLACE} SELECT 'DATASET' AS kind, 5 AS n UNION ALL SELECT 'DISCRIMINATOR', 4 UNION ALL SELECT 'VALUE_COLUMN', 4 UNION ALL SELECT 'VALUE', count(*) FROM v UNION ALL SELECT 'DISCRIMINATOR_HAS_VALUE', count(*) FROM v
UNION ALL SELECT 'DATASET_HAS_DISCRIMINATOR', 7 UNION ALL SELECT 'DATASET_HAS_VALUE_COL', 4 UNION ALL SELECT 'CHILD_OF', count(*) FROM p""")
def graph_summary(spark, sf_dir):
    return gr.summary(*_lake(spark, sf_dir))


@query("SELECT * FROM (VALUES ('customers', 'suppliers', 'direct', 'nation'), ('customers', 'offices', 'hierarchical', 'nation > region'), ('suppliers', 'offices', 'hierarchical', 'nation > region'), ('places', 'offices', 'direct', 'region'), ('customers', 'parts', NULL, NULL)) t(a, b, join_type, columns)")
def join_paths(spark, sf_dir):
    edges = _lake(spark, sf_dir)[1]
    steps = gr.column_steps(edges)
    rows = []
    for a, b in (("customers", "suppliers"), ("customers", "offices"), ("suppliers", "offices"), ("places", "offices"), ("customers", "parts")):
        found = gr.join_path(edges, a, b, steps) or {"join_type": None, "columns": None}
        rows.append((a, b, found["join_type"], found["columns"] and " > ".join(found["columns"])))
    return spark.createDataFrame(rows, "a string, b string, join_type string, columns string")


@query("SELECT * FROM (VALUES ('suppliers', 'nation'), ('places', 'nation')) t(dataset, discriminator)")
def related_datasets(spark, sf_dir):
    return gr.related(_lake(spark, sf_dir)[1], "customers")


@query(f"WITH {_PLACE} SELECT 'region=' || region AS parent, list_sort(list('nation=' || nation)) AS children FROM p GROUP BY region")
def value_hierarchy(spark, sf_dir):
    return gr.hierarchy(_lake(spark, sf_dir)[1], "nation")


@query(f"WITH {_PLACE} SELECT 'region=' || region AS parent, count(*) AS n FROM p GROUP BY region")
def graph_round_trip(spark, sf_dir):
    """The graph written as tables and as JSON and read back; both must hold the same hierarchy."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    gr.save(*_lake(spark, sf_dir), path)
    nodes, edges = gr.load(spark, path)
    again = gr.from_json(spark, gr.to_json(nodes, edges))[1]
    both = gr.hierarchy(edges, "nation").join(gr.hierarchy(again, "nation"), ["parent", "children"])
    return both.select("parent", F.size("children").cast("long").alias("n"))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name", "p_type").distinct()


@query("""WITH c AS (SELECT DISTINCT p_type FROM part) SELECT 'raw' AS level, count(*) AS n FROM c UNION ALL SELECT 'canonical', count(DISTINCT upper(p_type)) FROM c UNION ALL SELECT 'kind', count(DISTINCT split_part(p_type, ' ', 1)) FROM c
UNION ALL SELECT 'links', count(*) + count(DISTINCT upper(p_type)) FROM c""")
def normalization_graph(spark, sf_dir):
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    lookup = types.select(F.col("p_type").alias("raw_value"), F.upper("p_type").alias("canonical"), F.split("p_type", " ")[0].alias("kind"))
    nodes, edges = normalize.normalization_graph(lookup, ["product", "kind"], "p_type")
    level = F.when(F.col("name").endswith("raw_value"), "raw").when(F.col("name").endswith("canonical"), "canonical").otherwise("kind")
    return nodes.groupBy(level.alias("level")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("links").alias("level"), "n"))


_REG = """SELECT event_type AS segment, count(*) AS n, avg(value) / 100 AS strength, count(*) FILTER (WHERE value >= 99.5) AS devs FROM events GROUP BY 1"""


@query(f"""WITH r AS ({_REG}) SELECT segment, 'Signal of ' || segment || ' in events. The trend is flat. ' || CASE WHEN strength > 0.7 THEN 'Strong' WHEN strength > 0.3 THEN 'Moderate' WHEN strength > 0.05 THEN 'Weak' ELSE 'No' END || ' seasonality. '
|| CASE WHEN devs = 0 THEN 'No deviations in 90 days.' WHEN devs <= 3 THEN devs || ' deviations in 90 days.' ELSE 'Many deviations: ' || devs || ' in 90 days.' END AS description FROM r""")
def signal_descriptions(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("segment")).agg((F.avg(v) / 100).alias("seasonality_strength"), F.count_if(v >= 99.5).alias("deviation_count_90d"))
    out = registry.describe(rows.withColumns({"dataset_name": F.lit("events"), "trend_slope": F.lit(0.0)}))
    return out.select("segment", F.regexp_replace("description", " \\([0-9.]+\\)", "").alias("description"))


@query("""WITH d AS (SELECT CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' ELSE 'low' END AS severity, CASE event_id % 3 WHEN 0 THEN 'trend_shift' WHEN 1 THEN 'regime_change' ELSE 'point_anomaly' END AS kind, event_type AS c FROM events)
SELECT count(*) || ' deviations. ' || count(*) FILTER (WHERE severity = 'critical') || ' critical. In ' || array_to_string(list_sort(list(DISTINCT c))[1:3], ', ') || '. ' || count(*) FILTER (WHERE kind = 'trend_shift') || ' trend shifts. ' || count(*) FILTER (WHERE kind = 'regime_change') || ' unusual patterns.' AS narrative FROM d""")
def deviation_narrative(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id") % 3
    sev = F.when(v >= 90, "critical").when(v >= 70, "high").otherwise("low")
    return nr.deviations(table(spark, sf_dir, "events").select(sev.alias("severity"), F.when(i == 0, "trend_shift").when(i == 1, "regime_change").otherwise("point_anomaly").alias("kind"), F.col("event_type").alias("column")))


@query("""SELECT event_type, 'Forecast of ' || event_type || ': ' || strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') || ' (' || count(*) || ' periods). Reliable for 14 periods. A second scenario follows the recent deviation.' AS narrative FROM events GROUP BY 1""")
def forecast_narrative(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    text = nr.forecast(F.col("event_type"), F.col("a"), F.col("b"), F.col("n"), F.col("lo"), F.col("hi"), F.lit(None).cast("double"), F.lit(14), F.lit(2))
    return e.select("event_type", F.regexp_replace(text, "periods\\), from [0-9.-]+ to [0-9.-]+\\.", "periods).").alias("narrative"))


@query("""WITH s AS (SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders)
SELECT c AS "column", 'By ' || c || ': ' || n || ' groups ' AS start FROM s""")
def segment_narratives(spark, sf_dir):
    ranked = sg.rank(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderdate", ["o_totalprice"])
    return ranked.select("column", F.regexp_extract(nr.segmentation(), "^(By .*: \\d+ groups )with ", 1).alias("start"))


@query("SELECT * FROM (VALUES ('minute', [24, 168]), ('hourly', [24, 168]), ('daily', [7, 365]), ('weekly', [52]), ('monthly', [12]), ('quarterly', [4]), ('yearly', [7])) t(frequency, periods)")
def seasonal_periods(spark, sf_dir):
    from ..operators import series

    names = [(n,) for n in (*series.SEASONAL_PERIODS, "yearly")]
    return spark.createDataFrame(names, "frequency string").withColumn("periods", series.periods_of(F.col("frequency")))


@query("""WITH l AS (SELECT o_orderpriority, max(o_orderdate) AS z FROM orders GROUP BY 1), a AS (SELECT o.o_orderpriority, count(*) AS n FROM orders o JOIN l USING (o_orderpriority) WHERE o_orderdate >= z - INTERVAL 90 DAY GROUP BY 1),
b AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01' GROUP BY 1), t AS (SELECT o_orderpriority, CAST(count(*) - floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT) AS n FROM orders GROUP BY 1)
SELECT 'lookback' AS how, * FROM a UNION ALL SELECT 'after', * FROM b UNION ALL SELECT 'tail', * FROM t""")
def analysis_windows(spark, sf_dir):
    """The three ways to choose what to look at: a lookback, what is after the baseline, or else the last fifth."""
    import datetime

    from ..operators import series

    o = table(spark, sf_dir, "orders")
    ways = {"lookback": {"days": 90}, "after": {"baseline_end": datetime.datetime(2000, 6, 1)}, "tail": {"baseline_end": datetime.datetime(2100, 1, 1)}}
    parts = [series.window_rows(o, "o_orderdate", ["o_orderpriority"], **args).groupBy("o_orderpriority").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "o_orderpriority", "n") for how, args in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def trend_fallback(spark, sf_dir):
    """Series too short for any season keep a smoothed trend and no season."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.date_trunc("year", "o_orderdate").cast("date").alias("period")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(si.decompose(o, ["o_orderpriority"], "period", "v", (7,)), 2)


@query("SELECT * FROM (VALUES ('sales', 'item', 'brand'), ('sales', 'item', 'kind'), ('sales', 'brand', 'kind'), ('sales', 'shop', 'region'), ('items', 'item', 'brand'), ('items', 'item', 'kind'), ('items', 'brand', 'kind'), ('shops', 'shop', 'region')) t(dataset, child, parent)")
def demo_hierarchies(spark, sf_dir):
    """The hierarchies of the demo lake, found in the files it is written to."""
    from ..operators import profile as p
    from ..plans import demo
    from ..sources import readers

    paths = demo.write(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    cols = {"sales": ["item", "brand", "kind", "shop", "region"], "items": ["item", "brand", "kind"], "shops": ["shop", "region"]}
    parts = [p.dependencies(readers.scan(spark, paths[n]), c).select(F.lit(n).alias("dataset"), "child", "parent") for n, c in cols.items()]
    return p.union_all(parts)


@query("""WITH s AS (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 50), r AS (SELECT unnest(['active', 'superseded']) AS status) SELECT status, count(*) AS n, count(DISTINCT event_type) AS n_segments, status = 'superseded' AS replaced FROM s, r GROUP BY 1""")
def analysis_job(spark, sf_dir):
    """Two runs over one dataset: the second supersedes the first; a run that failed registers nothing."""
    from ..plans import jobs

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    runs = jobs.Runs(spark, f"{path}/runs")
    manifest = {"data_path": f"{sf_dir}/events.parquet", "dataset_name": "events", "timestamp_col": "ts", "value_cols": ["value"], "freq": "daily", "clean": {"auto_detect": False}, "scenarios": [{"name": "by_type", "segment_by": "event_type"}]}
    for _ in range(2):
        jobs.analysis_job(spark, runs, manifest, f"{path}/store")
    found = jobs.store_signals(spark, runs, f"{path}/store")
    return found.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("segment").alias("n_segments"), F.min(F.col("superseded_by").isNotNull()).alias("replaced"))


@query("SELECT * FROM (VALUES ('profile', 'done', true), ('analysis', 'failed', true)) t(kind, state, ended)")
def job_runs(spark, sf_dir):
    """The record of a profile job over the demo lake and of an analysis job that fails."""
    from ..plans import demo, jobs, stages

    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    demo.write(spark, f"{path}/lake")
    runs = jobs.Runs(spark, f"{path}/runs")
    jobs.profile_job(runs, stages.Lake(spark, f"{path}/lake", f"{path}/out", {"normalize_columns": ["brand"]}))
    try:
        jobs.analysis_job(spark, runs, {"data_path": f"{path}/nothing.parquet", "dataset_name": "x", "timestamp_col": "t", "scenarios": [{"segment_by": "c"}]}, f"{path}/store")
    except Exception:  # the record says what went wrong
        pass
    return runs.table().select("kind", "state", F.col("ended").isNotNull().alias("ended"))
