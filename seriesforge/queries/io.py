"""Queries that write and read back, so that each format keeps every row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import readers, sinks
from . import query, rounded, table


def _folder(spark) -> str:
    """A folder of its own in the one that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_SUM = "SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY 1"


def _back(df):
    return df.groupBy(F.col("n_regionkey").cast("int").alias("n_regionkey")).agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query(_SUM)
def round_trip_csv(spark, sf_dir):
    path = _folder(spark) + "/nation.csv"
    sinks.export(table(spark, sf_dir, "nation"), path, "csv")
    return _back(readers.scan(spark, path))


@query(_SUM)
def round_trip_json(spark, sf_dir):
    path = _folder(spark) + "/nation"
    sinks.export(table(spark, sf_dir, "nation"), path, "json")
    return _back(spark.read.json(path))


@query(_SUM)
def round_trip_parquet(spark, sf_dir):
    path = _folder(spark) + "/nation.parquet"
    sinks.export(table(spark, sf_dir, "nation"), path)
    return _back(readers.scan(spark, path))


@query("SELECT o_orderstatus AS segment_id, count(*) AS n FROM orders GROUP BY 1")
def export_segments(spark, sf_dir):
    path = _folder(spark) + "/segments"
    sinks.export_segments(table(spark, sf_dir, "orders").withColumn("segment_id", F.col("o_orderstatus")), path)
    return readers.scan(spark, path, "parquet").groupBy("segment_id").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_type IS NOT NULL) AS n FROM part GROUP BY 1")
def load_view(spark, sf_dir):
    name = f"part_{uuid.uuid4().hex}"
    readers.load(spark, f"{sf_dir}/part.parquet", name)
    return spark.sql(f"SELECT p_brand, count(*) FILTER (WHERE p_type IS NOT NULL) AS n FROM {name} GROUP BY p_brand")


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS count_all, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def stream_windowed(spark, sf_dir):
    from ..streaming import aggregates as st

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_to_end(st.windowed(stream, "ts", "1 day", [("count", "*"), ("sum", "value")], ["event_type"]), f"w_{uuid.uuid4().hex}", "complete")
    return rounded(out).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("""WITH z AS (SELECT event_type, ts, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_type, ts, round(value, 4) AS value, round((value - m) / s, 4) AS z_score FROM z WHERE n >= 10 AND s > 0 AND abs((value - m) / s) > 1.6""")
def stream_zscores(spark, sf_dir):
    from ..streaming import aggregates as st

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rounded(st.run_to_end(st.running_zscores(stream, "event_type", "ts", "value", 1.6), f"z_{uuid.uuid4().hex}")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT * FROM (VALUES (CAST(3 AS BIGINT), CAST(1 AS BIGINT)), (2, 1)) t(n_columns, n_datasets)")
def scan_folder(spark, sf_dir):
    """Every file of a folder profiled, whatever its format; other files are left out."""
    path = _folder(spark)
    sinks.export(table(spark, sf_dir, "nation").coalesce(1), f"{path}/a")
    sinks.export(table(spark, sf_dir, "region").coalesce(1), f"{path}/b", "csv")
    sinks.export(table(spark, sf_dir, "region").coalesce(1), f"{path}/c", "json")
    found, _ = readers.profile_directory(spark, path)
    return found.groupBy("dataset").agg(F.count("*").alias("n_columns")).groupBy("n_columns").agg(F.count("*").alias("n_datasets"))


@query("SELECT least(count(*), 5000) AS n FROM lineitem")
def sample_rows(spark, sf_dir):
    return readers.sample(table(spark, sf_dir, "lineitem")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT n_regionkey) AS n_regions FROM nation")
def result_documents(spark, sf_dir):
    """A result document with a list, as an analysis writes it, read back a row for each element."""
    path = _folder(spark)
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey")))
    table(spark, sf_dir, "nation").agg(rows.alias("items")).select(F.lit("done").alias("state"), "items").coalesce(1).write.json(path)
    return readers.result_documents(spark, path, "items").agg(F.count("*").alias("n"), F.count_distinct("n_regionkey").alias("n_regions"))


@query("SELECT true AS same, true AS changed")
def change_detection(spark, sf_dir):
    """Equal files have equal hashes, others do not."""
    path = _folder(spark)
    line = lambda text: spark.range(1).select(F.lit(text).alias("value")).coalesce(1)
    for name, text in (("a", "one"), ("b", "one"), ("c", "two")):
        line(text).write.text(f"{path}/{name}")
    md5 = {n: readers.content_hash(spark, f"{path}/{n}/*.txt").select(F.lit(n).alias("n"), "md5") for n in "abc"}
    both = md5["a"].unionByName(md5["b"]).unionByName(md5["c"]).groupBy().pivot("n", list("abc")).agg(F.first("md5"))
    return both.select((F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("changed"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1), e AS (SELECT min(m) AS a, max(m) AS b FROM m), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM e),
f AS (SELECT coalesce(v, 0) AS v FROM g LEFT JOIN m USING (m)) SELECT count(*) AS n, round(min(v), 2) AS min, round(max(v), 2) AS max, count(*) FILTER (WHERE v = 0) AS zeros FROM f""")
def series_with_summary(spark, sf_dir):
    """A monthly series as CSV beside its summary; the query joins what was read back of both."""
    from ..operators import series

    path = _folder(spark)
    monthly = series.aggregate(table(spark, sf_dir, "orders"), "o_orderdate", "month", [("sum", "o_totalprice")])
    sinks.series_files(monthly, series.series_summary(monthly, "sum_o_totalprice"), path)
    n = readers.scan(spark, f"{path}/series.csv").agg(F.count("*").alias("n"))
    return rounded(n.join(F.broadcast(spark.read.json(f"{path}/summary").select("min", "max", "zeros"))), 2)


@query("SELECT DISTINCT event_type AS segment_id, 'value' AS \"column\", true AS adds_up FROM events")
def baseline_round_trip(spark, sf_dir):
    """Baselines and their decompositions written as two tables and read back; the parts add up to the series."""
    from ..operators import series
    from ..operators import signals as sg

    path = _folder(spark)
    daily = series.aggregate(table(spark, sf_dir, "events"), "ts", "day", [("sum", "value")], ["event_type"])
    base = sg.analyse(table(spark, sf_dir, "events"), "event_type", "ts", ["value"]).drop("deviations", "change_points")
    parts = sg.decompose(daily, ["event_type"], "period", "sum_value").withColumn("column", F.lit("value"))
    sinks.baseline_artefacts(base, parts, path)
    back = spark.read.parquet(f"{path}/decompositions").groupBy("event_type", "column").agg(F.max(F.abs(F.col("sum_value") - F.col("trend") - F.col("seasonal") - F.col("residual"))).alias("off"))
    kept = spark.read.parquet(f"{path}/baselines").select("segment_id", "column")
    return kept.join(back.withColumnRenamed("event_type", "segment_id"), ["segment_id", "column"]).select("segment_id", "column", (F.col("off") < 1e-6).alias("adds_up"))


@query("SELECT 'by_type' AS scenario, count(*) AS n_series FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 50)")
def batch_files(spark, sf_dir):
    """A batch run's files: a JSON for each segment, deviations, and the summary, read back."""
    from ..plans import batch

    path = _folder(spark)
    manifest = {"data_path": f"{sf_dir}/events.parquet", "dataset_name": "events", "timestamp_col": "ts", "value_cols": ["value"], "scenarios": [{"name": "by_type", "segment_by": "event_type"}]}
    batch.write(batch.run_all(spark, manifest), path)
    said = spark.read.text(f"{path}/batch_summary.json").select(F.get_json_object("value", "$.scenarios.by_type.n_series").cast("long").alias("n"))
    return spark.read.json(f"{path}/results").groupBy("scenario").agg(F.count("*").alias("n_series")).join(F.broadcast(said)).where("n = n_series").drop("n")


@query("SELECT 0 AS n, 3 AS n_columns")
def clear_derived(spark, sf_dir):
    path = _folder(spark)
    df = table(spark, sf_dir, "nation")
    sinks.export(df, path)
    sinks.clear(df, path)
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("n")).select("n", F.lit(len(back.columns)).alias("n_columns"))


@query("SELECT true AS known, false AS unknown, count(*) AS n FROM part")
def create_table_as(spark, sf_dir):
    name = f"parts_{uuid.uuid4().hex}"
    n = readers.create_as(spark, name, table(spark, sf_dir, "part"))
    return spark.range(1).select(F.lit(readers.table_exists(spark, name)).alias("known"), F.lit(readers.table_exists(spark, f"{name}_not")).alias("unknown"), F.lit(n).cast("long").alias("n"))


@query("SELECT 'except' AS how, c_nationkey AS key FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', c_nationkey FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', c_nationkey FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    parts = {"except": c.subtract(s), "intersect": c.intersect(s), "union": c.union(s).distinct()}
    out = None
    for how, df in parts.items():
        df = df.select(F.lit(how).alias("how"), "key")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT o_orderdate::DATE AS day FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS o_orderdate FROM orders) WHERE o_orderdate::DATE NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority LIKE '1%')")
def missing_days(spark, sf_dir):
    """Days of the whole range on which a segment has no row."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders")
    spine = o.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(o.where("o_orderpriority like '1%'").select(day.alias("day")), "day", "left_anti")


@query("SELECT p_partkey, regexp_extract(p_name, 'ring|bolt|widget') AS found FROM part WHERE regexp_matches(p_name, 'ring|bolt|widget')")
def matched_text(spark, sf_dir):
    from ..operators import extract

    parts = table(spark, sf_dir, "part").select("p_partkey", extract.matched_text(F.upper("p_name"), "ring|bolt|widget").alias("found"))
    return parts.where("found <> ''").withColumn("found", F.lower("found"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""")
def json_and_iso(spark, sf_dir):
    """Paths into JSON text, tolerating what is no JSON, and times in ISO form."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("SELECT 'pos' AS domain, 'US' AS geography, 2 AS n")
def dataset_about(spark, sf_dir):
    path = _folder(spark)
    spark.createDataFrame([("domain: pos",), ("geography: US",)], "value string").coalesce(1).write.text(path)
    found = readers.dataset_descriptor(spark, path)
    return spark.createDataFrame([(found["domain"], found["geography"], len(found))], "domain string, geography string, n int")


@query("""SELECT * FROM (SELECT '| c_acctbal | VALUE | ' || count(DISTINCT c_acctbal) || ' | 0 |  |' AS line FROM customer UNION ALL SELECT '| c_total | VALUE | ' || count(DISTINCT c_acctbal) || ' | 0 | ' || CASE WHEN avg(c_acctbal) > 100 THEN 'cents?' ELSE '' END || ' |' FROM customer)""")
def data_notes(spark, sf_dir):
    from ..operators import profile as p

    df = table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_acctbal").alias("c_total"))
    means = {r["column"]: r["mean"] for r in p.value_stats(df).collect()}
    rows = [{**r.asDict(), "mean": means.get(r["column"])} for r in p.roles(df).orderBy("column").collect()]
    lines = sinks.data_notes(rows, "customer", 0).splitlines()
    return spark.createDataFrame([(x,) for x in lines if x.startswith("| c_")], "line string")


@query("SELECT * FROM (VALUES ('rare', 'high_null_rate'), ('code', 'numeric_as_string'), ('kind', 'case_variants'), ('kind', 'fuzzy_duplicates')) t(\"column\", issue)")
def detect_issues(spark, sf_dir):
    from ..operators import clean

    i = F.col("event_id")
    kind = F.when(i % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    df = table(spark, sf_dir, "events").select(F.when(i % 5 == 0, F.col("value")).alias("rare"), F.concat(F.lit("$"), (i % 97).cast("string")).alias("code"), kind.alias("kind"))
    found = clean.detect(df.withColumn("kind", F.col("kind")))
    return spark.createDataFrame([(x["column"], x["issue"]) for x in found if x["issue"] != "fuzzy_duplicates" or x["column"] == "kind"], "column string, issue string")


@query("SELECT 'orders' AS primary_dataset, 'normalize,plan,profile' AS stages, count(DISTINCT o_orderstatus) AS n_status FROM orders")
def stage_run(spark, sf_dir):
    """The stages over a folder of two files: profile, normalised statuses, plan and manifest."""
    from ..plans import stages

    path = _folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    sinks.export(o.coalesce(1), f"{path}/in/a")
    sinks.export(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment").coalesce(1), f"{path}/in/b")
    found = {readers.PurePosixPath(p).stem: "orders" if "/in/a/" in p else "customers" for p in readers.list_files(spark, f"{path}/in")}
    lake = stages.Lake(spark, f"{path}/in", f"{path}/out", {"names": found, "normalize_columns": ["o_orderstatus"], "times": {"orders": "o_orderdate"}, "values": {"orders": "o_totalprice"}})
    state = stages.run(lake)
    made = state["results"]["plan"]["manifest"]
    n = state["results"]["normalize"]["canonicals"]["o_orderstatus"]
    return spark.createDataFrame([(made["dataset_name"], ",".join(sorted(state["done"])), n)], "primary_dataset string, stages string, n_status long")
