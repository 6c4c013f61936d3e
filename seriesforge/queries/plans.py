"""Queries that run join plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..plans import batch
from ..plans import executor as x
from . import query, rounded, table


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS kind FROM events) WHERE kind = 'click' OR kind IS NULL")
def plan_filter_null(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return x.keep_value(df, "kind", "click").select("event_id")


def _weekly(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key", F.col("o_custkey") % 25)
    return o.groupBy("key", F.date_trunc("week", "o_orderdate").alias("week")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))


_WEEKLY = "w AS (SELECT o_custkey % 25 AS key, date_trunc('week', o_orderdate)::DATE AS week, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_suppkey % 25 AS key, l_shipdate::DATE AS d FROM lineitem)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).alias("key"), "l_shipdate")


@query(f"WITH {_WEEKLY} SELECT l_orderkey, l_linenumber, round(w.total, 2) AS weekly_total, w.n AS weekly_n FROM l ASOF LEFT JOIN w ON l.key = w.key AND l.d >= w.week")
def join_asof(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("__date", F.to_date("l_shipdate"))
    return rounded(x.join_asof(lines, _weekly(spark, sf_dir), "key", "weekly", "week").select("l_orderkey", "l_linenumber", "weekly_total", "weekly_n"), 2)


@query(f"WITH {_WEEKLY} SELECT l_orderkey, l_linenumber, round(w.total, 2) AS weekly_total FROM l LEFT JOIN w ON l.key = w.key AND l.d = w.week")
def join_same_grain(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("__date", F.to_date("l_shipdate"))
    return rounded(x.join_same_grain(lines, _weekly(spark, sf_dir), "key", "weekly", "week").select("l_orderkey", "l_linenumber", "weekly_total"), 2)


@query("SELECT c_custkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_key_only(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return x.join_key_only(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "nation").drop("c_nationkey")


@query(f"WITH {_WEEKLY} SELECT l.l_orderkey, l.l_linenumber, round(w.total, 2) AS weekly_total, s.s_name AS supplier_s_name FROM l ASOF LEFT JOIN w ON l.key = w.key AND l.d >= w.week LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey")
def join_chain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") % 25).alias("key"), "l_shipdate")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    plan = x.Plan(
        x.Dataset("lines", lines, "l_shipdate", "daily"),
        [x.Dataset("weekly", _weekly(spark, sf_dir), "week", "weekly", join_key="key"), x.Dataset("supplier", supp, join_key="l_suppkey"), x.Dataset("unjoined", supp)],
    )
    return rounded(x.execute(plan).select("l_orderkey", "l_linenumber", "weekly_total", "supplier_s_name"), 2)


@query("SELECT o_orderkey, c_mktsegment AS customers_c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def plan_by_value(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    plan = x.build([x.Dataset("orders", o, "o_orderdate"), x.Dataset("customers", c)], ("o_orderstatus", "F"))
    return x.execute(plan).select("o_orderkey", "customers_c_mktsegment")


@query()
def batch_run(spark, sf_dir):
    manifest = {"data_path": f"{sf_dir}/events.parquet", "dataset_name": "events", "timestamp_col": "ts", "value_cols": ["value"], "scenarios": [{"name": "by_type", "segment_by": "event_type"}]}
    out = batch.run(spark, manifest)
    return out.select("scenario", "segment_id", "column", "n", fixed("variance_explained", 4).alias("variance_explained"), "direction", "n_deviations", "error")


_BATCH = """WITH d AS (SELECT event_type, ts::DATE AS day FROM events), s AS (SELECT event_type, count(*) AS n, min(day) AS a, max(day) AS z FROM d GROUP BY 1 HAVING count(*) >= 50)
SELECT 'by_type' AS scenario, 'seg_events_' || event_type AS segment_id, event_type AS segment, n AS n_rows, CAST(datediff('day', a, z) + 1 AS INT) AS n FROM s"""


@query(_BATCH)
def batch_series(spark, sf_dir):
    """Segments, their rows and the lengths of their daily series, as the batch run makes them."""
    manifest = {"data_path": f"{sf_dir}/events.parquet", "dataset_name": "events", "timestamp_col": "ts", "value_cols": ["value"], "freq": "daily", "clean": {"auto_detect": False}, "deviations": {"lookback_window": "10d"}, "scenarios": [{"name": "by_type", "segment_by": "event_type"}]}
    found = batch.run_all(spark, manifest)
    return found.listing.withColumnRenamed("n", "n_rows").join(found.results.select("segment_id", "n"), "segment_id").select("scenario", "segment_id", "segment", "n_rows", "n")
