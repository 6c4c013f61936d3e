"""Queries that look at whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inspect as ins
from ..operators import profile as p
from . import query, rounded, table


def _inspect_sql(t: str, cols: dict[str, str]) -> str:
    out = []
    for c, k in cols.items():
        num = k in ("int", "float")
        ends = f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max"
        stats = f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std" if num else "NULL::DOUBLE AS mean, NULL::DOUBLE AS std"
        out.append(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {ends}, {stats} FROM {t}")
    return " UNION ALL ".join(out)


@query(_inspect_sql("customer", {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"}))
def inspect_table(spark, sf_dir):
    return rounded(ins.columns(table(spark, sf_dir, "customer")))


@query("""SELECT 'l_linenumber' AS "column", 'int' AS kind, count(DISTINCT l_linenumber) AS n_distinct, 'categorical' AS role FROM lineitem UNION ALL SELECT 'l_quantity', 'float', count(DISTINCT l_quantity), 'numeric' FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string', count(DISTINCT l_returnflag), 'categorical' FROM lineitem UNION ALL SELECT 'l_shipdate', 'time', count(DISTINCT l_shipdate), 'timestamp' FROM lineitem UNION ALL SELECT 'is_late', 'string', 2, 'boolean' FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'line_id', 'string', count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey), 'identifier' FROM lineitem""")
def load_roles(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    cols = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in cols])
    return ins.load_roles(df.select("l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", (F.col("l_quantity") > 25).cast("string").alias("is_late"), line.alias("line_id")))


@query("""WITH e AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), b AS (SELECT *, CAST(least(50, greatest(20, n // 50)) AS INT) AS k FROM e)
SELECT event_type, least(k - 1, CAST(floor((value - lo) / ((hi - lo) / k)) AS INT)) AS bin, count(*) AS n, round(any_value(lo + least(k - 1, CAST(floor((value - lo) / ((hi - lo) / k)) AS INT)) * ((hi - lo) / k)), 4) AS low FROM events JOIN b USING (event_type) GROUP BY 1, 2""")
def value_histogram(spark, sf_dir):
    return rounded(ins.histogram(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query("SELECT 'orders' AS dataset, 1 AS \"TIME\", 2 AS \"DISCRIMINATOR\" UNION ALL SELECT 'part', 0, 2 + CAST((SELECT count(DISTINCT p_name) <= 500 AND count(DISTINCT p_name) / count(*) <= 0.05 FROM part) AS INT)")
def role_overview(spark, sf_dir):
    both = p.union_all([p.roles(table(spark, sf_dir, t)).withColumn("dataset", F.lit(t)) for t in ("orders", "part")])
    return ins.overview(both).select("dataset", F.col("TIME").cast("int").alias("TIME"), F.col("DISCRIMINATOR").cast("int").alias("DISCRIMINATOR"))


@query("""SELECT 'p_name_p_type' AS name, count(DISTINCT p_type) AS n FROM part UNION ALL SELECT 'p_name_p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part""")
def segment_estimates(spark, sf_dir):
    return ins.segment_estimates({"p_name": table(spark, sf_dir, "part")}, ["p_type", "p_brand"])


@query("SELECT lower(event_type) AS key, upper(event_type[1]) || lower(event_type[2:]) AS name FROM events GROUP BY 1, 2")
def best_spelling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    rows = e.select(F.lower("event_type").alias("key"), F.explode(F.array(F.upper("event_type"), F.lower("event_type"), F.initcap("event_type"))).alias("name"))
    return ins.best_spellings(rows, "key", "name")
