"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as p
from . import query, rounded, table

_ORDERS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "time", "o_orderpriority": "string"}
_PART = {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"}


def _stats_sql(t: str, cols: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM {t}" for c, k in cols.items())


@query("SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def scan_count(spark, sf_dir):
    return p.union_all([table(spark, sf_dir, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in ("orders", "lineitem", "events")])


@query(_stats_sql("orders", _ORDERS))
def column_stats(spark, sf_dir):
    return p.column_stats(table(spark, sf_dir, "orders"))


def _value_sql(t: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", nullif(round(avg({c}), 4), 0) AS mean, nullif(round(stddev_samp({c}), 4), 0) AS std, nullif(round(CAST(min({c}) AS DOUBLE), 4), 0) AS min, nullif(round(CAST(max({c}) AS DOUBLE), 4), 0) AS max, nullif(round(median(CAST({c} AS DOUBLE)), 4), 0) AS median, round(stddev_samp({c}) / nullif(abs(avg({c})), 0), 4) AS cv FROM {t}"
        for c in cols
    )


@query(_value_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def value_stats(spark, sf_dir):
    return p.value_stats(table(spark, sf_dir, "lineitem"))


def _roles_sql(t: str, cols: dict) -> str:
    parts = []
    for c, k in cols.items():
        cv = f"coalesce(stddev_samp({c}) / nullif(abs(avg({c})), 0), 0)" if k in ("int", "float") else "0"
        dated = f"EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} ORDER BY v LIMIT 5) WHERE TRY_CAST(v AS BIGINT) BETWEEN 19000101 AND 20991231)" if k == "int" else "false"
        parts.append(f"""SELECT '{c}' AS "column", '{k}' AS kind, count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null,
 CASE WHEN '{k}' = 'time' OR {dated} THEN 'TIME'
 WHEN count(DISTINCT {c}) BETWEEN 2 AND 500 AND (('{k}' = 'string' AND count(DISTINCT {c}) <= 50) OR count(DISTINCT {c}) <= 5 OR (count(DISTINCT {c}) / count(*) <= 0.05 AND ('{k}' = 'string' OR ('{k}' = 'int' AND count(DISTINCT {c}) < 10 AND count(DISTINCT {c}) / count(*) < 0.01)))) THEN 'DISCRIMINATOR'
 WHEN '{k}' = 'float' OR ('{k}' = 'int' AND count(DISTINCT {c}) / count(*) <= 0.5 AND {cv} > 0.01) THEN 'VALUE'
 WHEN count(DISTINCT {c}) / count(*) > 0.5 THEN 'IDENTIFIER' ELSE 'UNKNOWN' END AS role FROM {t}""")
    return " UNION ALL ".join(parts)


@query(_roles_sql("orders", _ORDERS))
def column_roles(spark, sf_dir):
    return p.roles(table(spark, sf_dir, "orders"))


@query(_roles_sql("part", _PART))
def column_roles_part(spark, sf_dir):
    return p.roles(table(spark, sf_dir, "part"))


@query("""
WITH t AS (SELECT DISTINCT event_type, epoch_us(ts) / 1000000.0 AS x FROM events), d AS (SELECT *, x - lag(x) OVER (PARTITION BY event_type ORDER BY x) AS d FROM t), m AS (SELECT event_type, min(x) AS a, max(x) AS b, median(d) AS g FROM d GROUP BY 1)
SELECT event_type, round(a, 3) AS first_s, round(b, 3) AS last_s, round(g, 3) AS median_gap, CASE WHEN g IS NULL THEN 'unknown' WHEN g < 3600 THEN 'hourly' WHEN g < 86400 THEN 'daily' WHEN g < 604800 THEN 'weekly' WHEN g < 2592000 THEN 'monthly' ELSE 'quarterly_or_longer' END AS grain FROM m""")
def time_grain(spark, sf_dir):
    return rounded(p.time_grain(table(spark, sf_dir, "events"), "ts", ["event_type"]), 3)


def _located(spark, sf_dir):
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


_LOCATED = "l AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_LOCATED}, c AS (SELECT unnest(['s_name', 's_name', 'n_name']) AS a, unnest(['n_name', 'r_name', 'r_name']) AS b),
v AS (SELECT DISTINCT 's_name' AS a, 'n_name' AS b, s_name AS x, n_name AS y FROM l UNION SELECT 's_name', 'r_name', s_name, r_name FROM l UNION SELECT 'n_name', 'r_name', n_name, r_name FROM l),
k AS (SELECT a, b, count(*) AS n, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy FROM v GROUP BY 1, 2)
SELECT CASE WHEN n = dx AND dx > dy THEN a ELSE b END AS child, CASE WHEN n = dx AND dx > dy THEN b ELSE a END AS parent FROM k WHERE (n = dx AND dx > dy) OR (n = dy AND dy > dx)""")
def fd_hierarchy(spark, sf_dir):
    return p.dependencies(_located(spark, sf_dir), ["s_name", "n_name", "r_name"])


@query(f"""WITH RECURSIVE {_LOCATED}, e AS (SELECT DISTINCT 's_name=' || s_name AS child, 'n_name=' || n_name AS parent FROM l UNION SELECT 'n_name=' || n_name, 'r_name=' || r_name FROM l),
c AS (SELECT DISTINCT child AS node, child AS ancestor, 0 AS depth FROM e WHERE child LIKE 's_name%' UNION SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor)
SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY 1, 2""")
def value_climb(spark, sf_dir):
    df = _located(spark, sf_dir)
    edges = p.value_edges(df, "s_name", "n_name").unionByName(p.value_edges(df, "n_name", "r_name"))
    return p.climb(edges, edges.where("child like 's_name%'").select(F.col("child").alias("node")))


@query("""WITH a AS (SELECT DISTINCT 'o_custkey' AS c, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT 'o_orderstatus', o_orderstatus FROM orders),
b AS (SELECT DISTINCT 'c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT a.c AS column_a, b.c AS column_b, count(*) AS shared FROM a JOIN b USING (v) GROUP BY 1, 2""")
def join_path(spark, sf_dir):
    return p.join_columns(p.column_values(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"]), p.column_values(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"]))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf_dir):
    return p.value_counts(table(spark, sf_dir, "part"), "p_type")


@query("""WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)
SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5""")
def top_values(spark, sf_dir):
    return p.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_name"])


@query("""WITH s AS (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, 'int' AS k, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 'int', count(*) FROM orders
 UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 'string', count(*) FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'float', count(*) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 'string', count(*) FROM orders)
SELECT c AS "column", d AS n_distinct FROM s WHERE (k = 'int' AND d BETWEEN 2 AND 50) OR (k = 'string' AND d / n <= 0.9 AND d BETWEEN 2 AND 1000)""")
def segment_candidates(spark, sf_dir):
    return p.segment_candidates(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT * FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(\"column\")")
def numeric_columns(spark, sf_dir):
    return p.numeric_columns(table(spark, sf_dir, "lineitem"))


@query("""WITH s AS (SELECT * FROM (SELECT DISTINCT CAST(ts::DATE AS VARCHAR) AS v FROM events ORDER BY v LIMIT 20)) SELECT 'day' AS "column", avg(CAST(TRY_CAST(v AS TIMESTAMP) IS NOT NULL AS INT)) AS share, true AS candidate FROM s
UNION ALL SELECT 'event_type', 0.0, false""")
def timestamp_share(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type")
    return p.timestamp_share(df, ["day", "event_type"])
