"""Queries over the registry; the embeddings table stands for registered vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as rg
from . import query, rounded, table

_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(f"SELECT b.vec_id, round({_COS}, 5) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return rounded(rg.similar(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 0, 10).select("vec_id", "similarity"), 5)


@query(f"SELECT round({_COS}, 5) AS embedding, round({_COS}, 5) AS ensemble FROM embeddings a, embeddings b WHERE a.vec_id = 1 AND b.vec_id = 2")
def explain_similarity(spark, sf_dir):
    return rounded(rg.explain(table(spark, sf_dir, "embeddings"), "vec_id", 1, 2, ["embedding"]), 5)


@query()
def kmeans_pca(spark, sf_dir):
    return rg.clusters(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 4, restarts=3).select("vec_id", "cluster", "size")


_REG = "r AS (SELECT CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' ELSE 'superseded' END AS status, o_orderpriority AS dataset_name, o_totalprice AS deviation_count, o_orderdate AS registered_at FROM orders)"


def _registry(spark, sf_dir):
    from ..sources.sinks import supersede

    o = supersede(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return o.select("status", F.col("o_orderpriority").alias("dataset_name"), F.col("o_totalprice").alias("deviation_count"), F.col("o_orderdate").alias("registered_at"))


@query(f"WITH {_REG} SELECT count(*) FILTER (WHERE status = 'active') AS total_active, count(*) FILTER (WHERE status = 'superseded') AS total_superseded, count(DISTINCT dataset_name) FILTER (WHERE status = 'active') AS datasets, round(avg(deviation_count) FILTER (WHERE status = 'active'), 2) AS avg_deviations, min(registered_at) FILTER (WHERE status = 'active')::TIMESTAMP AS earliest_signal, max(registered_at) FILTER (WHERE status = 'active')::TIMESTAMP AS latest_signal FROM r")
def store_stats(spark, sf_dir):
    return rounded(rg.store_statistics(_registry(spark, sf_dir)), 2)


_DEV = "d AS (SELECT event_id, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity, event_type AS deviation_type, 'u' || user_id AS segment FROM events)"


def _devs(spark, sf_dir):
    v = F.col("value")
    sev = F.when(v >= 90, "critical").when(v >= 70, "high").when(v >= 40, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", "ts", "value", sev.alias("severity"), F.col("event_type").alias("deviation_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("segment"))


@query(f"WITH {_DEV} SELECT 'severity' AS kind, severity AS key, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'deviation_type', deviation_type, count(*) FROM d GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'segment', segment, count(*) AS n FROM d GROUP BY 2 ORDER BY n DESC, segment LIMIT 10)")
def deviation_summary(spark, sf_dir):
    return rg.deviation_summary(_devs(spark, sf_dir))


@query(f"WITH {_DEV} SELECT event_id, severity FROM d ORDER BY severity DESC, event_id LIMIT 20 OFFSET 40")
def severity_lex_page(spark, sf_dir):
    return rg.page(_devs(spark, sf_dir), [F.desc("severity"), "event_id"], 20, 40).select("event_id", "severity")


@query(f"WITH {_DEV} SELECT event_id, severity FROM d ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_id LIMIT 20")
def severity_ranked_page(spark, sf_dir):
    s = F.col("severity")
    return rg.page(_devs(spark, sf_dir), [F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).otherwise(3), "event_id"], 20).select("event_id", "severity")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%ed %' OR p_type ILIKE '%ed %'")
def ilike_search(spark, sf_dir):
    return rg.search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "ED ").select("p_partkey")


@query("""WITH h AS (SELECT event_type, hour(ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, min(v) AS lo, max(v) AS hi, count(*) AS n FROM h GROUP BY 1), c AS (SELECT event_type, count(*) AS rows, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT c.event_type, CAST(54 AS INT) AS n, round(0.7, 6)::DOUBLE AS strength, round(least(100, sd) / 100, 6) AS residual, round(ln(1 + rows) / 15, 6) AS size, 0.4::DOUBLE AS grain, round((v - lo) / (hi - lo), 6) AS noon FROM c JOIN h ON h.event_type = c.event_type AND h.h = 12 JOIN m ON m.event_type = c.event_type""")
def shape_embedding(spark, sf_dir):
    from ..operators.series import seasonal_vector

    e = table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("row_count"), F.stddev_pop("value").alias("residual_std"))
    none = {c: F.lit(None).cast("double") for c in ("trend_slope", "deviation_density", "deviation_count_90d", "critical_pct", "variance_explained", "residual_kurtosis")}
    df = sums.join(seasonal_vector(e, "ts", "value", ["event_type"], "hour").withColumnRenamed("seasonal", "hourly"), "event_type")
    df = df.withColumns({**none, "weekly": F.lit(None).cast("array<double>"), "monthly": F.lit(None).cast("array<double>"), "temporal_grain": F.lit("daily"), "trend_direction": F.lit("flat"), "seasonality_strength": F.lit(0.7)})
    v = df.select("event_type", rg.shape_embedding().alias("e"))
    return v.select("event_type", F.size("e").alias("n"), F.col("e")[44].alias("strength"), F.col("e")[45].alias("residual"), F.col("e")[49].alias("size"), F.col("e")[50].alias("grain"), F.col("e")[7 + 12].alias("noon"))


@query("""WITH d AS (SELECT event_type, ts, value / 20 AS z, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS s FROM events)
SELECT event_type, CAST(47 AS INT) AS n, round(avg(CAST(s = 'low' AS INT)), 6) AS low, round(avg(CAST(s = 'critical' AS INT)), 6) AS critical, round(avg(CAST(isodow(ts) = 1 AS INT)), 6) AS monday, round(avg(CAST(month(ts) = 1 AS INT)), 6) AS january, round(least(10, greatest(0, avg(abs(z)))) / 10, 6) AS z_mean FROM d GROUP BY 1""")
def deviation_embedding(spark, sf_dir):
    d = _devs(spark, sf_dir).select("deviation_type", F.col("ts").alias("start"), "severity", F.lit("point_anomaly").alias("kind"), (F.col("value") / 20).alias("z_score"))
    v = rg.deviation_embedding(d, "deviation_type")
    at = lambda i, n: F.col("embedding")[i].alias(n)
    return v.select(F.col("deviation_type").alias("event_type"), F.size("embedding").alias("n"), at(0, "low"), at(3, "critical"), at(4, "monday"), at(11, "january"), at(23, "z_mean"))


@query()
def text_search(spark, sf_dir):
    found = rg.nearest_texts(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_type"), "red steel", 10, "p_partkey")
    return rounded(found.select("p_partkey", "similarity"), 6)
