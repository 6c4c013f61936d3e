"""Queries that extract categories from names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as ex
from . import query, table

#: A small rule set over the parts' names; deployments bring their own.
RULES = ex.RuleSet(
    "fasteners",
    include=[r"\bbolt\b", r"\bscrew\b", r"\brivet\b", r"\banvil\b", r"\bring\b"],
    include_unless=[r"\bgear\b"],
    unless=["cold"],
    exclude=["^old"],
    outputs={"kind": [(r"\bbolt\b|\bscrew\b", "threaded"), (r"\brivet\b", "pressed")], "tone": [("red|hot", "warm"), ("blue|cold", "cool")]},
    otherwise={"kind": "other"},
)


@query("""WITH n AS (SELECT p_partkey, '$4.50 ' || upper(p_name) AS raw, lower(p_name) AS clean_name FROM part)
SELECT p_partkey, clean_name, CASE WHEN regexp_matches(clean_name, '\\bbolt\\b|\\bscrew\\b') THEN 'threaded' WHEN regexp_matches(clean_name, '\\brivet\\b') THEN 'pressed' ELSE 'other' END AS kind, CASE WHEN regexp_matches(clean_name, 'red|hot') THEN 'warm' WHEN regexp_matches(clean_name, 'blue|cold') THEN 'cool' END AS tone
FROM n WHERE NOT regexp_matches(clean_name, '^old') AND (regexp_matches(clean_name, '\\b(bolt|screw|rivet|anvil|ring)\\b') OR (regexp_matches(clean_name, '\\bgear\\b') AND NOT regexp_matches(clean_name, 'cold')))""")
def case_extract(spark, sf_dir):
    before = F.element_at(F.array(*map(F.lit, ("$4.50 ", "0 1/2 ", "# 12 ", "$3 1 1/2 #7"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(before, F.upper("p_name")).alias("raw"))
    return ex.extract(df, "raw", RULES).drop("raw")


@query("""SELECT p_partkey, CASE WHEN p_name ILIKE 'old%' THEN NULL WHEN regexp_matches(p_name, '(?i)bolt|gear') THEN 'machine' WHEN regexp_matches(p_name, '(?i)ring|plate') THEN 'flat' END AS category,
CASE WHEN p_name ILIKE 'old%' THEN NULL WHEN regexp_matches(p_name, '(?i)bolt|gear') THEN regexp_extract(lower(p_name), 'bolt|gear') WHEN regexp_matches(p_name, '(?i)ring|plate') THEN regexp_extract(lower(p_name), 'ring|plate') END AS matched FROM part""")
def classify_names(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return ex.classify(df, "p_name", [("bolt|gear", "machine"), ("ring|plate", "flat")], ["^old"]).drop("p_name")


@query("WITH c AS (SELECT CASE WHEN p_name ILIKE 'old%' THEN NULL WHEN regexp_matches(p_name, '(?i)bolt|gear') THEN 'machine' WHEN regexp_matches(p_name, '(?i)ring|plate') THEN 'flat' END AS category FROM part) SELECT category, count(*) AS n FROM c GROUP BY 1")
def classifier_counts(spark, sf_dir):
    return classify_names(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
