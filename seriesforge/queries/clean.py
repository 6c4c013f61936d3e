"""Queries that clean columns and normalise names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..functions import text as tx
from ..operators import clean as c
from ..operators import normalize as nz
from ..sources import readers
from . import query, rounded, table


def _holed(spark, sf_dir):
    """Events with some nulls, mixed case and padding, as the tables themselves have none."""
    kind = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"))).when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").withColumns({"kind": kind, "money": F.concat(F.lit("$"), fixed(F.col("value"), 2).cast("decimal(12,2)").cast("string")), "maybe": F.when(F.col("event_id") % 5 != 0, F.col("value"))})


_HOLED = "h AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN ' ' || upper(event_type) WHEN event_id % 7 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 <> 0 THEN value END AS maybe FROM events)"


@query(f"""WITH {_HOLED} SELECT 'event_id' AS "column", 0.0 AS null_rate, false AS is_high UNION ALL SELECT 'kind', round(avg(CAST(kind IS NULL AS INT)), 6), false FROM h UNION ALL SELECT 'maybe', round(avg(CAST(maybe IS NULL AS INT)), 6), false FROM h""")
def null_rates(spark, sf_dir):
    return rounded(c.null_rates(_holed(spark, sf_dir).select("event_id", "kind", "maybe")), 6)


@query(f"""WITH {_HOLED}, v AS (SELECT kind AS value, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY 1)
SELECT lower(trim(value)) AS key, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS n, arg_max(value, struct_pack(a := n, b := value)) AS canonical FROM v GROUP BY 1 HAVING count(*) > 1""")
def case_variants(spark, sf_dir):
    return c.case_variants(_holed(spark, sf_dir), "kind")


@query("""SELECT 'money' AS "column", 1.0 AS share, true AS is_numeric UNION ALL SELECT 'event_type', 0.0, false""")
def numeric_strings(spark, sf_dir):
    return c.numeric_strings(_holed(spark, sf_dir), ["money", "event_type"])


@query("SELECT event_id, CAST(round(value, 2) AS DECIMAL(12, 2))::DOUBLE AS money FROM events")
def coerce_numeric(spark, sf_dir):
    df = _holed(spark, sf_dir).select("event_id", "money")
    return c.coerce_numeric(df, "money")


@query(f"WITH {_HOLED} SELECT event_id, coalesce(CASE trim(kind) WHEN 'CLICK' THEN 'click' WHEN 'VIEW' THEN 'view' ELSE trim(kind) END, '') AS kind FROM h")
def normalize_text(spark, sf_dir):
    df = c.normalize_text(_holed(spark, sf_dir).select("event_id", "kind"), "kind", {"CLICK": "click", "VIEW": "view", " VIEW": "lost"})
    return c.fill_nulls(df, "kind", "fill_value", "")


@query("SELECT p_partkey, CASE p_type WHEN (SELECT min(p_type) FROM part) THEN 'second' ELSE p_type END AS p_type FROM part")
def entity_resolution(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    least = df.agg(F.min("p_type")).first()[0]
    return c.entity_resolution(df, "p_type", {least: "first", "first": "second"})


@query(f"WITH {_HOLED} SELECT event_id, round(coalesce(maybe, (SELECT avg(maybe) FROM h)), 4) AS maybe FROM h")
def fill_mean(spark, sf_dir):
    return rounded(c.fill_nulls(_holed(spark, sf_dir).select("event_id", "maybe"), "maybe", "fill_mean"))


@query(f"WITH {_HOLED} SELECT event_id, last_value(maybe IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS maybe FROM h")
def fill_forward(spark, sf_dir):
    return c.fill_nulls(_holed(spark, sf_dir).select("event_id", "user_id", "maybe"), "maybe", "fill_forward", order="event_id", keys=["user_id"]).select("event_id", "maybe")


@query(f"WITH {_HOLED} SELECT event_id, last_value(maybe IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS maybe FROM h")
def fill_forward_all(spark, sf_dir):
    """Over the whole table, without keys."""
    return c.fill_nulls(_holed(spark, sf_dir).select("event_id", "maybe"), "maybe", "fill_forward", order="event_id")


@query(f"WITH {_HOLED} SELECT event_id, coalesce(maybe, -1.0) AS maybe FROM h")
def fill_value(spark, sf_dir):
    return c.fill_nulls(_holed(spark, sf_dir).select("event_id", "maybe"), "maybe", "fill_value", -1.0)


@query(f"WITH {_HOLED} SELECT event_id, kind FROM h WHERE kind IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return c.fill_nulls(_holed(spark, sf_dir).select("event_id", "kind"), "kind", "drop_rows")


@query("SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::TIMESTAMP AS ts FROM events")
def tz_convert(spark, sf_dir):
    return c.timezone_convert(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "America/New_York")


@query("SELECT 0.0 AS with_zone, 1.0 AS at_midnight")
def timezone_marks(spark, sf_dir):
    return c.timezone_marks(table(spark, sf_dir, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("d")).select(F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d")), "d")


@query(f"WITH {_HOLED} SELECT count(*) AS n, count(kind) AS n_kind, sum(CAST(kind = trim(kind) AS INT)) AS n_trimmed FROM (SELECT trim(kind) AS kind FROM h)")
def clean_dataset(spark, sf_dir):
    ops = [{"operation": "normalize_text", "column": "kind"}, {"operation": "coerce_numeric", "column": "absent"}, {"operation": "drop_column", "column": "money"}]
    df, applied, errors = c.clean(_holed(spark, sf_dir), ops)
    assert len(applied) == 2 and len(errors) == 1
    return df.agg(F.count("*").alias("n"), F.count("kind").alias("n_kind"), F.sum((F.col("kind") == F.trim("kind")).cast("int")).alias("n_trimmed"))


@query(f"WITH {_HOLED} SELECT event_id FROM h WHERE kind IS NOT DISTINCT FROM NULL AND event_type = 'view'")
def null_safe_filter(spark, sf_dir):
    return _holed(spark, sf_dir).where(c.matches_all({"kind": None, "event_type": "view"})).select("event_id")


@query(f"WITH {_HOLED} SELECT event_id FROM h WHERE (maybe > 50) IS NOT TRUE")
def soft_delete(spark, sf_dir):
    df = _holed(spark, sf_dir).withColumn("deleted", F.col("maybe") > 50)
    return readers.live_rows(df, "deleted").select("event_id")


def _spelled(spark, sf_dir):
    """Part names written as raw product names: abbreviations, separators, pack sizes."""
    n = F.col("p_partkey")
    name = F.when(n % 4 == 0, F.concat(F.upper(F.regexp_replace("p_name", " ", "_")), F.lit(" LT 12pk"))).when(n % 4 == 1, F.concat("p_name", F.lit(" lgt 16.5 oz. 7"))).when(n % 4 == 2, F.concat(F.initcap("p_name"), F.lit(" (Light)"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", name.alias("raw"))


_SPELLED = "s AS (SELECT p_partkey, p_name, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, ' ', '_')) || ' LT 12pk' WHEN 1 THEN p_name || ' lgt 16.5 oz. 7' WHEN 2 THEN p_name || ' (Light)' ELSE p_name END AS raw FROM part)"


@query(f"""WITH {_SPELLED} SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN lower(p_name) WHEN p_partkey % 4 = 1 THEN lower(p_name) || ' light' ELSE lower(p_name) || ' light' END AS normalized,
CASE p_partkey % 4 WHEN 0 THEN '12pk' WHEN 1 THEN '16.5 oz' END AS pack_info FROM s""")
def text_normalize(spark, sf_dir):
    return _spelled(spark, sf_dir).select("p_partkey", tx.normalize(F.col("raw")).alias("normalized"), tx.pack_info(F.col("raw")).alias("pack_info"))


@query(f"WITH {_SPELLED} SELECT DISTINCT p_type, substr(trim(regexp_replace(lower(p_type || ' & ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60) AS safe FROM s")
def safe_names(spark, sf_dir):
    return _spelled(spark, sf_dir).select("p_type", tx.safe_name(F.concat("p_type", F.lit(" & "), "p_brand", F.lit("!"))).alias("safe")).distinct()


_RULES = {"red|blue": {"family": "primary", "shelf": "A"}, "green|violet|orange": {"family": "secondary"}, "default": {"family": "other", "shelf": "Z"}}
_RULE_SQL = "CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 'primary' WHEN regexp_matches(p_name, '(?i)green|violet|orange') THEN 'secondary' ELSE 'other' END AS family, CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 'A' ELSE 'Z' END AS shelf"


@query(f"SELECT p_partkey, {_RULE_SQL} FROM part")
def rule_classify(spark, sf_dir):
    return nz.classify(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _RULES, ["family", "shelf"]).drop("p_name")


@query(f"WITH l AS (SELECT p_name, {_RULE_SQL} FROM part WHERE p_size < 10 GROUP BY p_name) SELECT p.p_partkey, l.family AS norm_p_name_family, l.shelf AS norm_p_name_shelf FROM part p LEFT JOIN l ON l.p_name = p.p_name")
def lookup_enrich(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lookup = nz.classify(part.where("p_size < 10").select(F.col("p_name").alias("raw_value")).distinct(), "raw_value", _RULES, ["family", "shelf"])
    return nz.lookup_enrich(part.select("p_partkey", "p_name"), lookup, "p_name", ["family", "shelf"]).drop("p_name")


def _names(spark, sf_dir):
    return _spelled(spark, sf_dir).select("raw")


@query()
def fuzzy_clusters(spark, sf_dir):
    return nz.cluster_names(_names(spark, sf_dir))


@query()
def fuzzy_pairs(spark, sf_dir):
    return nz.fuzzy_pairs(table(spark, sf_dir, "part").select(F.col("p_name").alias("raw")), 82.0)


@query("SELECT count(DISTINCT p_name) AS raw_values, count(DISTINCT p_name) AS canonicals, count(DISTINCT family) AS n_family FROM (SELECT lower(p_name) AS p_name, CASE WHEN regexp_matches(p_name, '(?i)red|blue') THEN 'primary' WHEN regexp_matches(p_name, '(?i)green|violet|orange') THEN 'secondary' ELSE 'other' END AS family FROM part)")
def normalization_summary(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("raw")).distinct()
    return nz.summary(nz.build_lookup(nz.cluster_names(names, 101.0), _RULES, ["family"]), ["family"])


@query("SELECT count(*) AS n, count(canonical) AS found FROM (SELECT lower(p_name) AS canonical FROM part)")
def resolve_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lookup = nz.build_lookup(nz.cluster_names(part.select(F.lower("p_name").alias("raw")).distinct(), 101.0), _RULES, ["family"])
    return nz.resolve(part, lookup, "p_name").agg(F.count("*").alias("n"), F.count("canonical").alias("found"))


@query("SELECT DISTINCT lower(p_name) AS canonical FROM part WHERE regexp_matches(p_name, '(?i)red|blue')")
def hierarchy_children(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("raw")).distinct()
    return nz.children(nz.build_lookup(nz.cluster_names(names, 101.0), _RULES, ["family"]), "family", "primary", "canonical")
