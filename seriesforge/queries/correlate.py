"""Queries that correlate signals. Events serve as signals: their type is the source, users stand at made-up places."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import correlate as co
from ..sources import sinks
from . import query, rounded, table

#: Every event as a signal.
_SIGNALS = """s AS (SELECT 'e' || event_id AS signal_id, event_type AS source_id, CASE WHEN event_id % 11 = 0 THEN 'baseline_pattern' ELSE 'point_anomaly' END AS signal_type, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity,
 ts AS ts_start, ts + to_minutes(CAST(event_id % 90 AS BIGINT)) AS ts_end, value AS magnitude, (event_id % 10) / 10.0::DOUBLE AS confidence, (user_id % 120 - 60)::DOUBLE AS latitude, ((user_id * 37) % 360 - 180)::DOUBLE AS longitude, user_id, event_id FROM events)"""


def signals(spark, sf_dir):
    e = F.col("event_id")
    sev = F.when(F.col("value") >= 90, "critical").when(F.col("value") >= 70, "high").when(F.col("value") >= 40, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), e.cast("string")).alias("signal_id"), F.col("event_type").alias("source_id"), F.when(e % 11 == 0, co.BASELINE).otherwise("point_anomaly").alias("signal_type"), F.lit("value").alias("column_name"), sev.alias("severity"),
        F.col("ts").alias("ts_start"), (F.col("ts") + F.make_dt_interval(mins=(e % 90).cast("int"))).alias("ts_end"), F.col("value").alias("magnitude"), (e % 10 / 10.0).alias("confidence"),
        (F.col("user_id") % 120 - 60).cast("double").alias("latitude"), ((F.col("user_id") * 37) % 360 - 180).cast("double").alias("longitude"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("bucket"), (e % 50).cast("string")).alias("entity_values"), F.when(e % 3 == 0, "sustained").otherwise("transient").alias("persistence"),
    )


def _co(window: int, least: float) -> str:
    return _CO.replace("<= 600", f"<= {window}").replace(">= 0.8", f">= {least}")


_CO = f"""{_SIGNALS}, r AS (SELECT *, epoch_us(ts_start) / 1e6 AS a, epoch_us(ts_end) / 1e6 AS z, CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END AS c FROM s WHERE signal_type <> 'baseline_pattern'),
p AS (SELECT x.signal_id AS signal_a_id, y.signal_id AS signal_b_id, x.source_id AS source_a_id, y.source_id AS source_b_id, greatest(0, least(x.z, y.z) - greatest(x.a, y.a)) / greatest(x.z - x.a, y.z - y.a, 1.0) AS o, least(x.c, y.c) AS c
 FROM r x JOIN r y ON x.source_id < y.source_id AND greatest(0, y.a - x.z, x.a - y.z) <= 600),
co AS (SELECT signal_a_id, signal_b_id, source_a_id, source_b_id, 'temporal_co_occurrence' AS correlation_type, round(o, 4) AS strength, round(least(1.0, (0.5 + o * 0.5) * c / 0.5), 4) AS confidence FROM p WHERE round(least(1.0, (0.5 + o * 0.5) * c / 0.5), 4) >= 0.8)"""


@query(f"WITH {_CO} SELECT * FROM co")
def co_occurrence(spark, sf_dir):
    return co.co_occurrence(signals(spark, sf_dir), 600.0, 0.8).drop("lag_periods", "spatial_distance_km")


@query(f"""WITH {_SIGNALS}, p AS (SELECT x.signal_id AS signal_a_id, y.signal_id AS signal_b_id, 2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(y.latitude - x.latitude) / 2) ^ 2 + cos(radians(x.latitude)) * cos(radians(y.latitude)) * sin(radians(y.longitude - x.longitude) / 2) ^ 2))) AS d
 FROM s x JOIN s y ON x.source_id < y.source_id WHERE x.signal_type <> 'baseline_pattern' AND y.signal_type <> 'baseline_pattern' AND abs(x.latitude - y.latitude) < 6)
SELECT signal_a_id, signal_b_id, round(greatest(0, 1 - d / 500.0), 4) AS strength, round(d, 2) AS spatial_distance_km, round(greatest(0, 1 - d / 500.0) * 0.5 + 0.5, 4) AS confidence FROM p WHERE d <= 500.0""")
def spatial_pairs(spark, sf_dir):
    return co.spatial_alignment(signals(spark, sf_dir), 500.0, 0.3).select("signal_a_id", "signal_b_id", "strength", "spatial_distance_km", "confidence")


@query(f"""WITH {_SIGNALS} SELECT x.signal_id AS signal_a_id, y.signal_id AS signal_b_id, round((CAST(x.user_id = y.user_id AS INT) + CAST(x.event_id % 50 = y.event_id % 50 AS INT)) / 2.0::DOUBLE, 4) AS strength FROM s x JOIN s y ON x.source_id < y.source_id
WHERE x.user_id = y.user_id AND x.event_id % 50 = y.event_id % 50""")
def entity_pairs(spark, sf_dir):
    return co.entity_alignment(signals(spark, sf_dir), 0.9).select("signal_a_id", "signal_b_id", "strength")


_PAT = "t AS (SELECT event_type AS source_id, event_type || '-h' AS signal_id, 'hourly' AS l, round(stddev_pop(value) / 100, 6) AS st, hour(max(ts)) AS ph FROM events GROUP BY 1 UNION ALL SELECT event_type, event_type || '-w', 'weekly', round(avg(value) / 1000, 6), isodow(min(ts)) FROM events GROUP BY 1)"


@query(f"""WITH {_PAT}, p AS (SELECT x.signal_id AS signal_a_id, y.signal_id AS signal_b_id, round((1 - abs(x.st - y.st)) * 0.4 + CASE WHEN x.ph = y.ph THEN 1.0 ELSE 0.3 END * 0.6, 4) AS strength FROM t x JOIN t y ON x.l = y.l AND x.source_id < y.source_id)
SELECT * FROM p WHERE strength >= 0.3""")
def pattern_pairs(spark, sf_dir):
    return co.pattern_similarity(_patterns(spark, sf_dir)).select("signal_a_id", "signal_b_id", "strength")


_LAG = """d AS (SELECT event_type AS s, ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1, 2), e AS (SELECT s, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
f AS (SELECT e.s, g::DATE AS day, coalesce(v, 0) AS v FROM (SELECT s, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS g FROM e) e LEFT JOIN d ON d.s = e.s AND d.day = g::DATE),
c AS (SELECT x.s AS a, y.s AS b, count(*) AS n, min(x.day) AS lo, max(x.day) AS hi FROM f x JOIN f y ON x.day = y.day AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 10),
l AS (SELECT *, unnest(range(-least(5, n // 3), least(5, n // 3) + 1)) AS lag FROM c)
SELECT l.a AS source_a, l.b AS source_b, CAST(lag AS INT) AS lag, count(*) AS n, round(corr(x.v, y.v), 6) AS r FROM l JOIN f x ON x.s = l.a AND x.day BETWEEN lo AND hi JOIN f y ON y.s = l.b AND y.day = x.day - CAST(lag AS INT) AND y.day BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING count(*) >= 5"""


@query(f"WITH {_LAG}")
def lag_correlation(spark, sf_dir):
    from ..operators.series import aggregate

    daily = aggregate(table(spark, sf_dir, "events"), "ts", "day", [("sum", "value")], ["event_type"])
    return rounded(co.lag_scan(daily.select(F.col("event_type").alias("source_id"), "period", F.col("sum_value").alias("value")), 5), 6)


def _critical_r(n: int, p: float = 0.1) -> float:
    """The correlation of n pairs whose two-sided p is ``p``, by Simpson sums of the t density, for the SQL."""
    df = n - 2
    front = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
    density = lambda t: front * (1 + t * t / df) ** (-(df + 1) / 2)

    def upto(t: float, steps: int = 400) -> float:
        h = t / steps
        return h / 3 * (density(0) + density(t) + 4 * sum(density(h * i) for i in range(1, steps, 2)) + 2 * sum(density(h * i) for i in range(2, steps, 2)))

    lo, hi = 0.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if upto(mid) > 0.5 - p / 2 else (mid, hi)
    return lo / math.sqrt(df + lo * lo)


_LAGGED = """dl AS (SELECT source_id AS s, ts_start::DATE AS day, sum(abs(CASE WHEN coalesce(magnitude, 0) = 0 THEN 1.0 ELSE magnitude END)) AS v FROM s WHERE signal_type <> 'baseline_pattern' GROUP BY 1, 2),
el AS (SELECT s, min(day) AS lo, max(day) AS hi FROM dl GROUP BY 1), fl AS (SELECT el.s, g::DATE AS day, coalesce(v, 0) AS v FROM (SELECT s, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS g FROM el) el LEFT JOIN dl ON dl.s = el.s AND dl.day = g::DATE),
cl AS (SELECT x.s AS a, y.s AS b, count(*) AS n, min(x.day) AS lo, max(x.day) AS hi FROM fl x JOIN fl y ON x.day = y.day AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 10),
ll AS (SELECT *, unnest(range(-least(5, n // 3), least(5, n // 3) + 1)) AS lag FROM cl),
rl AS (SELECT ll.a, ll.b, lag, count(*) AS n, corr(x.v, y.v) AS r FROM ll JOIN fl x ON x.s = ll.a AND x.day BETWEEN lo AND hi JOIN fl y ON y.s = ll.b AND y.day = x.day - CAST(lag AS INT) AND y.day BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING count(*) >= 5),
crit(n, c) AS (VALUES %s),
bl AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(r) DESC, abs(lag), lag) AS k FROM rl JOIN crit USING (n) WHERE abs(r) > c),
sg AS (SELECT source_id, min(signal_id) AS sig FROM s WHERE signal_type <> 'baseline_pattern' GROUP BY 1 HAVING count(*) >= 3)""" % ", ".join(f"({n}, {_critical_r(n)!r})" for n in range(5, 61))


@query(f"""WITH {_SIGNALS}, {_LAGGED} SELECT x.sig AS signal_a_id, y.sig AS signal_b_id, a AS source_a_id, b AS source_b_id, round(abs(r), 4) AS strength, CAST(lag AS INT) AS lag_periods
FROM bl JOIN sg x ON x.source_id = a JOIN sg y ON y.source_id = b WHERE k = 1 AND round(abs(r), 4) >= 0.1""")
def lagged_correlations(spark, sf_dir):
    return co.lagged_correlation(signals(spark, sf_dir), 5, 0.1).select("signal_a_id", "signal_b_id", "source_a_id", "source_b_id", "strength", "lag_periods")


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    edge = lambda df, p, k, n: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("a"), F.concat(F.lit("n"), F.col(n).cast("string")).alias("b"))
    return co.components(edge(c, "c", "c_custkey", "c_nationkey").unionByName(edge(s, "s", "s_suppkey", "s_nationkey")))


def _patterns(spark, sf_dir):
    """Hourly and weekly patterns of the event types; their signals are their own."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id"))
    h = e.agg(fixed(F.stddev_pop("value") / 100, 6).alias("strength"), F.hour(F.max("ts")).alias("peak_phase")).withColumns({"signal_id": F.concat("source_id", F.lit("-h")), "period_label": F.lit("hourly")})
    w = e.agg(fixed(F.avg("value") / 1000, 6).alias("strength"), (F.weekday(F.min("ts")) + 1).alias("peak_phase")).withColumns({"signal_id": F.concat("source_id", F.lit("-w")), "period_label": F.lit("weekly")})
    return h.unionByName(w)


_ALL = f"""WITH {_co(60, 0.9)}, {_PAT}, {_LAGGED},
sp AS (SELECT x.signal_id AS a, y.signal_id AS b, 2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(y.latitude - x.latitude) / 2) ^ 2 + cos(radians(x.latitude)) * cos(radians(y.latitude)) * sin(radians(y.longitude - x.longitude) / 2) ^ 2))) AS d
 FROM s x JOIN s y ON x.source_id < y.source_id WHERE x.signal_type <> 'baseline_pattern' AND y.signal_type <> 'baseline_pattern' AND abs(x.latitude - y.latitude) < 6),
al AS (SELECT 0 AS m, correlation_type, signal_a_id, signal_b_id FROM co
 UNION ALL SELECT 1, 'lagged_correlation', x.sig, y.sig FROM bl JOIN sg x ON x.source_id = a JOIN sg y ON y.source_id = b WHERE k = 1 AND round(abs(r), 4) >= 0.9
 UNION ALL SELECT 2, 'spatial_alignment', a, b FROM sp WHERE d <= 500.0 AND round(greatest(0, 1 - d / 500.0) * 0.5 + 0.5, 4) >= 0.9
 UNION ALL SELECT 3, 'entity_alignment', x.signal_id, y.signal_id FROM s x JOIN s y ON x.source_id < y.source_id AND x.user_id = y.user_id AND x.event_id % 50 = y.event_id % 50
 UNION ALL SELECT 4, 'pattern_similarity', x.signal_id, y.signal_id FROM t x JOIN t y ON x.l = y.l AND x.source_id < y.source_id WHERE round((1 - abs(x.st - y.st)) * 0.4 + CASE WHEN x.ph = y.ph THEN 1.0 ELSE 0.3 END * 0.6, 4) >= 0.9)"""


def _every(spark, sf_dir):
    return co.correlated(signals(spark, sf_dir), 60.0, 5, 500.0, 0.9, patterns=_patterns(spark, sf_dir))


@query(f"{_ALL} SELECT correlation_type, count(*) AS n FROM al GROUP BY 1")
def correlate_all(spark, sf_dir):
    return co.counts_by_type(_every(spark, sf_dir))


@query(f"{_ALL} SELECT correlation_type, signal_a_id, signal_b_id, 'corr_' || substr(sha256(concat_ws('|', correlation_type, signal_a_id, signal_b_id)), 1, 12) AS correlation_id FROM al ORDER BY m, signal_a_id, signal_b_id LIMIT 100")
def first_correlations(spark, sf_dir):
    return co.with_ids(co.first_correlations(_every(spark, sf_dir))).select("correlation_type", "signal_a_id", "signal_b_id", "correlation_id")


_INS = f"""WITH RECURSIVE {_co(60, 0.9)},
cr AS (SELECT * FROM (SELECT signal_a_id, signal_b_id, correlation_type, strength, confidence FROM co UNION ALL SELECT x.signal_id, y.signal_id, 'entity_alignment', 1.0, 1.0 FROM s x JOIN s y ON x.source_id < y.source_id AND x.user_id = y.user_id AND x.event_id % 50 = y.event_id % 50)),
u AS (SELECT signal_a_id AS a, signal_b_id AS b FROM cr UNION SELECT signal_b_id, signal_a_id FROM cr),
w AS (SELECT DISTINCT a AS node, a AS c FROM u UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.node), cm AS (SELECT node, min(c) AS component FROM w GROUP BY 1),
tt AS (SELECT count(DISTINCT source_id) AS total FROM s),
sd AS (SELECT component, list_sort(list(signal_id)) AS ids, count(DISTINCT source_id) AS n_sources, list_sort(list(DISTINCT source_id)) AS sources, list_sort(list(DISTINCT severity)) AS severities, avg(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE) AS sev,
  avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE) AS per FROM cm JOIN s ON s.signal_id = cm.node GROUP BY 1),
lk AS (SELECT component, avg(confidence) AS conf, avg(strength) AS st, string_agg(DISTINCT correlation_type, ',' ORDER BY correlation_type) AS correlation_types, count(*) AS n_correlations FROM cr JOIN cm ON cm.node = cr.signal_a_id GROUP BY 1),
ins AS (SELECT 'ins_' || substr(sha256(array_to_string(ids, '|')), 1, 12) AS insight_id, component, ids, n_sources, sources, severities, n_correlations, correlation_types, round(st, 4) AS strength, round(0.25 * sev + 0.30 * (n_sources / total) + 0.25 * conf + 0.20 * per, 4) AS actionability FROM sd JOIN lk USING (component), tt)"""


def _insights(spark, sf_dir):
    s = signals(spark, sf_dir)
    c = co.correlate(s, 60.0, least=0.9, methods=("temporal", "entity"))
    return s, c, co.insights(c, s)


@query(f"""{_INS} SELECT insight_id, component, n_sources, n_correlations, correlation_types, round(strength, 3) AS strength, round(actionability, 3) AS actionability,
CASE WHEN strength >= 0.75 THEN 'strong' WHEN strength >= 0.5 THEN 'moderate' ELSE 'weak' END || ' link between ' || len(ids) || ' signals of ' || n_sources || ' sources' AS narrative FROM ins""")
def insight_scores(spark, sf_dir):
    out = _insights(spark, sf_dir)[2]
    return out.select("insight_id", "component", "n_sources", "n_correlations", "correlation_types", fixed("strength", 3).alias("strength"), fixed("actionability", 3).alias("actionability"), "narrative")


@query(f"""{_INS}, e AS (SELECT insight_id, ids, n_sources, unnest(ids) AS sid FROM ins),
l AS (SELECT e.insight_id, len(e.ids) AS n_signals, e.n_sources, cr.*, 'corr_' || substr(sha256(concat_ws('|', correlation_type, signal_a_id, signal_b_id)), 1, 12) AS cid FROM e JOIN cr ON cr.signal_a_id = e.sid)
SELECT insight_id, n_sources, CAST(any_value(n_signals) AS INT) AS n_signals, min(strength) AS weakest_strength, arg_min(cid, struct_pack(a := strength, b := cid)) AS weakest_id, count(*) AS n_links,
CASE WHEN any_value(n_signals) >= 5 AND n_sources >= 3 THEN 'strong' WHEN any_value(n_signals) >= 3 AND n_sources >= 2 THEN 'moderate' ELSE 'weak' END AS assessment,
'a driver that all sources share; a change in how data are captured' || CASE WHEN bool_or(correlation_type = 'temporal_co_occurrence') THEN '; a coincidence in time' ELSE '' END AS other_explanations FROM l GROUP BY 1, 2""")
def weakest_link(spark, sf_dir):
    s, c, found = _insights(spark, sf_dir)
    return co.explain(found, c)


@query(f"""{_INS}, d AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(sources, lambda x: CASE WHEN regexp_matches(lower(x), 'pos|transaction|sales|retail') THEN 'pos' WHEN regexp_matches(lower(x), 'book|ticket|visit|experience') THEN 'bookings' END), lambda x: x IS NOT NULL))) AS dm,
CASE WHEN actionability >= 0.75 THEN 'HIGH' WHEN actionability >= 0.5 THEN 'MODERATE' ELSE 'LOW' END AS band FROM ins)
SELECT insight_id, ['look for the cause of the correlation', 'watch whether it lasts over the next period'] AS actions,
CASE WHEN n_sources >= 3 THEN 'spans ' || n_sources || ' sources; ' WHEN n_sources = 2 THEN 'spans 2 sources; ' ELSE '' END || CASE WHEN list_contains(severities, 'critical') THEN 'has critical signals; ' WHEN list_contains(severities, 'high') THEN 'has signals of high severity; ' ELSE '' END || 'overall ' || band AS reasoning,
len(ids) || ' signals of ' || n_sources || ' sources (' || array_to_string(sources, ', ') || '); ' || band AS summary FROM d WHERE len(dm) = 0""")
def insight_actions(spark, sf_dir):
    s, _, found = _insights(spark, sf_dir)
    out = co.suggest(found, s)
    return out.withColumn("summary", F.regexp_replace("summary", "strength [0-9.]+; (\\w+) actionability", "$1"))


@query(f"""{_INS}, e AS (SELECT insight_id, unnest(ids) AS sid FROM ins),
l AS (SELECT e.insight_id, cr.signal_a_id, cr.signal_b_id, cr.correlation_type, 'value (' || x.source_id || ') -> [' || correlation_type || '] -> value (' || y.source_id || ')' AS step FROM e JOIN cr ON cr.signal_a_id = e.sid JOIN s x ON x.signal_id = cr.signal_a_id JOIN s y ON y.signal_id = cr.signal_b_id)
SELECT insight_id, string_agg(step, ' | ' ORDER BY signal_a_id, signal_b_id, correlation_type) AS path FROM l GROUP BY 1""")
def insight_paths(spark, sf_dir):
    s, c, found = _insights(spark, sf_dir)
    return co.paths(found, c, s).withColumn("path", F.regexp_replace("path", ", [0-9.]+\\]", "]"))


@query(f"WITH {_SIGNALS} SELECT signal_id, source_id, severity FROM s WHERE source_id IN ('click', 'view') AND severity IN ('critical', 'high') AND ts_start >= TIMESTAMP '2024-01-05'")
def query_signals(spark, sf_dir):
    import datetime

    return co.query_signals(signals(spark, sf_dir), ["click", "view"], None, ["critical", "high"], datetime.datetime(2024, 1, 5)).select("signal_id", "source_id", "severity")


@query(f"{_INS} SELECT insight_id, n_sources FROM ins WHERE actionability >= 0.1 AND strength >= 0.0 AND list_contains(sources, 'click') ORDER BY actionability DESC, insight_id LIMIT 10")
def query_insights(spark, sf_dir):
    s, _, found = _insights(spark, sf_dir)
    return co.query_insights(found, s, 0.1, 0.0, ["click"], limit=10).select("insight_id", "n_sources")


@query(f"""{_INS}, e AS (SELECT i.insight_id, i.correlation_types, array_to_string(sources, ', ') AS src FROM ins i)
SELECT insight_id, '' AS domains, 'Cross-source ' || CASE WHEN contains(correlation_types, 'temporal_co_occurrence') THEN 'co-occurring' ELSE 'correlated' END || ' signals: value across ' || src AS title FROM e""")
def insight_titles(spark, sf_dir):
    from ..operators import inspect as ins

    s, _, found = _insights(spark, sf_dir)
    return ins.insight_title(found, s)


@query(f"WITH {_SIGNALS}, n AS (SELECT DISTINCT event_type AS source_id FROM events UNION ALL SELECT 'silent') SELECT n.source_id, count(signal_id) AS n_signals, max(ts_start)::TIMESTAMP AS last_signal FROM n LEFT JOIN s USING (source_id) GROUP BY 1")
def source_overview(spark, sf_dir):
    s = signals(spark, sf_dir)
    sources = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id")).distinct().union(spark.range(1).select(F.lit("silent")))
    return co.source_overview(sources, s)


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return sinks.upsert_latest(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey").drop("o_orderstatus")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'updated' ELSE 'registered' END AS status FROM customer")
def upsert_source(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sinks.upsert_status(c.where("c_mktsegment = 'BUILDING'"), c, "c_custkey").drop("c_mktsegment")


@query("""WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS r, lag(o_orderkey) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC))
SELECT o_orderkey, CASE WHEN r = 1 THEN 'active' ELSE 'superseded' END AS status, nx AS superseded_by FROM n""")
def supersede(spark, sf_dir):
    return sinks.supersede(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "status", "superseded_by")


@query("SELECT event_type AS source_id, CASE WHEN event_id % 11 = 0 THEN 'baseline_pattern' ELSE 'point_anomaly' END AS signal_type, count(*) AS n FROM events GROUP BY 1, 2")
def signal_counts(spark, sf_dir):
    return co.signal_counts(signals(spark, sf_dir))


@query("SELECT 'e' || event_id AS signal_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events WHERE event_id IN (3, 7, 100)")
def signal_metadata(spark, sf_dir):
    """Signals by their ids, with fields of their metadata."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("signal_id"), "props")
    found = e.where(F.col("signal_id").isin("e3", "e7", "e100"))
    return found.select("signal_id", co.metadata_field(F.col("props"), "k").alias("k"), co.metadata_field(F.col("props"), "none.here").alias("missing"))
