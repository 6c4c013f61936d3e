"""Correlations between signals of different sources, and the insights they form.

Signals: signal_id, source_id, signal_type, column_name, severity, ts_start, ts_end, magnitude,
confidence, latitude, longitude, entity_values (map), persistence. A pair's source_a is less than
its source_b.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import fixed
from ..functions.stats import pearson_p
from ..session import kept, spread
from .series import daily_magnitude, seconds

BASELINE = "baseline_pattern"
KM = 6371.0
#: Worth of severities, and weights of the parts of an insight's actionability.
SEVERITY = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
ACTION = (0.25, 0.30, 0.25, 0.20)
COLUMNS = ("signal_a_id", "signal_b_id", "source_a_id", "source_b_id", "correlation_type", "strength", "lag_periods", "spatial_distance_km", "confidence")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _sided(df: DataFrame, side: str, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in cols])


def _result(df: DataFrame, kind: str, strength: Column, confidence: Column, lag=None, distance=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.col("signal_id_a").alias("signal_a_id"), F.col("signal_id_b").alias("signal_b_id"), F.col("source_id_a").alias("source_a_id"), F.col("source_id_b").alias("source_b_id"), F.lit(kind).alias("correlation_type"),
        fixed(strength, 4).alias("strength"), (none if lag is None else lag).cast("int").alias("lag_periods"), (none if distance is None else fixed(distance, 2)).cast("double").alias("spatial_distance_km"), fixed(confidence, 4).alias("confidence"),
    )


def _or_half(c: Column) -> Column:
    """A null or zero confidence counts a half."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, 0.5).otherwise(c)


def co_occurrence(signals: DataFrame, window_s: float, least: float = 0.3) -> DataFrame:
    """Pairs whose times lie within ``window_s`` seconds.

    A band join: each signal stands in the bins that its time, widened by the window, touches; the pair is kept in the
    first bin they share. A signal too unsure to reach ``least`` without an overlap stands in fewer: the overlap has
    some share of its time, so the middle of the overlap is half of that from both ends, and signals that can never
    reach it are left out.
    """
    rows = signals.where((F.col("signal_type") != BASELINE) & F.col("ts_start").isNotNull())
    rows = rows.withColumns({"_s": seconds(F.col("ts_start")), "_e": F.coalesce(seconds(F.col("ts_end")), seconds(F.col("ts_start"))), "_c": _or_half(F.col("confidence"))})
    floor = least - 1e-4  # confidence is rounded to 4 places
    need = F.nanvl(F.when(F.col("_c") > 0, floor / F.col("_c") - 1).otherwise(-1.0), F.lit(-1.0))
    rows = rows.withColumn("_need", need).where("_need <= 1")
    half = F.col("_need") * (F.col("_e") - F.col("_s")) / 2
    span = lambda w: (F.when(F.col("_need") > 0, F.col("_s") + half).otherwise(F.col("_s") - w), F.when(F.col("_need") > 0, F.col("_e") - half).otherwise(F.col("_e") + w))
    width = max(rows.agg(F.avg(F.abs(span(window_s)[1] - span(window_s)[0]))).first()[0] or 0.0, 1.0)
    cols = ["signal_id", "source_id", "_s", "_e", "_c", "_first"]

    def side(name: str, w: float) -> DataFrame:
        lo, hi = (F.floor(f(*span(w)) / width).cast("long") for f in (F.least, F.greatest))
        one = rows.withColumns({"_first": lo, "bin": F.explode(F.sequence(lo, hi))})
        return spread(one.select(*[F.col(c).alias(f"{c}_{name}") for c in cols], "bin"), "bin")

    pairs = side("a", window_s).join(side("b", 0.0).hint("merge"), "bin").where((F.col("source_id_a") < F.col("source_id_b")) & (F.col("bin") == F.greatest("_first_a", "_first_b")))
    gap = F.greatest(F.lit(0.0), F.col("_s_b") - F.col("_e_a"), F.col("_s_a") - F.col("_e_b"))
    overlap = F.greatest(F.lit(0.0), F.least("_e_a", "_e_b") - F.greatest("_s_a", "_s_b"))
    share = overlap / F.greatest(F.col("_e_a") - F.col("_s_a"), F.col("_e_b") - F.col("_s_b"), F.lit(1.0))
    sure = F.least(F.lit(1.0), (0.5 + share * 0.5) * F.least("_c_a", "_c_b") / 0.5)
    return _result(pairs.where((gap <= window_s) & (sure >= floor)), "temporal_co_occurrence", share, sure).where(F.col("confidence") >= least)


#: Signals of one place and source that are compared with others at once.
PLACE_ROWS = 1024


def spatial_alignment(signals: DataFrame, radius_km: float, least: float = 0.3) -> DataFrame:
    """Pairs within a distance, found through grid cells of that size and their neighbours.

    Signals of one place and source go together, up to about ``PLACE_ROWS``, so a distance is taken once for all of them.
    """
    rows = signals.where((F.col("signal_type") != BASELINE) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("signal_id", "source_id", "latitude", "longitude")
    place = ["source_id", "latitude", "longitude"]
    many = rows.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > PLACE_ROWS)
    part = F.coalesce(F.pmod(F.xxhash64("signal_id"), F.ceil(F.col("_n") / PLACE_ROWS)), F.lit(0))
    rows = rows.join(F.broadcast(many), place, "left").groupBy(*place, part.alias("_part")).agg(F.collect_list("signal_id").alias("signal_ids"))  # many: under a row for each PLACE_ROWS rows
    step = radius_km / 111.19  # degrees of latitude
    rows = rows.withColumn("_cy", F.floor(F.col("latitude") / step).cast("long"))
    # Longitude cells of a row are as wide as the radius reaches at the row's edge next to the pole; round the pole there is one.
    top = lambda cy: F.radians(F.least(F.lit(90.0), F.greatest(F.abs(cy * step), F.abs((cy + 1) * step)) + step))
    reach = lambda cy: math.sin(math.radians(step)) / F.greatest(F.cos(top(cy)), F.lit(1e-9))
    cols = ["signal_ids", "source_id", "latitude", "longitude", "_cy"]
    a = _sided(rows, "a", cols).withColumn("cy", F.explode(F.array(*[F.col("_cy_a") + d for d in (-1, 0, 1)])))
    wide = lambda cy: F.when(reach(cy) < 1, F.degrees(F.asin(F.least(F.lit(1.0), reach(cy))))).otherwise(360.0)
    cells = lambda cy: F.greatest(F.lit(1), F.floor(360 / wide(cy)).cast("long"))
    at = lambda lon, cy: F.pmod(F.floor((lon + 180) / (360 / cells(cy))).cast("long"), cells(cy))
    a = a.withColumn("cx", F.explode(F.array_distinct(F.array(*[F.pmod(at(F.col("longitude_a"), F.col("cy")) + d, cells(F.col("cy"))) for d in (-1, 0, 1)]))))
    b = _sided(rows, "b", cols).withColumn("cy", F.col("_cy_b")).withColumn("cx", at(F.col("longitude_b"), F.col("cy")))
    pairs = spread(a, "cy", "cx").join(spread(b, "cy", "cx").hint("merge"), ["cy", "cx"]).where(F.col("source_id_a") < F.col("source_id_b"))
    pairs = pairs.withColumn("_d", haversine(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))).where(F.col("_d") <= radius_km)
    close = F.greatest(F.lit(0.0), 1 - F.col("_d") / radius_km)
    of = {"signal_id_a": F.col("signal_ids_a"), "signal_id_b": F.col("signal_ids_b")}
    found = _result(pairs.withColumns(of), "spatial_alignment", close, close * 0.5 + 0.5, distance=F.col("_d")).where(F.col("confidence") >= least)
    for c in ("signal_a_id", "signal_b_id"):
        found = found.withColumn(c, F.explode(c))
    return found


#: Signatures of a signal among those of its number of entries, at most.
SIGNATURES = 64


def _subsets(n: int, least: float) -> tuple[int, list[tuple[int, ...]]]:
    """Of pairs whose larger signal has n entries: the number that must agree, and which of the first entries of each
    in a common order to take together, so that two signals that agree on so many share such a set.

    Signals that agree on m entries share k of the first u - m + k of the u of each; k is as large as ``SIGNATURES`` allows.
    """
    must = max(1, math.ceil((least - 1e-4) * n))
    if must > n:
        return must, []
    k = next(k for k in range(must, 0, -1) if k == 1 or math.comb(n - must + k, k) <= SIGNATURES)
    return must, list(combinations(range(n - must + k), k))


def entity_alignment(signals: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs that agree on entities: agreeing entries over the larger number of entries.

    Signals are found through sets of entries, rare ones first, that those which agree on enough have in common
    (``_subsets``); the pair is kept at the least set they share, and its entries are compared.
    """
    rows = signals.where(F.size("entity_values") > 0).select("signal_id", "source_id", F.size("entity_values").alias("_n"), F.filter(F.map_entries("entity_values"), lambda x: x["value"].isNotNull()).alias("_v"))
    sizes = sorted(r[0] for r in rows.select("_n").distinct().collect())  # the different numbers of entries
    sets = {n: _subsets(n, least) for n in sizes}
    rows = rows.withColumn("_v", F.sort_array("_v"))
    if any(c and len(c[-1]) < must for must, c in sets.values()):  # the order matters
        flat = rows.select("signal_id", "source_id", "_n", F.explode("_v").alias("x"))
        often = flat.groupBy("x").agg(F.count("*").alias("_f"))
        ranked = flat.join(often, "x").groupBy("signal_id", "source_id", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "x"))).alias("_v"))
        rows = ranked.withColumn("_v", F.transform("_v", lambda y: y["x"]))
    keys = F.array()
    for n, (must, combos) in sets.items():
        k = len(combos[0]) if combos else 0
        fits = (F.col("_n") <= n) & (F.size("_v") >= must)
        mine = F.array(*[F.when(F.size("_v") - must + k > c[-1], F.xxhash64(F.lit(n), *[F.get("_v", F.lit(i)) for i in c])) for c in combos])
        keys = F.concat(keys, F.when(fits, F.transform(F.filter(mine, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(n).alias("n"), x.alias("h")))).otherwise(F.array())) if combos else keys
    rows = rows.withColumn("_keys", keys.cast("array<struct<n:int,h:bigint>>"))
    cols = ["signal_id", "source_id", "_n", "_v", "_keys"]
    a, b = (spread(_sided(rows, s, cols).withColumn("key", F.explode(f"_keys_{s}")), "key") for s in "ab")
    first = F.array_min(F.array_intersect(F.filter("_keys_a", lambda x: x["n"] == F.col("key.n")), F.filter("_keys_b", lambda x: x["n"] == F.col("key.n"))))
    pairs = a.join(b.hint("merge"), "key").where((F.col("source_id_a") < F.col("source_id_b")) & (F.greatest("_n_a", "_n_b") == F.col("key.n")) & (first == F.col("key")))
    share = F.size(F.array_intersect("_v_a", "_v_b")) / F.greatest("_n_a", "_n_b")
    return _result(pairs.where(share > 0), "entity_alignment", share, share).where(F.col("confidence") >= least)


def pattern_similarity(patterns: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of baselines with a seasonality of one label. ``patterns``: signal_id, source_id, period_label, strength, peak_phase."""
    cols = ["signal_id", "source_id", "strength", "peak_phase"]
    a, b = (patterns.select("period_label", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for s in "ab")
    pairs = a.join(b, "period_label").where(F.col("source_id_a") < F.col("source_id_b"))
    alike = (1 - F.abs(F.col("strength_a") - F.col("strength_b"))) * 0.4 + F.when(F.col("peak_phase_a").eqNullSafe(F.col("peak_phase_b")), 1.0).otherwise(0.3) * 0.6
    return _result(pairs, "pattern_similarity", alike, alike).where(F.col("confidence") >= least)


def _p_value(r: Column, n: Column) -> Column:
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([pearson_p(a, int(b)) if a == a and a is not None else 1.0 for a, b in zip(x, k)], dtype=float)

    return pandas_udf(tail, "double")(r, n)


def lag_scan(series: DataFrame, lag_max: int) -> DataFrame:
    """source_a, source_b, lag, n, r for daily series (source_id, period, value): lag > 0 pairs a's later day with b's earlier one.

    Lags reach min(lag_max, a third of the common days); at least 10 common days and 5 pairs.
    """
    a, b = (series.select(F.col("source_id").alias(f"source_{s}"), F.to_date("period").alias(f"day_{s}"), F.col("value").cast("double").alias(f"v_{s}")) for s in "ab")
    common = a.join(b, F.col("day_a") == F.col("day_b")).where("source_a < source_b").groupBy("source_a", "source_b").agg(F.count("*").alias("common"), F.min("day_a").alias("_lo"), F.max("day_a").alias("_hi")).where("common >= 10")
    most = F.least(F.lit(lag_max), F.floor(F.col("common") / 3).cast("int"))
    lags = common.withColumn("lag", F.explode(F.sequence(-most, most)))
    pairs = lags.join(a, "source_a").where(F.col("day_a").between(F.col("_lo"), F.col("_hi"))).withColumn("day_b", F.date_sub("day_a", F.col("lag"))).where(F.col("day_b").between(F.col("_lo"), F.col("_hi")))
    return pairs.join(b, ["source_b", "day_b"]).groupBy("source_a", "source_b", "lag").agg(F.count("*").alias("n"), F.corr("v_a", "v_b").alias("r")).where("n >= 5")


def lagged_correlation(signals: DataFrame, lag_max: int = 14, least: float = 0.3) -> DataFrame:
    """The strongest lag of each pair of sources with p < 0.1; sources need three signals."""
    rows = signals.where((F.col("signal_type") != BASELINE) & F.col("ts_start").isNotNull())
    enough = rows.groupBy("source_id").agg(F.count("*").alias("_n"), F.min("signal_id").alias("_sig")).where("_n >= 3")
    daily = daily_magnitude(rows.join(enough.select("source_id"), "source_id", "left_semi"), "ts_start", "magnitude", ["source_id"]).withColumnRenamed("sum_magnitude_abs", "value")
    scanned = lag_scan(daily, lag_max).where("r is not null").withColumn("p", _p_value(F.col("r"), F.col("n"))).where("p < 0.1")
    best = Window.partitionBy("source_a", "source_b").orderBy(F.desc(F.abs("r")), F.abs("lag"), "lag")
    top = scanned.withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    ids = enough.select(F.col("source_id").alias("_s"), "_sig")
    top = top.join(ids.select(F.col("_s").alias("source_a"), F.col("_sig").alias("signal_id_a")), "source_a").join(ids.select(F.col("_s").alias("source_b"), F.col("_sig").alias("signal_id_b")), "source_b")
    top = top.withColumnsRenamed({"source_a": "source_id_a", "source_b": "source_id_b"})
    return _result(top, "lagged_correlation", F.abs("r"), F.abs("r"), lag=F.col("lag")).where(F.col("confidence") >= least)


#: Nodes that a task remembers of the edges it thins out.
FOREST_NODES = 1_000_000


def _forest(batches):
    """The edges of Arrow batches that join what those before them do not, the first loop of each node, and all with a null."""
    ids: dict = {}
    root: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        if len(ids) > FOREST_NODES:
            ids, root = {}, []
        n = batch.num_rows
        codes = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode(null_encoding="encode")
        values = codes.dictionary.to_pylist()
        seen, mine = len(root), np.empty(len(values), np.int64)
        for i, v in enumerate(values):
            mine[i] = ids.setdefault(v, len(root))
            if mine[i] == len(root):
                root.append(len(root))
        roots, at = np.array([find(x) for x in mine], np.int64), codes.indices.to_numpy()
        known = np.array([v is not None for v in values], bool)[at].reshape(2, n).all(0) if n else np.empty(0, bool)
        a, b = roots[at[:n]], roots[at[n:]]
        lone = np.flatnonzero((at[:n] == at[n:]) & (mine[at[:n]] >= seen) & known)
        keep = [*np.flatnonzero(~known), *lone[np.unique(at[lone], return_index=True)[1]]]
        pair = np.flatnonzero((a != b) & known)
        ends = np.stack([np.minimum(a[pair], b[pair]), np.maximum(a[pair], b[pair])], 1)
        for i in pair[np.unique(ends, axis=0, return_index=True)[1]]:
            x, y = find(a[i]), find(b[i])
            if x != y:
                root[max(x, y)] = min(x, y)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(np.sort(np.array(keep, np.int64))))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each reaches over edges (a, b).

    Every task first leaves out edges within what its other edges join, so what is written grows with the nodes.
    Every round points each node's neighbours to the least node around, first the greater ones and then all, and is
    written to the shared folder; the links are those of the components once a round leaves them as they are.
    """
    edges = edges.select("a", "b")
    edges = kept(edges.mapInArrow(_forest, edges.schema))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = kept(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    state = None
    while True:
        around = links.select(F.col("low").alias("n"), F.col("high").alias("m")).unionByName(links.select(F.col("high").alias("n"), F.col("low").alias("m")))
        ends = around.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("end"))
        links = around.where("m > n").join(ends, "n").select(F.col("end").alias("low"), F.col("m").alias("high")).where("low <> high").distinct()
        ends = links.groupBy("high").agg(F.min("low").alias("end"))
        lower = links.join(ends, "high").select(F.col("end").alias("low"), F.col("low").alias("high"))
        links = kept(lower.unionByName(ends.select(F.col("end").alias("low"), "high")).where("low <> high").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == state:
            return nodes.join(links.withColumnRenamed("high", "node"), "node", "left").select("node", F.coalesce("low", "node").alias("component"))
        state = now


def with_ids(correlations: DataFrame) -> DataFrame:
    """correlation_id from the pair and its type, so that runs agree."""
    return correlations.withColumn("correlation_id", F.concat(F.lit("corr_"), F.substring(F.sha2(F.concat_ws("|", "correlation_type", "signal_a_id", "signal_b_id"), 256), 1, 12)))


def insights(correlations: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per component of correlated signals, with scores and actionability."""
    edges = correlations.select(F.col("signal_a_id").alias("a"), F.col("signal_b_id").alias("b"))
    comp = kept(components(edges))
    total = signals.agg(F.greatest(F.count_distinct("source_id"), F.lit(1)).alias("_total"))
    worth = F.when(F.col("severity").isNull(), None)
    for k, v in SEVERITY.items():
        worth = worth.when(F.col("severity") == k, v)
    members = comp.join(signals.withColumn("_worth", worth.otherwise(0.25)), comp.node == signals.signal_id)
    sides = members.groupBy("component").agg(
        F.array_sort(F.collect_set("signal_id")).alias("signal_ids"), F.count_distinct("source_id").alias("n_sources"), F.coalesce(F.avg("_worth"), F.lit(0.25)).alias("mean_severity"),
        F.avg(F.when(F.col("persistence") == "sustained", 1.0).otherwise(0.5)).alias("persistence_score"),
    )
    mean = lambda c: (F.sum(f"_{c}") / F.sum(f"_n_{c}")).alias(f"mean_{c}")
    # Summed by signal first, so that no row for each correlation is shuffled.
    by_signal = correlations.groupBy("signal_a_id").agg(*[x for c in ("confidence", "strength") for x in (F.sum(c).alias(f"_{c}"), F.count(c).alias(f"_n_{c}"))], F.collect_set("correlation_type").alias("_t"), F.count("*").alias("_n"))
    linked = by_signal.join(comp, by_signal.signal_a_id == comp.node).groupBy("component").agg(
        mean("confidence"), mean("strength"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_t")))), ",").alias("correlation_types"), F.sum("_n").alias("n_correlations")
    )
    out = kept(sides.join(linked, "component")).join(F.broadcast(total))
    parts = (F.col("mean_severity"), F.col("n_sources") / F.col("_total"), F.col("mean_confidence"), F.col("persistence_score"))
    out = out.withColumn("actionability", fixed(sum(w * p for w, p in zip(ACTION, parts)), 4)).withColumn("strength", fixed("mean_strength", 4))
    out = out.withColumn("insight_id", F.concat(F.lit("ins_"), F.substring(F.sha2(F.array_join("signal_ids", "|"), 256), 1, 12)))
    strength = F.when(F.col("strength") >= 0.75, "strong").when(F.col("strength") >= 0.5, "moderate").otherwise("weak")
    return out.withColumn("narrative", F.format_string("%s link between %d signals of %d sources", strength, F.size("signal_ids"), F.col("n_sources"))).drop("_total", "mean_strength")


#: The methods, in the order of their results.
METHODS = {"temporal": "temporal_co_occurrence", "lagged": "lagged_correlation", "spatial": "spatial_alignment", "entity": "entity_alignment", "pattern": "pattern_similarity"}


def correlate(signals: DataFrame, window_s: float, lag_max: int = 14, radius_km: float = 50.0, least: float = 0.3, methods: tuple[str, ...] = tuple(METHODS), patterns: DataFrame | None = None) -> DataFrame:
    """All methods' correlations together, with ids. Patterns (see ``pattern_similarity``) are compared if given."""
    return with_ids(correlated(signals, window_s, lag_max, radius_km, least, methods, patterns))


def correlated(signals: DataFrame, window_s: float, lag_max: int = 14, radius_km: float = 50.0, least: float = 0.3, methods: tuple[str, ...] = tuple(METHODS), patterns: DataFrame | None = None) -> DataFrame:
    """``correlate`` without ids, for those who take few of many rows and give ids to these (``with_ids``)."""
    parts = {"temporal": lambda: co_occurrence(signals, window_s, least), "lagged": lambda: lagged_correlation(signals, lag_max, least), "spatial": lambda: spatial_alignment(signals, radius_km, least), "entity": lambda: entity_alignment(signals, least), "pattern": lambda: pattern_similarity(patterns, least)}
    out = None
    for m in methods:
        if m != "pattern" or patterns is not None:
            out = parts[m]() if out is None else out.unionByName(parts[m]())
    return out


def _nth_method() -> Column:
    nth = None
    for n, kind in enumerate(METHODS.values()):
        test = F.col("correlation_type") == kind
        nth = F.when(test, n) if nth is None else nth.when(test, n)
    return nth


def first_correlations(correlations: DataFrame, limit: int = 100) -> DataFrame:
    """The first correlations by method and signals; not the strongest."""
    return correlations.orderBy(_nth_method(), "signal_a_id", "signal_b_id").limit(limit)


def counts_by_type(correlations: DataFrame) -> DataFrame:
    return correlations.groupBy("correlation_type").agg(F.count("*").alias("n"))


#: Words in source names of each domain, and what to do by domains and correlation types.
DOMAINS = (("pos", "pos|transaction|sales|retail"), ("bookings", "book|ticket|visit|experience"), ("digital", "web|search|digital|online"), ("weather", "weather|temp|climate"))
BANDS = ((0.75, "HIGH"), (0.5, "MODERATE"))


def _band(score: Column) -> Column:
    return F.when(score >= BANDS[0][0], BANDS[0][1]).when(score >= BANDS[1][0], BANDS[1][1]).otherwise("LOW")


def _parts(insights_: DataFrame, signals: DataFrame) -> DataFrame:
    """Per insight: domains, sources, severities, columns and signal types of its signals."""
    domain = None
    for name, pattern in DOMAINS:
        test = F.lower("source_id").rlike(pattern)
        domain = F.when(test, name) if domain is None else domain.when(test, name)
    rows = insights_.select("insight_id", F.explode("signal_ids").alias("signal_id")).join(signals, "signal_id").withColumn("_d", domain)
    as_set = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("insight_id").agg(as_set("_d").alias("domains"), as_set("source_id").alias("sources"), as_set("severity").alias("severities"), as_set("column_name").alias("columns"), as_set("signal_type").alias("signal_types"))


def suggest(insights_: DataFrame, signals: DataFrame, most: int = 5) -> DataFrame:
    """insight_id, actions (at most five), reasoning and summary of each insight."""
    df = insights_.select("insight_id", "correlation_types", "actionability", "strength", F.size("signal_ids").alias("n_signals")).join(_parts(insights_, signals), "insight_id")
    has = lambda d: F.array_contains("domains", d)
    kind = lambda k: F.col("correlation_types").contains(k)
    rules = (
        (has("pos") & has("bookings"), "plan promotions of venues and nearby shops together"),
        (has("pos") & has("bookings"), "forecast shop demand from bookings"),
        (has("bookings"), "test prices that follow the correlated demand"),
        (has("bookings"), "plan staff and stock by the predicted visits"),
        (has("pos"), "time campaigns by the demand pattern"),
        (kind("lagged_correlation"), "use the leading signal as an early warning"),
        (kind("spatial_alignment"), "target the region that the signals share"),
    )
    found = F.filter(F.array(*[F.when(test, text) for test, text in rules]), lambda x: x.isNotNull())
    none = F.array(F.lit("look for the cause of the correlation"), F.lit("watch whether it lasts over the next period"))
    actions = F.slice(F.when(F.size(found) > 0, found).otherwise(none), 1, most)
    n = F.size("sources")
    reasons = F.array(
        F.when(n >= 3, F.format_string("spans %d sources", n)).when(n == 2, F.lit("spans 2 sources")), F.when(F.array_contains("severities", "critical"), "has critical signals").when(F.array_contains("severities", "high"), "has signals of high severity"),
        F.when(kind("lagged_correlation"), "has a lagged relation"), F.concat(F.lit("overall "), _band(F.col("actionability"))),
    )
    summary = F.format_string("%d signals of %d sources (%s); strength %.2f; %s actionability", "n_signals", n, F.array_join("sources", ", "), "strength", _band(F.col("actionability")))
    return df.select("insight_id", actions.alias("actions"), F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "; ").alias("reasoning"), summary.alias("summary"))


def paths(insight: DataFrame, correlations: DataFrame, signals: DataFrame) -> DataFrame:
    """insight_id, path: the links of each insight as text, in the order of their signals."""
    ids = insight.select("insight_id", F.explode("signal_ids").alias("signal_a_id"))
    name = lambda s: signals.select(F.col("signal_id").alias(f"signal_{s}_id"), F.format_string("%s (%s)", "column_name", "source_id").alias(f"_{s}"))
    links = ids.join(correlations, "signal_a_id").join(name("a"), "signal_a_id").join(name("b"), "signal_b_id")
    lag = F.when(F.coalesce("lag_periods", F.lit(0)) != 0, F.format_string(", lag %d", "lag_periods")).otherwise("")
    text = F.concat(F.col("_a"), F.format_string(" -> [%s, %.2f", "correlation_type", "strength"), lag, F.lit("] -> "), F.col("_b"))
    steps = links.groupBy("insight_id").agg(F.array_sort(F.collect_list(F.struct("signal_a_id", "signal_b_id", "correlation_type", text.alias("step")))).alias("_s"))
    return steps.select("insight_id", F.array_join(F.transform("_s", lambda x: x["step"]), " | ").alias("path"))


def explain(insight: DataFrame, correlations: DataFrame) -> DataFrame:
    """weakest link, confidence block and other explanations of each insight."""
    ids = insight.select("insight_id", "n_sources", F.size("signal_ids").alias("n_signals"), F.explode("signal_ids").alias("signal_a_id"))
    weakest = lambda s, c: F.min(F.struct(F.col(s).isNull().alias("none"), F.col(s).alias("strength"), F.col(c).alias("id")))
    # By signal first, so that no row for each correlation is shuffled.
    by_signal = correlations.groupBy("signal_a_id").agg(weakest("strength", "correlation_id").alias("_w"), F.count("*").alias("_n"), F.collect_set("correlation_type").alias("_t"))
    links = ids.join(by_signal, "signal_a_id").select("*", "_w.*")
    out = links.groupBy("insight_id", "n_sources", "n_signals").agg(weakest("strength", "id").alias("_w"), F.sum("_n").alias("n_links"), F.array_distinct(F.flatten(F.collect_set("_t"))).alias("_kinds"))
    out = out.select("insight_id", "n_sources", "n_signals", F.col("_w.strength").alias("weakest_strength"), F.col("_w.id").alias("weakest_id"), "n_links", "_kinds")
    sure = F.when((F.col("n_signals") >= 5) & (F.col("n_sources") >= 3), "strong").when((F.col("n_signals") >= 3) & (F.col("n_sources") >= 2), "moderate").otherwise("weak")
    kind = lambda k: F.array_contains("_kinds", k)
    other = F.array(F.lit("a driver that all sources share"), F.lit("a change in how data are captured"), F.when(kind(METHODS["temporal"]) & ~kind(METHODS["lagged"]), "a coincidence in time"), F.when(kind(METHODS["spatial"]), "a population that the places share"))
    return out.withColumn("assessment", sure).withColumn("other_explanations", F.array_join(F.filter(other, lambda x: x.isNotNull()), "; ")).drop("_kinds")


def query_signals(signals: DataFrame, sources: list[str] | None = None, types: list[str] | None = None, severities: list[str] | None = None, since=None, until=None) -> DataFrame:
    """Signals by any of the filters; an open end (null ts_end) is never too late."""
    out = signals
    for col, values in (("source_id", sources), ("signal_type", types), ("severity", severities)):
        out = out.where(F.col(col).isin(*values)) if values else out
    out = out.where(F.col("ts_start") >= F.lit(since)) if since is not None else out
    out = out.where((F.col("ts_end") <= F.lit(until)) | F.col("ts_end").isNull()) if until is not None else out
    return out.orderBy("ts_start", "signal_id")


def query_insights(insights_: DataFrame, signals: DataFrame, least_action: float = 0.0, least_strength: float = 0.0, sources: list[str] | None = None, sort: str = "actionability", limit: int = 20) -> DataFrame:
    """Insights above both scores that touch the sources, best first; the source filter comes before the limit."""
    if sort not in ("actionability", "strength"):
        raise ValueError(f"cannot sort by {sort}")
    out = insights_.where((F.col("actionability") >= least_action) & (F.col("strength") >= least_strength))
    if sources:
        wanted = signals.where(F.col("source_id").isin(*sources)).select("signal_id")
        touched = out.select("insight_id", F.explode("signal_ids").alias("signal_id")).join(wanted, "signal_id", "left_semi").select("insight_id").distinct()
        out = out.join(touched, "insight_id", "left_semi")
    return out.orderBy(F.desc(sort), "insight_id").limit(limit)


def source_overview(sources: DataFrame, signals: DataFrame) -> DataFrame:
    """Each source with the number of its signals and the time of the last one."""
    return sources.join(signals, "source_id", "left").groupBy("source_id").agg(F.count("signal_id").alias("n_signals"), F.max("ts_start").alias("last_signal"))


def metadata_field(metadata: Column, name: str) -> Column:
    """A field of the metadata kept as JSON text; null where it is no JSON or lacks the field."""
    return F.get_json_object(metadata, f"$.{name}")


def signal_counts(signals: DataFrame) -> DataFrame:
    """Numbers of signals by source and type."""
    return signals.groupBy("source_id", "signal_type").agg(F.count("*").alias("n"))
