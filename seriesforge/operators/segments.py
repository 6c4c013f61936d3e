"""Segments: how well a column divides the rows, their creation, and whether each carries a signal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.stats import chi2_sf
from ..functions.text import safe_name
from ..session import kept, spread
from .profile import union_all
from .series import seconds

#: Weights of the parts of a segmentation's score.
WEIGHTS = {"differentiation": 0.40, "balance": 0.25, "coverage": 0.20, "size": 0.15}


def chi2_p(h: Column, df: Column) -> Column:
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, int(b)) if a == a and b >= 1 else None for a, b in zip(x, k)], dtype=float)

    return pandas_udf(tail, "double")(h, df)


def preview(df: DataFrame, seg: str, ts: str, numeric: list[str]) -> DataFrame:
    """Rows, time range, mean and deviation of the first five numbers for each segment."""
    stats = [x for c in numeric[:5] for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))]
    return df.where(F.col(seg).isNotNull()).groupBy(F.col(seg).alias("segment")).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *stats)


def balance(df: DataFrame, seg: str) -> DataFrame:
    """1 - cv / 2 of the segments' sizes, 0 at least."""
    sizes = df.where(F.col(seg).isNotNull()).groupBy(seg).agg(F.count("*").alias("n"))
    return sizes.agg(F.greatest(F.lit(0.0), 1 - F.coalesce(F.stddev_samp("n") / F.avg("n"), F.lit(0.0)) / 2).alias("balance"), F.count("*").alias("n_segments"))


def coverage(df: DataFrame, seg: str, ts: str) -> DataFrame:
    """Mean share of the whole time range that a segment spans."""
    ranges = df.where(F.col(seg).isNotNull()).groupBy(seg).agg(F.min(seconds(F.col(ts))).alias("a"), F.max(seconds(F.col(ts))).alias("b"))
    total = F.max("b") - F.min("a")
    return ranges.agg(F.when(total > 0, F.avg(F.col("b") - F.col("a")) / total).otherwise(1.0).alias("coverage"))


def size_share(df: DataFrame, seg: str, least: int) -> DataFrame:
    sizes = df.where(F.col(seg).isNotNull()).groupBy(seg).agg(F.count("*").alias("n"))
    return sizes.agg(F.avg((F.col("n") >= least).cast("int")).alias("size"))


def kruskal(df: DataFrame, seg: str, cols: list[str]) -> DataFrame:
    """column, h, k, p: Kruskal-Wallis test of each number between segments of two rows or more.

    Ranks come from the counts of distinct values, which are spread by value. Their running count is taken within
    4096 ranges of values and over the ranges' totals, so no task orders all values.
    """
    parts = []
    for c in cols:
        rows = df.where(F.col(seg).isNotNull() & F.col(c).isNotNull()).select(F.col(seg).alias("_g"), F.col(c).cast("double").alias("_v"))
        sizes = rows.groupBy("_g").agg(F.count("*").alias("_n")).where("_n >= 2")
        counts = spread(rows.join(sizes.select("_g"), "_g", "left_semi"), "_v").groupBy("_g", "_v").agg(F.count("*").alias("c"))
        values = counts.groupBy("_v").agg(F.sum("c").alias("t"))
        ends = values.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bins = values.join(F.broadcast(ends)).withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.floor(share * 4096)).otherwise(0)).select("_v", "t", "_bin")  # ends has one row
        bins = spread(bins, "_bin")
        inner = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        before = bins.groupBy("_bin").agg(F.sum("t").alias("_bt")).withColumn("_before", F.coalesce(F.sum("_bt").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ranks = bins.join(before.select("_bin", "_before"), "_bin").withColumn("rank", F.col("_before") + F.coalesce(F.sum("t").over(inner), F.lit(0)) + (F.col("t") + 1) / 2)
        per = counts.join(ranks.select("_v", "rank"), "_v").groupBy("_g").agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("n"))
        ties = values.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
        tot = per.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").cast("double").alias("n"), F.count("*").alias("k")).join(ties)
        raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
        fix = 1 - F.col("ties") / (F.pow("n", F.lit(3)) - F.col("n"))
        parts.append(tot.select(F.lit(c).alias("column"), F.when(fix > 0, raw / fix).alias("h"), "k"))
    return union_all(parts)


def score(df: DataFrame, seg: str, ts: str, numeric: list[str], least: int = 50) -> DataFrame:
    """One row: the four parts and the weighted score of segmenting by a column; no row for fewer than two segments."""
    tested = kruskal(df, seg, numeric).withColumn("p", chi2_p(F.coalesce("h", F.lit(0.0)), F.col("k") - 1))
    diff = tested.agg(F.coalesce(F.avg((F.coalesce("p", F.lit(1.0)) < 0.05).cast("int")), F.lit(0.0)).alias("differentiation"))
    out = diff.join(balance(df, seg)).join(coverage(df, seg, ts)).join(size_share(df, seg, least))  # one row each
    total = sum(F.col(k) * w for k, w in WEIGHTS.items())
    return out.where("n_segments >= 2").select(F.lit(seg).alias("column"), "n_segments", *WEIGHTS, total.alias("score"))


def rank(df: DataFrame, candidates: list[str], ts: str, numeric: list[str], least: int = 50) -> DataFrame:
    """All candidates' scores with their rank."""
    scored = union_all([score(df, c, ts, [n for n in numeric if n != c], least) for c in candidates])
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "column")))


def interaction(df: DataFrame, a: str, b: str, col: str) -> DataFrame:
    """Variance left by the cells of a x b over that left by the sum of both effects; below 0.9 they interact.

    Both come from the number, mean and spread of the values of each cell, so no rows are gathered by a or b.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(col).isNotNull())
    x = F.col(col).cast("double")
    cells = kept(rows.groupBy(a, b).agg(F.count("*").alias("_n"), F.avg(x).alias("_m"), (F.var_pop(x) * F.count("*")).alias("_s")))
    mean = lambda *k: cells.groupBy(*k).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_m_" + "".join(k)))
    cells = cells.join(mean(a), a).join(mean(b), b).join(F.broadcast(mean()))  # mean(): one row
    cells = cells.withColumn("_off", F.col("_m") - (F.col(f"_m_{a}") + F.col(f"_m_{b}") - F.col("_m_")))
    # Within a cell both remainders spread as the values do; those of the sum of effects are off by a constant besides.
    sums = cells.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum(F.col("_n") * F.col("_off") * F.col("_off")).alias("o2"), F.sum(F.col("_n") * F.col("_off")).alias("o"))
    var = lambda s: F.when(F.col("n") > 1, s / (F.col("n") - 1))
    out = sums.select(var(F.col("s")).alias("cross_var"), var(F.col("s") + F.greatest(F.lit(0.0), F.col("o2") - F.col("o") * F.col("o") / F.col("n"))).alias("additive_var"))
    return out.withColumn("ratio", F.col("cross_var") / F.nullif("additive_var", F.lit(0.0))).withColumn("interacts", F.col("ratio") < 0.9)


def extremes(df: DataFrame, seg: str, col: str) -> DataFrame:
    """The segments of the largest and smallest mean, if the ratio is over 1.5."""
    means = df.where(F.col(seg).isNotNull()).groupBy(F.col(seg).alias("s")).agg(F.avg(col).alias("m"))
    out = means.agg(F.max_by("s", F.struct("m", "s")).alias("high"), F.min_by("s", F.struct("m", "s")).alias("low"), (F.max("m") / F.nullif(F.min("m"), F.lit(0.0))).alias("ratio"))
    return out.where("ratio > 1.5")


def create(df: DataFrame, by: list[str], least: int = 50, dataset: str = "data", skip: tuple[str, ...] = ("nan", "null", "none", "")) -> DataFrame:
    """Rows with segment (label) and segment_id, for segments of at least ``least`` rows.

    A null part of a label reads null; labels that only differ in what the id leaves out get a
    suffix from the label's hash. Catch-all labels in ``skip`` are left out.
    """
    label = F.concat_ws(" > ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    rows = df.withColumn("segment", label).where(~F.lower(F.trim("segment")).isin(*skip))
    sizes = rows.groupBy("segment").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    plain = safe_name(F.concat(F.lit(f"seg_{dataset}_"), F.col("segment")))
    ids = sizes.withColumn("_plain", plain).withColumn("_same", F.count("*").over(Window.partitionBy("_plain")))
    ids = ids.withColumn("segment_id", F.when(F.col("_same") > 1, F.concat_ws("_", "_plain", F.substring(F.sha2("segment", 256), 1, 8))).otherwise(F.col("_plain")))
    return rows.join(ids.select("segment", "segment_id"), "segment")


def listing(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment_id", "segment").agg(F.count("*").alias("n"))


#: Least mean daily rows, share of days (%), years and active days of each tier.
TIERS = (("HIGH", 10, 50, 2.0, 365), ("MEDIUM", 3, 30, 1.0, 180), ("LOW", 1, 10, 0.5, 90))


def relevance(df: DataFrame, seg: str, ts: str, entities: list[str] | None = None) -> DataFrame:
    """Daily statistics, tier, granularity and confidence of each segment."""
    day = F.to_date(ts)
    rows = df.where(F.col(ts).isNotNull())
    daily = rows.groupBy(F.col(seg).alias("segment"), day.alias("day")).agg(F.count("*").alias("n"))
    whole = rows.agg((F.datediff(F.max(day), F.min(day)) + 1).alias("calendar_days"))
    out = daily.groupBy("segment").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("days_active"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"), F.avg("n").alias("avg_daily"), F.median("n").alias("median_daily"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std_daily"), F.percentile("n", F.array(F.lit(0.1), F.lit(0.9))).alias("_p"),
    )
    out = out.join(F.broadcast(whole)).withColumns({
        "p10": F.col("_p")[0], "p90": F.col("_p")[1], "cv": F.col("std_daily") / F.col("avg_daily"), "day_coverage_pct": F.col("days_active") / F.col("calendar_days") * 100,
        "zero_day_pct": (F.col("span_days") - F.col("days_active")) / F.col("span_days") * 100, "annual_cycles": F.col("span_days") / 365.25,
    }).drop("_p", "calendar_days")
    few = F.lit(False)
    if entities:
        known = rows.groupBy(F.col(seg).alias("segment")).agg(sum((F.count_distinct(e) for e in entities), F.lit(0)).alias("_e"))
        out = out.join(known, "segment")
        few = (F.col("_e") > 0) & (F.col("_e") < 10)
    tier = None
    for name, avg, cover, years, days in TIERS:
        test = (F.col("avg_daily") >= avg) & (F.col("day_coverage_pct") >= cover) & (F.col("annual_cycles") >= years) & (F.col("days_active") >= days)
        tier = F.when(test, name) if tier is None else tier.when(test, name)
    sparse = (F.col("zero_day_pct") > 90) | ((F.col("days_active") < 180) & (F.col("avg_daily") < 1.5))
    grain = F.when(sparse, "monthly").when((F.col("zero_day_pct") > 50) | (F.col("avg_daily") < 3), "weekly").otherwise("daily")
    lost = F.when(F.col("cv") > 2, 0.25).when(F.col("cv") > 1.5, 0.15).when(F.col("cv") > 1, 0.05).otherwise(0.0)
    lost = lost + F.when(F.col("zero_day_pct") > 50, 0.15).when(F.col("zero_day_pct") > 30, 0.05).otherwise(0.0)
    lost = lost + F.when(F.col("days_active") < 365, 0.2).when(F.col("days_active") < 730, 0.1).otherwise(0.0) + F.when(few, 0.1).otherwise(0.0)
    n_warn = (F.col("avg_daily") < 5).cast("int") + (F.col("zero_day_pct") > 50).cast("int") + (F.col("cv") > 1.5).cast("int") + (F.col("annual_cycles") < 2).cast("int") + (F.col("annual_cycles") < 1).cast("int")
    out = out.withColumns({"tier": tier.otherwise("INSUFFICIENT"), "granularity": grain, "confidence": F.greatest(F.lit(0.0), 1 - lost), "n_warnings": n_warn})
    return out.drop("_e") if entities else out
