"""Time series: bucketed aggregates with gap filling, frequency, quality, rolling statistics, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, spread

STEPS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}
#: The longest median step (seconds) of each frequency class.
FREQUENCIES = ((1800, "minute"), (7200, "hourly"), (172_800, "daily"), (864_000, "weekly"), (3_888_000, "monthly"), (10_368_000, "quarterly"))
#: Seasonal periods of each frequency class; any other has 7.
SEASONAL_PERIODS = {"minute": (24, 168), "hourly": (24, 168), "daily": (7, 365), "weekly": (52,), "monthly": (12,), "quarterly": (4,)}
#: The period of date_trunc of each frequency class.
UNITS = {"minute": "minute", "hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def seasonal_periods(freq: str) -> tuple[int, ...]:
    return SEASONAL_PERIODS.get(freq, (7,))


def periods_of(freq: Column) -> Column:
    """The seasonal periods of a frequency class, as an array."""
    out = None
    for name, periods in SEASONAL_PERIODS.items():
        value = F.array(*map(F.lit, periods))
        out = F.when(freq == name, value) if out is None else out.when(freq == name, value)
    return out.otherwise(F.array(F.lit(7)))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def metric(agg: str, col: str) -> Column:
    """An aggregate named {agg}_{col}; any aggregate of * counts rows as count_all."""
    if col == "*":
        return F.count("*").alias("count_all")
    f = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "stddev": F.stddev_samp}[agg]
    return f(col).alias(f"{agg}_{col}")


def spine(df: DataFrame, period: str, freq: str, keys: list[str]) -> DataFrame:
    """Every period from the first to the last of each group."""
    ends = df.groupBy(*keys).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {STEPS[freq]}"))).alias(period))


def aggregate(df: DataFrame, ts: str, freq: str, metrics: list[tuple[str, str]], keys: list[str] | None = None, fill: bool = True) -> DataFrame:
    """Metrics by period (date_trunc) and group; with ``fill`` absent periods between a group's first
    and last have 0 in every metric, as avg, min and max do where null."""
    keys = keys or []
    sums = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc(freq, F.col(ts)).alias("period")).agg(*[metric(a, c) for a, c in metrics])
    if not fill:
        return sums
    names = [c for c in sums.columns if c not in (*keys, "period")]
    return spine(sums, "period", freq, keys).join(sums, [*keys, "period"], "left").select(*keys, "period", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def series_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"), F.sum(col).alias("sum"), F.count_if(F.col(col) == 0).alias("zeros"))


def keep_last(df: DataFrame, ts: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """One row per timestamp, the last in ``order``."""
    w = Window.partitionBy(*(keys or []), ts).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def frequency(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """median_step (seconds between distinct times) and frequency of each group; under 3 times unknown."""
    times = df.select(*keys, seconds(F.col(ts)).alias("_s")).where("_s is not null").distinct()
    steps = times.withColumn("_d", F.col("_s") - F.lag("_s").over(Window.partitionBy(*keys).orderBy("_s")))
    out = steps.groupBy(*keys).agg(F.count("*").alias("n_times"), F.median("_d").alias("median_step"))
    label = F.when(F.col("n_times") < 3, "unknown")
    for most, name in FREQUENCIES:
        label = label.when(F.col("median_step") <= most, name)
    return out.withColumn("frequency", label.otherwise("yearly"))


def gaps(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """n, median_step, n_gaps (steps over twice the median), expected and completeness of each group."""
    w = Window.partitionBy(*keys).orderBy("_s")
    steps = df.select(*keys, seconds(F.col(ts)).alias("_s")).where("_s is not null").distinct().withColumn("_d", F.col("_s") - F.lag("_s").over(w))
    med = steps.groupBy(*keys).agg(F.median("_d").alias("median_step"))
    out = steps.join(med, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("median_step").alias("median_step"), F.count_if(F.col("_d") > 2 * F.col("median_step")).alias("n_gaps"), (F.max("_s") - F.min("_s")).alias("_span")
    )
    expected = F.floor(F.col("_span") / F.col("median_step")).cast("long") + 1
    return out.withColumn("expected", F.when(F.col("median_step") > 0, expected)).withColumn("completeness", F.least(F.lit(1.0), F.col("n") / F.col("expected"))).drop("_span")


def rolling_mean(col: str, window: int, w) -> Column:
    """Centred mean of ``window`` values, null where the window is not full."""
    after = (window - 1) // 2
    frame = w.rowsBetween(-(window - 1 - after), after)
    return F.when(F.count(col).over(frame) == window, F.avg(col).over(frame))


def filled(col: Column, w) -> Column:
    """Nulls take the last value before them, leading ones the first of all, which comes after them."""
    before = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one frame, taken once
    return F.coalesce(before, first)


def interpolate(df: DataFrame, col: str, order: str, keys: list[str]) -> DataFrame:
    """Linear in the position between the nearest known values; the ends take the nearest one.

    Within ranges of the order, which know the positions and the known values around them from the ends of the other
    ranges, so no task holds a whole key; frames only look back, as each row of one that looks ahead is a pass.
    """
    own = ["_part", *keys]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, see spread
    parts = spread(df.repartitionByRange(ranges, *keys, order).withColumn("_part", F.spark_partition_id()), *own)
    rows = kept(parts.withColumn("_l", F.row_number().over(Window.partitionBy(*own).orderBy(order))))
    known = lambda at: F.when(F.col(col).isNotNull(), F.struct(at.alias("i"), F.col(col).alias("v")))
    at = F.col("_l").cast("long")
    ends = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.min(known(at)).alias("_first"), F.max(known(at)).alias("_last"))
    back = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_n").over(back), F.lit(0)))
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("_off")).alias("i"), F.col(f"{c}.v").alias("v")))
    ends = ends.withColumns({"_first": moved("_first"), "_last": moved("_last")})
    ends = ends.withColumns({"_before": F.last("_last", True).over(back), "_after": F.last("_first", True).over(ahead)})
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], "_off", "_before", "_after")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own)]
    rows = spread(rows.join(ends, same), *own).withColumn("_i", F.col("_l") + F.col("_off"))
    w = Window.partitionBy(*own)
    look = lambda *o: F.last(known(F.col("_i")), True).over(w.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_p": F.coalesce(look("_l"), "_before"), "_q": F.coalesce(look(F.desc("_l")), "_after")})
    between = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / (F.col("_q.i") - F.col("_p.i"))
    value = F.when(F.col(col).isNotNull(), F.col(col)).when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), between).otherwise(F.coalesce("_p.v", "_q.v"))
    return rows.select(*df.columns, value.alias(f"{col}_filled"))


def severity(z: Column) -> Column:
    return F.when(z >= 4, "critical").when(z >= 3, "high").when(z >= 2.5, "medium").otherwise("low")


def magnitude_severity(ratio: Column) -> Column:
    return F.when(ratio >= 3, "critical").when(ratio >= 2, "high").when(ratio >= 1, "medium").otherwise("low")


SENSITIVITY = {"low": 3.0, "medium": 2.5, "high": 2.0}


def zscores(df: DataFrame, col: str, order: str, keys: list[str], window: int, sensitivity: str = "medium") -> DataFrame:
    """Points whose distance from the filled centred rolling mean is over the threshold, in residual
    (population) standard deviations."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_m", rolling_mean(col, window, w)).withColumn("expected", filled(F.col("_m"), w))
    df = df.withColumn("residual", F.col(col) - F.col("expected"))
    df = df.withColumn("_std", F.stddev_pop("residual").over(Window.partitionBy(*keys)))
    df = df.withColumn("z_score", F.when(F.col("_std") > 0, F.abs("residual") / F.col("_std")))
    return df.where(F.col("z_score") > SENSITIVITY[sensitivity]).withColumn("severity", severity(F.col("z_score"))).drop("_m", "_std")


def most_severe(df: DataFrame, keys: list[str], severity_col: str, seq: str) -> DataFrame:
    """One deviation for each key, the most severe; the first in ``seq`` on a tie."""
    rank = F.when(F.col(severity_col) == "critical", 0).when(F.col(severity_col) == "high", 1).when(F.col(severity_col) == "medium", 2).otherwise(3)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, seq))).where("_rn = 1").drop("_rn")


def lookback(df: DataFrame, ts: str, days: int, keys: list[str]) -> DataFrame:
    """Rows of the last ``days`` before each group's latest time."""
    last = F.max(ts).over(Window.partitionBy(*keys))
    return df.withColumn("_last", last).where(F.col(ts) >= F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def window_rows(df: DataFrame, ts: str, keys: list[str], days: float | None = None, baseline_end=None, share: float = 0.2) -> DataFrame:
    """The rows to look at: those of the last ``days`` of each group, or else those after the baseline's end; a group
    that has none after it gives the last ``share`` of its rows."""
    if days:
        last = F.max(ts).over(Window.partitionBy(*keys))
        return df.withColumn("_last", last).where(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(F.col("_last").cast("timestamp")) - F.lit(int(days * 86_400_000_000))).drop("_last")
    later = F.col(ts) > F.lit(baseline_end)
    w = Window.partitionBy(*keys)
    df = df.withColumns({"_later": later, "_any": F.max(later).over(w), "_i": F.row_number().over(w.orderBy(ts)), "_n": F.count("*").over(w)})
    return df.where(F.when(F.col("_any"), F.col("_later")).otherwise(F.col("_i") > F.floor(F.col("_n") * (1 - share)))).drop("_later", "_any", "_i", "_n")


def tail_rows(df: DataFrame, order: str, keys: list[str], share: float = 0.2) -> DataFrame:
    """The last ``share`` of each group's rows."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return df.where(F.col("_i") > F.floor(F.col("_n") * (1 - share))).drop("_i", "_n")


def trend(df: DataFrame, y: str, order: str, keys: list[str]) -> DataFrame:
    """slope, intercept, slope_stderr and direction of least squares over the row position from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    xy = df.where(F.col(y).isNotNull()).withColumn("_x", (F.row_number().over(w) - 1).cast("double")).withColumn("_y", F.col(y).cast("double"))
    out = xy.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy")
    )
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    out = out.withColumn("slope_stderr", F.when((F.col("n") > 2) & (F.col("_sxx") > 0), F.sqrt(rss / (F.col("n") - 2) / F.col("_sxx"))))
    direction = F.when(F.abs("slope") < 0.5 * F.col("slope_stderr"), "flat").when(F.col("slope") > 0, "up").otherwise("down")
    return out.withColumn("direction", direction).drop("_sxx", "_syy", "_sxy")


def moments(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.count(col).alias("n"), F.stddev_pop(col).alias("std"), F.skewness(col).alias("skewness"), F.kurtosis(col).alias("kurtosis"))


def residual_profile(df: DataFrame, col: str, keys: list[str], least: int = 10) -> DataFrame:
    """n, std, skewness, kurtosis and the kind of distribution of residuals; unknown for fewer than ``least``."""
    out = moments(df, col, keys)
    kind = F.when(F.col("n") < least, "unknown").when((F.abs("skewness") < 0.5) & (F.abs("kurtosis") < 1.0), "normal").when(F.abs("skewness") >= 0.5, "skewed").otherwise("heavy-tailed")
    return out.withColumn("distribution", kind)


def autocorrelation(df: DataFrame, col: str, order: str, keys: list[str], least: int = 31) -> DataFrame:
    """Lag-1 correlation of series with at least ``least`` values."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("_b", F.lag(col).over(w))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(F.col(col).cast("double"), F.col("_b").cast("double")).alias("r"))
    return out.withColumn("autocorr", F.when(F.col("n") >= least, F.col("r"))).drop("r")


def resample(df: DataFrame, ts: str, freq: str, cols: list[str], keys: list[str]) -> DataFrame:
    """Sums by period with empty periods 0, only for groups of more than twice as many rows as periods;
    the others keep their rows, labelled by their own time."""
    period = F.date_trunc(freq, F.col(ts))
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(period).alias("_a"), F.max(period).alias("_b"))
    span = {"hour": 3600, "day": 86400, "week": 604_800, "month": 2_629_746}[freq]
    dense = F.col("_n") > 2 * (F.floor((seconds(F.col("_b")) - seconds(F.col("_a"))) / span) + 1)
    marked = df.join(size.select(*keys, dense.alias("_dense")), keys)
    sums = aggregate(marked.where("_dense"), ts, freq, [("sum", c) for c in cols], keys)
    rest = marked.where("not _dense").select(*keys, F.col(ts).alias("period"), *[F.col(c).cast("double").alias(f"sum_{c}") for c in cols])
    return sums.unionByName(rest)


def daily_magnitude(df: DataFrame, ts: str, magnitude: str, keys: list[str]) -> DataFrame:
    """Sum of absolute magnitudes by day, 0 where there is none; a magnitude of 0 or null counts 1."""
    size = F.abs(F.when(F.coalesce(F.col(magnitude), F.lit(0)) == 0, 1.0).otherwise(F.col(magnitude)))
    return aggregate(df.withColumn("magnitude_abs", size), ts, "day", [("sum", "magnitude_abs")], keys)


def seasonal_profile(df: DataFrame, ts: str, col: str, keys: list[str], part: str = "weekday") -> DataFrame:
    """Mean by weekday (Monday 0), month or hour, with the peak phase of each group."""
    phase = {"weekday": F.weekday, "month": F.month, "hour": F.hour}[part](F.col(ts))
    means = df.groupBy(*keys, phase.alias("phase")).agg(F.avg(col).alias("phase_mean"))
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc("phase_mean"), "phase")) == 1
    return means.withColumn("is_peak", best)


def seasonal_vector(df: DataFrame, ts: str, col: str, keys: list[str], part: str = "weekday") -> DataFrame:
    """Array of the means by phase, 0 where there is none (7, 12 or 24 long)."""
    first, last = {"weekday": (0, 6), "month": (1, 12), "hour": (0, 23)}[part]
    means = seasonal_profile(df, ts, col, keys, part).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("phase", "phase_mean"))).alias("_m"))
    return means.select(*keys, F.transform(F.sequence(F.lit(first), F.lit(last)), lambda p: F.coalesce(F.try_element_at("_m", p), F.lit(0.0))).alias("seasonal"))


def variance_explained(df: DataFrame, value: str, residual: str, keys: list[str]) -> DataFrame:
    """1 - var(residual) / var(value), sample variances, between 0 and 1."""
    out = df.groupBy(*keys).agg(F.var_samp(value).alias("_v"), F.var_samp(residual).alias("_r"))
    return out.withColumn("variance_explained", F.when(F.col("_v") > 0, F.greatest(F.lit(0.0), 1 - F.col("_r") / F.col("_v")))).drop("_v", "_r")
