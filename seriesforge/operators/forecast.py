"""Linear forecasts with widening intervals, scenarios and backtests."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import trend


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def linear_forecast(df: DataFrame, y: str, order: str, keys: list[str], horizon: int, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """step, point and lower/upper of each level; the half width is z * sigma * sqrt(step), with
    sigma the population deviation of the residuals. trustworthy: the first level's interval is at most half of
    the series' mean in width."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.where(F.col(y).isNotNull()).withColumn("_x", F.row_number().over(w) - 1)
    fit = trend(df, y, order, keys).select(*keys, "n", "slope", "intercept")
    res = rows.join(fit, keys).withColumn("_r", F.col(y) - F.col("intercept") - F.col("slope") * F.col("_x"))
    fit = fit.join(res.groupBy(*keys).agg(F.stddev_pop("_r").alias("_sigma"), F.avg(y).alias("_mean")), keys)
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = out.withColumn("point", F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    for level in levels:
        half = z_value(level) * F.col("_sigma") * F.sqrt(F.col("step").cast("double"))
        tag = round(level * 100)
        out = out.withColumn(f"lower_{tag}", F.col("point") - half).withColumn(f"upper_{tag}", F.col("point") + half)
    tag = round(levels[0] * 100)
    out = out.withColumn("trustworthy", (F.col(f"upper_{tag}") - F.col(f"lower_{tag}")) <= 0.5 * F.abs("_mean"))
    return out.drop("n", "slope", "intercept", "_sigma", "_mean")


def seasonal_forecast(df: DataFrame, y: str, order: str, keys: list[str], horizon: int, period: int, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """The linear forecast with the mean residual of each phase of the season added; intervals by what is left."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.where(F.col(y).isNotNull()).withColumn("_x", F.row_number().over(w) - 1)
    fit = trend(df, y, order, keys).select(*keys, "n", "slope", "intercept")
    res = rows.join(fit, keys).withColumn("_r", F.col(y) - F.col("intercept") - F.col("slope") * F.col("_x")).withColumn("_phase", F.col("_x") % period)
    phase = res.groupBy(*keys, "_phase").agg(F.avg("_r").alias("_s"))
    left = res.join(phase, [*keys, "_phase"]).groupBy(*keys).agg(F.stddev_pop(F.col("_r") - F.col("_s")).alias("_sigma"), F.avg(y).alias("_mean"))
    out = fit.join(left, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_phase", (F.col("n") - 1 + F.col("step")) % period)
    out = out.join(phase, [*keys, "_phase"], "left")
    out = out.withColumn("point", F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")) + F.coalesce("_s", F.lit(0.0)))
    for level in levels:
        half, tag = z_value(level) * F.col("_sigma") * F.sqrt(F.col("step").cast("double")), round(level * 100)
        out = out.withColumn(f"lower_{tag}", F.col("point") - half).withColumn(f"upper_{tag}", F.col("point") + half)
    tag = round(levels[0] * 100)
    out = out.withColumn("trustworthy", (F.col(f"upper_{tag}") - F.col(f"lower_{tag}")) <= 0.5 * F.abs("_mean"))
    return out.drop("n", "slope", "intercept", "_phase", "_s", "_sigma", "_mean")


def project(df: DataFrame, y: str, order: str, keys: list[str], horizon: int, method: str = "auto", period: int | None = None, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """A forecast by the method named: linear, or seasonal, which auto takes where a period is given."""
    if method not in ("auto", "linear", "seasonal"):
        raise ValueError(f"unknown method {method}")
    if method == "linear" or not period:
        return linear_forecast(df, y, order, keys, horizon, levels)
    return seasonal_forecast(df, y, order, keys, horizon, period, levels)


def recent_scenario(df: DataFrame, y: str, order: str, keys: list[str]) -> DataFrame:
    """Slope of the last max(n // 5, 10) values beside the whole series' slope; differs: by a tenth or more."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(y).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    recent = rows.where(F.col("_i") > F.col("_n") - F.greatest(F.floor(F.col("_n") / 5), F.lit(10)))
    a = trend(df, y, order, keys).select(*keys, F.col("slope").alias("baseline_slope"))
    b = trend(recent, y, order, keys).select(*keys, F.col("n").alias("recent_n"), F.col("slope").alias("recent_slope"))
    return a.join(b, keys).withColumn("differs", F.abs(F.col("recent_slope") - F.col("baseline_slope")) >= 0.1 * F.abs("baseline_slope"))


def backtest(df: DataFrame, y: str, order: str, keys: list[str], horizon: int, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """mape, coverage by level and trustworthy_steps (before the first error over a quarter) of a forecast
    of the last ``horizon`` values from those before them."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(y).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    train = rows.where(F.col("_i") <= F.col("_n") - horizon).drop("_i", "_n")
    test = rows.where(F.col("_i") > F.col("_n") - horizon).select(*keys, (F.col("_i") - F.col("_n") + horizon).alias("step"), F.col(y).alias("_actual"))
    both = linear_forecast(train, y, order, keys, horizon, levels).join(test, [*keys, "step"])
    err = F.when(F.col("_actual") != 0, F.abs((F.col("_actual") - F.col("point")) / F.col("_actual")))
    both = both.withColumn("_err", err)
    cover = [F.avg(F.col("_actual").between(F.col(f"lower_{round(v * 100)}"), F.col(f"upper_{round(v * 100)}")).cast("double")).alias(f"coverage_{round(v * 100)}") for v in levels]
    first_bad = F.min(F.when(F.col("_err") > 0.25, F.col("step")))
    return both.groupBy(*keys).agg(F.avg("_err").alias("mape"), *cover, F.coalesce(first_bad - 1, F.count("*")).cast("long").alias("trustworthy_steps"))
