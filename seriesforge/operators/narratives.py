"""Sentences on results, as column expressions: signals, deviations, forecasts, segments, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def sentences(*parts: Column) -> Column:
    """The parts that are there, one after the other."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " ")


def _peak(c: str, names: tuple[str, ...], text: str) -> Column:
    at = F.array_position(F.col(c), F.array_max(c))
    return F.when(F.size(c) == len(names), F.format_string(text, F.element_at(F.array(*map(F.lit, names)), at.cast("int"))))


def signal(columns: list[str]) -> Column:
    """On a registered signal; ``columns`` are those of its table, of which any may be missing: segment, dataset_name,
    trend_slope, seasonality_strength, seasonal_weekly, seasonal_monthly, deviation_count_90d, critical_pct, change_points."""
    has = lambda c: c in columns
    none = F.lit(None).cast("string")
    slope, strength, n = F.col("trend_slope"), F.col("seasonality_strength"), F.col("deviation_count_90d")
    return sentences(
        F.concat(F.lit("Signal of "), F.coalesce("segment", F.lit("unknown")), *([F.when(F.coalesce("dataset_name", F.lit("")) != "", F.concat(F.lit(" in "), F.col("dataset_name"))).otherwise("")] if has("dataset_name") else []), F.lit(".")),
        F.when(F.abs(slope) < 0.001, "The trend is flat.").when(slope > 0, F.format_string("The trend rises by %.4f.", slope)).when(slope < 0, F.format_string("The trend falls by %.4f.", slope)) if has("trend_slope") else none,
        F.when(strength > 0.7, F.format_string("Strong seasonality (%.2f).", strength)).when(strength > 0.3, F.format_string("Moderate seasonality (%.2f).", strength)).when(strength > 0.05, F.format_string("Weak seasonality (%.2f).", strength)).when(strength.isNotNull(), "No seasonality.") if has("seasonality_strength") else none,
        _peak("seasonal_weekly", DAYS, "Weekly peak on %s.") if has("seasonal_weekly") else none,
        _peak("seasonal_monthly", MONTHS, "Yearly peak in %s.") if has("seasonal_monthly") else none,
        F.when(n == 0, "No deviations in 90 days.").when(n <= 3, F.format_string("%d deviations in 90 days.", n)).when(n > 3, F.format_string("Many deviations: %d in 90 days.", n)) if has("deviation_count_90d") else none,
        F.when(F.col("critical_pct") > 0.1, F.format_string("%.0f%% of them are critical.", F.col("critical_pct") * 100)) if has("critical_pct") else none,
        F.when(F.size("change_points") > 0, F.format_string("%d change points.", F.size("change_points"))) if has("change_points") else none,
    )


def deviations(devs: DataFrame) -> DataFrame:
    """One row: narrative of all deviations (severity, kind, column)."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    agg = devs.agg(F.count("*").alias("n"), is_("severity", "critical").alias("c"), is_("kind", "trend_shift").alias("t"), is_("kind", "regime_change").alias("r"), F.array_sort(F.collect_set("column")).alias("m"))
    text = sentences(
        F.format_string("%d deviations.", "n"), F.when(F.col("c") > 0, F.format_string("%d critical.", "c")), F.when(F.size("m") > 0, F.concat(F.lit("In "), F.array_join(F.slice("m", 1, 3), ", "), F.lit("."))),
        F.when(F.col("t") > 0, F.format_string("%d trend shifts.", "t")), F.when(F.col("r") > 0, F.format_string("%d unusual patterns.", "r")),
    )
    return agg.select(F.when(F.col("n") == 0, "No deviations: everything is within its baseline.").otherwise(text).alias("narrative"))


def forecast(column: Column, first: Column, last: Column, n: Column, start: Column, end: Column, mape: Column, horizon: Column, scenarios: Column) -> Column:
    """On a forecast from ``first`` to ``last`` (dates) of n periods, from value ``start`` to ``end``."""
    return sentences(
        F.concat(F.lit("Forecast of "), column, F.lit(":")),
        F.when(n > 0, F.format_string("%s to %s (%d periods), from %.2f to %.2f.", F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"), n, start, end)),
        F.when(mape.isNotNull(), F.format_string("Backtest error %.2f%%.", mape)),
        F.when(horizon.isNotNull(), F.format_string("Reliable for %d periods.", horizon)),
        F.when(scenarios > 1, F.lit("A second scenario follows the recent deviation.")),
    )


def segmentation() -> Column:
    """On a scored segmentation (column, n_segments, differentiation, balance, coverage, score)."""
    d = F.col("differentiation")
    how = F.when(d >= 0.8, "with distinct patterns in nearly all metrics").when(d >= 0.5, "with different patterns in most metrics").when(d >= 0.2, "with some differences").otherwise("with much the same patterns")
    notes = F.concat(F.when(F.col("balance") < 0.4, "; sizes are uneven").otherwise(""), F.when(F.col("coverage") < 0.5, "; some cover a part of the time only").otherwise(""))
    return F.concat(F.format_string("By %s: %d groups ", "column", "n_segments"), how, notes, F.format_string("; score %.2f.", "score"))
