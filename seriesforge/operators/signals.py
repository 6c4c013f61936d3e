"""Baselines and deviations of many series at once: one Arrow group per series runs the kernels.

A series is first reduced to one row a day in Spark, so what a group holds grows with its days
and not with its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .series import SENSITIVITY, UNITS, aggregate, seasonal_periods

RESULT = (
    "segment_id string, column string, n int, variance_explained double, direction string, slope double, change_points array<int>, seasonal_strength double, peak_phase int, "
    "residual_std double, is_stationary boolean, skewness double, kurtosis double, n_deviations int, deviations array<struct<kind:string,at:int,severity:string,magnitude:double,ts:string>>, error string"
)


def _level(z: float) -> str:
    return "critical" if z >= 4 else "high" if z >= 3 else "medium" if z >= 2.5 else "low"


def _level_by_size(ratio: float) -> str:
    return "critical" if ratio >= 3 else "high" if ratio >= 2 else "medium" if ratio >= 1 else "low"


def window_start(days: np.ndarray, lookback: float | None, baseline_end: float | None, share: float = 0.2) -> int:
    """The first place to look for deviations at, by the days of a series: within ``lookback`` days of its end, or
    else after the baseline's end, or else in the last ``share`` of it; 0 where neither is given."""
    if not len(days):
        return 0
    if lookback:
        return int(np.searchsorted(days, days[-1] - lookback))
    if baseline_end is None:
        return 0
    at = int(np.searchsorted(days, baseline_end, "right"))
    return at if at < len(days) else int(len(days) * (1 - share))


def series_profile(y: np.ndarray, periods: list[int], sensitivity: str, start_at: int = 0) -> dict:
    """Baseline of one series, and its deviations from place ``start_at`` on."""
    n = len(y)
    trend, seasons, rest = k.mstl(y, periods)
    std = float(rest.std())
    x = np.arange(n)
    slope, start = np.polyfit(x, trend, 1) if n > 1 else (0.0, 0.0)
    left = trend - slope * x - start
    err = float(np.sqrt((left @ left) / max(1, n - 2) / max(1e-12, ((x - x.mean()) ** 2).sum()))) if n > 2 else 0.0
    points = k.pelt(trend, np.log(max(n, 2)) * float(trend.var()), max(n // 20, 5), max(n // 50, 1)) if n >= 10 else []
    var = y.var(ddof=1) if n > 1 else 0.0
    main = max(seasons, key=lambda p: seasons[p].std(), default=None)
    cycle = np.array([seasons[main][i::main].mean() for i in range(main)]) if main else np.zeros(0)
    found = []
    recent = y[start_at:]
    window = max(len(recent) // 10, 3)
    smooth = pd.Series(recent).rolling(window, center=True).mean().ffill().bfill().to_numpy()
    if std > 0:
        z = np.abs(recent - smooth) / std
        found += [("point_anomaly", start_at + int(i), _level(z[i]), float(recent[i] - smooth[i])) for i in np.flatnonzero(z > SENSITIVITY[sensitivity])]
    found += [("regime_change", i, "high" if s >= 0.5 else "medium", s) for i, s in k.discords(y) if i >= start_at]
    if len(recent) >= 15:
        spread = std or 1.0
        for c in k.pelt(recent, np.log(len(recent)) * float(recent.var()), max(len(recent) // 10, 5), 5):
            change = float(recent[c : c + 5].mean() - recent[max(0, c - 5) : c].mean())
            found.append(("trend_shift", start_at + c, _level_by_size(abs(change) / spread), change))
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    one = {}
    for d in sorted(found, key=lambda d: (d[1], order[d[2]])):  # at one place the most severe stays
        one.setdefault(d[1], d)
    m2 = float((rest**2).mean()) if n else 0.0
    centred = rest - rest.mean() if n else rest
    s2 = float((centred**2).mean()) if n else 0.0
    return {
        "n": n, "variance_explained": max(0.0, float(1 - rest.var(ddof=1) / var)) if n > 1 and var > 0 else None, "direction": "flat" if abs(slope) < 0.5 * err else "up" if slope > 0 else "down", "slope": float(slope),
        "change_points": [int(p) for p in points], "seasonal_strength": float(max(0.0, 1 - s2 / max(1e-12, (rest + seasons[main]).var()))) if main else 0.0, "peak_phase": int(cycle.argmax()) if main else None,
        "residual_std": std, "is_stationary": bool(k.adf(rest)[1]) if n >= 10 and m2 > 0 else None, "skewness": float((centred**3).mean() / s2**1.5) if s2 > 0 else None, "kurtosis": float((centred**4).mean() / s2**2 - 3) if s2 > 0 else None,
        "n_deviations": len(one), "deviations": [{"kind": d[0], "at": d[1], "severity": d[2], "magnitude": d[3]} for d in one.values()], "error": None,
    }


def analyse(df: DataFrame, seg: str, ts: str, cols: list[str], sensitivity: str = "medium", freq: str = "daily", periods: tuple[int, ...] | None = None, lookback: float | None = None, baseline_end=None) -> DataFrame:
    """One row per segment and value column: baseline and deviations of its series of sums.

    ``freq`` is a frequency class, whose seasonal periods are taken unless given. Deviations are looked for in the
    last ``lookback`` days of each series, or else after ``baseline_end`` (a time) or in the last fifth if nothing is
    later; by default in all of it. A series whose analysis fails has its message in ``error``; the others are not
    affected.
    """
    periods = periods or seasonal_periods(freq)
    freq = UNITS.get(freq, freq)
    end = None if baseline_end is None else pd.Timestamp(baseline_end).timestamp() / 86_400
    sums = aggregate(df, ts, freq, [("sum", c) for c in cols], [seg])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"sum_{c}").cast("double").alias("value")) for c in cols])
    long = sums.select(F.col(seg).cast("string").alias("segment_id"), "period", F.explode(pairs).alias("p")).select("segment_id", "period", "p.column", "p.value")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"segment_id": key[0], "column": key[1]}
        try:
            pdf = pdf.sort_values("period")
            days = pd.to_datetime(pdf["period"]).astype("datetime64[us]").astype("int64").to_numpy() / 86_400e6
            row |= series_profile(pdf["value"].to_numpy(float), list(periods), sensitivity, window_start(days, lookback, end))
            times = pd.to_datetime(pdf["period"]).dt.strftime("%Y-%m-%dT%H:%M:%S").tolist()
            for d in row["deviations"]:
                d["ts"] = times[d["at"]]
        except Exception as e:  # kept beside the series it belongs to
            row |= {"n": len(pdf), "change_points": [], "deviations": [], "n_deviations": 0, "error": str(e)[:300]}
        return pd.DataFrame([row]).reindex(columns=[f.split()[0] for f in _fields()])

    return long.groupBy("segment_id", "column").applyInPandas(one, RESULT)


def _fields() -> list[str]:
    out, depth, now = [], 0, ""
    for ch in RESULT:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def decompose(df: DataFrame, keys: list[str], order: str, value: str, periods: tuple[int, ...] = (7,)) -> DataFrame:
    """trend, seasonal and residual beside every value."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, order, value).schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        trend, seasons, rest = k.mstl(pdf[value].to_numpy(float), list(periods))
        return pdf.assign(trend=trend, seasonal=sum(seasons.values(), np.zeros(len(pdf))), residual=rest)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, f"{fields}, trend double, seasonal double, residual double")


def smooth(df: DataFrame, keys: list[str], order: str, value: str, window: int = 7) -> DataFrame:
    """The least-squares smoothed series."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, order, value).schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pdf[value].to_numpy(float)
        return pdf.assign(smooth=k.savgol(y, window) if len(y) >= window else y)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, f"{fields}, smooth double")


def discords(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """start and score of the windows that are least like any other."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = k.discords(pdf.sort_values(order)[value].to_numpy(float))
        return pd.DataFrame([(*key, i, s) for i, s in found], columns=[*keys, "start", "score"])

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, f"{fields}, start int, score double")


def deviation_rows(results: DataFrame) -> DataFrame:
    """A row for each deviation of ``analyse``'s results, with its time."""
    return results.select("segment_id", "column", F.explode("deviations").alias("d")).select("segment_id", "column", "d.kind", "d.at", "d.severity", "d.magnitude", F.col("d.ts").cast("timestamp").alias("ts"))


def as_signals(results: DataFrame) -> DataFrame:
    """Signals of the correlation operators from ``analyse``'s results: a row for each deviation, whose source is the
    segment, and one for each baseline. The place of a change says how long it lasts."""
    none = {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    rows = deviation_rows(results).select(
        F.sha2(F.concat_ws("|", "segment_id", "column", "kind", "at"), 256).alias("signal_id"), F.col("segment_id").alias("source_id"), F.col("kind").alias("signal_type"), F.col("column").alias("column_name"), "severity",
        F.col("ts").alias("ts_start"), F.col("ts").alias("ts_end"), "magnitude", F.lit(0.75).alias("confidence"), F.when(F.col("kind") == "point_anomaly", "transient").otherwise("sustained").alias("persistence"),
    )
    base = results.where("error is null").select(
        F.sha2(F.concat_ws("|", "segment_id", "column", F.lit("baseline")), 256).alias("signal_id"), F.col("segment_id").alias("source_id"), F.lit("baseline_pattern").alias("signal_type"), F.col("column").alias("column_name"), F.lit("low").alias("severity"),
        F.lit(None).cast("timestamp").alias("ts_start"), F.lit(None).cast("timestamp").alias("ts_end"), F.col("slope").alias("magnitude"), F.col("variance_explained").alias("confidence"), F.lit("sustained").alias("persistence"),
    )
    return rows.unionByName(base).withColumns({**none, "entity_values": F.create_map(F.lit("column"), F.col("column_name"))})


def patterns(results: DataFrame, label: str = "weekly") -> DataFrame:
    """The baselines with a season, for comparing patterns."""
    known = results.where("error is null and peak_phase is not null")
    return known.select(F.sha2(F.concat_ws("|", "segment_id", "column", F.lit("baseline")), 256).alias("signal_id"), F.col("segment_id").alias("source_id"), F.lit(label).alias("period_label"), F.col("seasonal_strength").alias("strength"), "peak_phase")


def change_points(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """at and magnitude (mean of 5 values after less that of 5 before) of each change."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        n = len(y)
        found = k.pelt(y, np.log(max(n, 2)) * float(y.var()), max(n // 10, 5), 1) if n >= 15 else []
        return pd.DataFrame([(*key, c, float(y[c : c + 5].mean() - y[max(0, c - 5) : c].mean())) for c in found], columns=[*keys, "at", "magnitude"])

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, f"{fields}, at int, magnitude double")
