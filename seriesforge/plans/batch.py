"""The batch run: load, clean, enrich, segment, then baseline and deviations of every segment at once."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, correlate, normalize, segments, series, signals
from ..session import kept
from ..sources import readers, sinks
from . import manifest as mf


@dataclass
class Batch:
    """What a run gives: a row per series, and what was found on the way."""

    results: DataFrame
    listing: DataFrame
    issues: list[dict] = field(default_factory=list)
    applied: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    correlations: DataFrame | None = None
    insights: DataFrame | None = None


def enrich(df: DataFrame, manifest: dict) -> DataFrame:
    norm = manifest["normalization"]
    if norm["enabled"]:
        for col in norm["enrichment_columns"]:
            clusters = normalize.cluster_names(df.select(F.col(col).alias("raw")))
            lookup = normalize.build_lookup(clusters, norm["rules"], norm["hierarchy_levels"])
            df = normalize.lookup_enrich(df, lookup, col, norm["hierarchy_levels"])
    return df


def prepare(df: DataFrame, manifest: dict) -> DataFrame:
    """Cleaned and enriched rows; only the operations that the manifest lists are applied."""
    return enrich(clean.clean(df, manifest["clean"]["apply_operations"])[0], manifest)


def frequency_of(df: DataFrame, manifest: dict) -> str:
    """The manifest's frequency class, or that of the times; rows of more than one a day make days."""
    if manifest["freq"]:
        return manifest["freq"]
    found = series.frequency(df, manifest["timestamp_col"], []).first()["frequency"]
    return found if found in ("daily", "weekly", "monthly", "quarterly", "yearly") else "daily"


def run_all(spark: SparkSession, manifest: dict, frame: DataFrame | None = None) -> Batch:
    """The whole run. Issues are looked for if the manifest says auto_detect, and reported only; deviations are those of
    its lookback window; correlations and insights between segments are made if it says correlate."""
    manifest = mf.check(manifest)
    df = frame if frame is not None else readers.scan(spark, manifest["data_path"])
    issues = clean.detect(df) if manifest["clean"]["auto_detect"] else []
    df, applied, errors = clean.clean(df, manifest["clean"]["apply_operations"])
    df = enrich(df, manifest)
    freq = frequency_of(df, manifest)
    back = manifest["deviations"]["lookback_window"]
    out = listing = None
    for s in manifest["scenarios"]:
        rows = segments.create(df, s["segment_by"], s["min_segment_size"], manifest["dataset_name"])
        part = signals.analyse(rows, "segment_id", manifest["timestamp_col"], manifest["value_cols"], manifest["deviations"]["sensitivity"], freq, lookback=mf.duration_days(back) if back else None)
        name = F.lit(s["name"]).alias("scenario")
        part, found = part.select(name, "*"), segments.listing(rows).select(name, "*")
        out, listing = (part, found) if out is None else (out.unionByName(part), listing.unionByName(found))
    batch = Batch(out, listing, issues, applied, errors)
    if manifest["correlate"]:
        options = manifest["correlate"] if isinstance(manifest["correlate"], dict) else {}
        batch.results = kept(out)
        sig = kept(signals.as_signals(batch.results))
        batch.correlations = kept(correlate.correlate(sig, options.get("window_s", 86_400.0), options.get("lag_max", 14), least=options.get("least", 0.3), methods=tuple(options.get("methods", ("temporal", "lagged", "pattern"))), patterns=signals.patterns(batch.results)))
        batch.insights = correlate.insights(batch.correlations, sig)
    return batch


def run(spark: SparkSession, manifest: dict, frame: DataFrame | None = None) -> DataFrame:
    """scenario, segment, column and the baseline and number of deviations of each series."""
    return run_all(spark, manifest, frame).results


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario").agg(F.count_distinct("segment_id").alias("n_segments"), F.count("*").alias("n_series"), F.sum("n_deviations").alias("n_deviations"), F.count("error").alias("n_errors"))


def write(batch: Batch, path: str) -> dict:
    """The run's files: results as JSON, a folder per scenario and segment; deviations; and the summary, which is returned."""
    started = time.time()
    results = kept(batch.results)
    results.write.mode("overwrite").partitionBy("scenario", "segment_id").json(f"{path}/results")
    sinks.export(signals.deviation_rows(results), f"{path}/deviations")
    scenarios = {r["scenario"]: {k: r[k] for k in ("n_segments", "n_series", "n_deviations", "n_errors")} for r in summary(results).collect()}  # a row per scenario
    out = {"scenarios": scenarios, "issues_found": len(batch.issues), "operations_applied": len(batch.applied), "operations_failed": len(batch.errors), "errors": batch.errors, "duration_seconds": round(time.time() - started, 1)}
    results.sparkSession.createDataFrame([(json.dumps(out, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/batch_summary.json")
    return out
