"""Jobs with a record: every run's events are appended to a table, and what a run found is registered.

A run's state is its last event, so nothing is ever updated in place and a job that dies leaves a run that has started
and not ended.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import registry, signals
from ..session import kept
from . import batch, stages
from . import manifest as mf

EVENT = "run_id string, kind string, state string, at double, detail string"


@dataclass
class Runs:
    """The table of run events at ``path``: started, then done or failed."""

    spark: SparkSession
    path: str

    def _add(self, run_id: str, kind: str, state: str, detail: dict) -> None:
        row = [(run_id, kind, state, time.time(), json.dumps(detail, default=str, sort_keys=True))]
        self.spark.createDataFrame(row, EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """run_id, kind, state, started, ended and detail of each run, as its last event says."""
        try:
            events = self.spark.read.schema(EVENT).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            events = self.spark.createDataFrame([], EVENT)
        last = F.struct("at", "state", "detail")
        runs = events.groupBy("run_id", "kind").agg(F.min("at").alias("started"), F.max(last).alias("_l"))
        ended = F.when(F.col("_l.state") != "started", F.col("_l.at"))
        return runs.select("run_id", "kind", F.col("_l.state").alias("state"), "started", ended.alias("ended"), F.col("_l.detail").alias("detail"))

    def run(self, kind: str, work: Callable[[str], dict], options: dict | None = None) -> str:
        """Do ``work(run_id)`` as a run of its own; what it raises is recorded and raised again."""
        run_id = uuid.uuid4().hex
        self._add(run_id, kind, "started", options or {})
        try:
            found = work(run_id)
        except Exception as e:
            self._add(run_id, kind, "failed", {"error": str(e)[:500]})
            raise
        self._add(run_id, kind, "done", found)
        return run_id


def profile_job(runs: Runs, lake: stages.Lake) -> str:
    """Profile a lake and normalise its names; the profile stays beside it."""

    def work(_: str) -> dict:
        found = stages.profile(lake)["results"]["profile"]
        return {"datasets": found["datasets"], "canonicals": stages.normalise(lake)["results"]["normalize"]["canonicals"]}

    return runs.run("profile", work, {"source": lake.source})


def registered(results: DataFrame, dataset: str, run_id: str) -> DataFrame:
    """Rows of the registry from a run's results, described."""
    rows = results.where("error is null").select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "scenario", "segment_id", "column"), 256).alias("signal_id"), F.lit(dataset).alias("dataset_name"), "scenario", F.col("segment_id").alias("segment"), "column",
        F.col("direction").alias("trend_direction"), F.col("slope").alias("trend_slope"), F.col("seasonal_strength").alias("seasonality_strength"), "residual_std", "variance_explained", F.col("n").alias("row_count"),
        F.col("n_deviations").alias("deviation_count"), F.col("n_deviations").alias("deviation_count_90d"), "change_points", F.lit(run_id).alias("run_id"), F.lit(time.time()).alias("registered_at"),
    )
    return registry.describe(rows)


def analysis_job(spark: SparkSession, runs: Runs, manifest: dict, store: str, frame: DataFrame | None = None) -> str:
    """A batch run whose signals and deviations are registered under ``store`` (signals, deviations)."""
    checked = mf.check(manifest)

    def work(run_id: str) -> dict:
        found = batch.run_all(spark, manifest, frame)
        results = kept(found.results)
        registered(results, checked["dataset_name"], run_id).write.mode("append").parquet(f"{store}/signals")
        signals.deviation_rows(results).withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{store}/deviations")
        n = results.agg(F.count("*").alias("series"), F.coalesce(F.sum("n_deviations"), F.lit(0)).alias("deviations"), F.count("error").alias("errors")).first()
        return {**n.asDict(), "issues": len(found.issues), "operations_failed": len(found.errors)}

    return runs.run("analysis", work, {"dataset": checked["dataset_name"]})


def store_signals(spark: SparkSession, runs: Runs, store: str) -> DataFrame:
    """Every registered signal of runs that are done, with status and superseded_by: of each dataset, scenario, segment and
    column the last one is active."""
    done = runs.table().where("state = 'done'").select("run_id")
    rows = spark.read.parquet(f"{store}/signals").join(F.broadcast(done), "run_id", "left_semi")  # a row for each run
    newest = Window.partitionBy("dataset_name", "scenario", "segment", "column").orderBy(F.desc("registered_at"), F.desc("signal_id"))
    return rows.withColumn("status", F.when(F.row_number().over(newest) == 1, "active").otherwise("superseded")).withColumn("superseded_by", F.lag("signal_id").over(newest))
