"""The stages of preparing a data lake: profile its files, normalise names, plan the joins and write the manifest.

Every stage writes what it found under one folder, with a state document, so a run that was broken off goes on
after its last finished stage and a person can edit the results in between.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, normalize
from ..operators.inspect import segment_estimates
from ..operators.profile import roles, segment_candidates, union_all
from ..sources import readers
from . import executor
from . import manifest as mf

STAGES = ("profile", "normalize", "plan")


@dataclass
class Lake:
    """A folder of files and the folder that the stages write to; ``options``: columns to normalise, rules, levels, and
    the timestamp and value columns of datasets where the profile is not to decide."""

    spark: SparkSession
    source: str
    target: str
    options: dict = field(default_factory=dict)

    def read_state(self) -> dict:
        try:
            lines = [r.value for r in self.spark.read.text(f"{self.target}/state").collect()]  # one short document
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lines = []
        return json.loads("".join(lines)) if lines else {"done": [], "results": {}}

    def edit(self, changes: dict) -> dict:
        """The state with changes laid over it, mappings merged key by key."""
        state = mf.merge(self.read_state(), changes)
        text = json.dumps(state, default=str, sort_keys=True)
        self.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.target}/state")
        return state

    def finish(self, stage: str, found: dict) -> dict:
        done = [s for s in STAGES if s in self.read_state()["done"] or s == stage]
        return self.edit({"done": done, "results": {stage: found}})

    def frames(self) -> dict[str, DataFrame]:
        found, _ = readers.scan_directory(self.spark, self.source)
        named = {name: df for name, df in found.items()}
        return {self.options.get("names", {}).get(name, name): df for name, df in named.items()}


def profile(lake: Lake) -> dict:
    """Roles of all columns and the graph of the lake."""
    frames = lake.frames()
    found = union_all([roles(df).select(F.lit(name).alias("dataset"), "*") for name, df in sorted(frames.items())])
    found.write.mode("overwrite").parquet(f"{lake.target}/profile")
    rows = lake.spark.read.parquet(f"{lake.target}/profile").collect()  # a row for each column of the lake
    of = lambda role: {n: sorted(r["column"] for r in rows if r["dataset"] == n and r["role"] == role) for n in frames}
    graph.save(*graph.build(frames, of("DISCRIMINATOR"), of("VALUE")), f"{lake.target}/graph")
    return lake.finish("profile", {"datasets": sorted(frames), "discriminators": of("DISCRIMINATOR"), "times": of("TIME"), "values": of("VALUE")})


def normalise(lake: Lake) -> dict:
    """A lookup of each column to normalise, over the names of all datasets that have it."""
    frames, levels = lake.frames(), lake.options.get("levels", ["product"])
    counts = {}
    for col in lake.options.get("normalize_columns", []):
        parts = [df.select(F.col(col).cast("string").alias("raw")) for df in frames.values() if col in df.columns]
        lookup = normalize.build_lookup(normalize.cluster_names(union_all(parts)), lake.options.get("rules", {}), levels)
        lookup.write.mode("overwrite").parquet(f"{lake.target}/lookups/{col}")
        counts[col] = lake.spark.read.parquet(f"{lake.target}/lookups/{col}").select("canonical").distinct().count()
    return lake.finish("normalize", {"canonicals": counts})


def plan(lake: Lake) -> dict:
    """The join plan around the largest dataset with a time, and the manifest of a batch run over it."""
    state, frames = lake.read_state()["results"], lake.frames()
    times, values = ({n: (lake.options.get(key, {}).get(n) or (state["profile"][kind].get(n) or [None])) for n in frames} for key, kind in (("times", "times"), ("values", "values")))
    first = lambda x: x if isinstance(x, str) else x[0]
    datasets = [executor.Dataset(n, df, first(times[n])) for n, df in sorted(frames.items())]
    built = executor.build(datasets)
    levels = lake.options.get("levels", ["product"])
    lookups = {c: lake.spark.read.parquet(f"{lake.target}/lookups/{c}") for c in state.get("normalize", {}).get("canonicals", {})}
    name = built.primary.name
    executor.attach(built, lookups, levels, state["profile"]["discriminators"].get(name, []) + list(lookups))
    numbers = [values[name]] if isinstance(values[name], str) else [v for v in values[name] if v]
    counts = {r["column"]: r["n_distinct"] for r in segment_candidates(built.primary.frame, built.primary.time_col or "").collect()}  # a row for each column
    made = mf.from_profile(name, lake.source, built.primary.time_col or "", numbers, {c: n for c, n in counts.items() if c not in numbers})
    made["normalization"] = {"enabled": bool(lookups), "rules": lake.options.get("rules", {}), "enrichment_columns": sorted(built.lookups), "hierarchy_levels": levels}
    sizes = {r["name"]: r["n"] for r in segment_estimates(built.lookups, levels).collect()} if built.lookups else {}
    return lake.finish("plan", {"plan": executor.describe(built), "manifest": made, "segment_estimates": sizes})


def run(lake: Lake, again: bool = False) -> dict:
    """All stages, or those that are not done yet; the state at the end."""
    for name, stage in zip(STAGES, (profile, normalise, plan)):
        if again or name not in lake.read_state()["done"]:
            stage(lake)
    return lake.read_state()
