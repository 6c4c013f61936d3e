"""Sinks: exports, keyed upserts, superseding, split outputs, notes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def export(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_segments(df: DataFrame, path: str, segment: str | None = None, fmt: str = "parquet", column: str = "segment_id") -> None:
    """One segment, or all of them as partitions of one table."""
    if segment is not None:
        export(df.where(F.col(column) == segment).drop(column), path, fmt)
    else:
        export(df, path, fmt, column)


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The table after INSERT OR REPLACE: per key the row that came last; incoming wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_new")


def upsert_status(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows, each with status updated or registered."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return incoming.join(known, key, "left").withColumn("status", F.when(F.col("_known"), "updated").otherwise("registered")).drop("_known")


def supersede(df: DataFrame, keys: list[str], order: str, id_col: str) -> DataFrame:
    """status and superseded_by: the newest row of each key is active, each older one points to the next."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(id_col))
    return df.withColumn("status", F.when(F.row_number().over(newest) == 1, "active").otherwise("superseded")).withColumn("superseded_by", F.lag(id_col).over(newest))


def explode_rows(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    """One row per element of an array of structs, beside the kept columns."""
    return df.select(*keep, F.explode(array).alias("_e")).select(*keep, "_e.*")


def split_matched(df: DataFrame, label: str, path: str, fmt: str = "csv") -> dict[str, int]:
    """Write labelled and unlabelled rows apart; counts by label."""
    export(df.where(F.col(label).isNotNull()), f"{path}/matched", fmt)
    export(df.where(F.col(label).isNull()), f"{path}/unmatched", fmt)
    return {r[label] or "unmatched": r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def baseline_artefacts(baselines: DataFrame, parts: DataFrame, path: str) -> None:
    """Baselines and their decompositions as two tables, partitioned by column."""
    export(baselines, f"{path}/baselines", partition_by="column")
    export(parts, f"{path}/decompositions", partition_by="column")


def graph_json(nodes: DataFrame, edges: DataFrame) -> str:
    """A graph of column values as JSON; the graph describes columns and is small."""
    return json.dumps({"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}, default=str, sort_keys=True)


def data_notes(profile: list[dict], dataset: str, rows: int) -> str:
    """Markdown notes on a profiled dataset; a mean over 100 of a money column may mean cents."""
    lines = [f"# {dataset}", "", f"{rows} rows", "", "| column | role | distinct | nulls | hint |", "| --- | --- | --- | --- | --- |"]
    for p in profile:
        money = any(w in p["column"].lower() for w in ("amount", "price", "revenue", "cost", "total"))
        hint = "cents?" if money and (p.get("mean") or 0) > 100 else ""
        lines.append(f"| {p['column']} | {p['role']} | {p['n_distinct']} | {p['n_null']} | {hint} |")
    return "\n".join(lines) + "\n"


def series_files(series: DataFrame, summary: DataFrame, path: str) -> None:
    """A series as CSV beside its one-row summary as JSON."""
    export(series, f"{path}/series.csv", "csv")
    export(summary, f"{path}/summary", "json")


def clear(df: DataFrame, path: str) -> None:
    """Replace a stored table by an empty one of its schema."""
    export(df.limit(0), path)
