"""Line deduplication by overlapping three-line windows (DataFrame operations only).

Every three consecutive lines of a document are a window, known by the MD5 of its lines. The
earliest place of each repeated window is found by an aggregation that combines before the
shuffle; at every later place its lines are covered, and the union of the covered places is
removed. Windows are judged on the input, not on what is left.

Defined results: lines end at a line feed; a null or empty text has none; a text of fewer than
three lines keeps them all; rows that share a doc_id count as one document, so equal places of
theirs are none earlier; a null doc_id comes after every other one; an empty table gives no rows;
a text of many lines takes time in proportion to them. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, covered, materialise, without
from .substring_dedup import _keyed

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, start, h: every window of every document."""
    df = keyed.select("doc", "tag", lines_of(F.col("text")).alias("lines")).where(F.size("lines") >= window)
    df = df.select("doc", "tag", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - window)).alias("start"))
    parts = [F.get("lines", F.col("start") + i) for i in range(window)]
    return df.select("doc", "tag", "start", F.unhex(F.md5(F.concat_ws("\n", *parts))).alias("h"))


def line_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (and kept, the lines that stay)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    rows = materialise(windows(keyed, window), "line_windows")
    groups = rows.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("h", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"), "n"), "repeated_windows")
    later = attach(rows, groups, "h", "n").where("doc <> first_doc or start <> first_start")
    gone = materialise(later.groupBy("doc", "tag").agg(covered(F.collect_set("start"), window).alias("gone")), "covered_lines")
    df = keyed.join(gone.hint("merge"), ["doc", "tag"], "left").withColumn("lines", lines_of(F.col("text")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.size("lines"), F.col("gone")))
    df = df.withColumn("kept_lines", kept)
    n = F.size("lines").cast("long")
    body = F.concat_ws("\n", "kept_lines")
    out = df.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_lines"), (n - F.size("kept_lines")).alias("n_removed"), F.sha2(body, 256).alias("kept_sha256"), body.alias("kept"))
    return out if with_text else out.drop("kept")
