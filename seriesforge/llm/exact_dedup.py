"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the SHA-256 of the normalised text. New rows are
grouped by digest before the shuffle ends, anti-joined with the index by sort-merge, and the
digests that were not there are appended. The bucket count is stored beside the data, and an index that is
opened again keeps the one it was made with. Each call's digests count only once its
entry in the index's log is written, so a call that fails half-way leaves the index as it was.

Defined results: a null text counts as empty, so all null and empty texts are one group; a null
doc_id is above every other one; of rows that agree in doc_id and text one stays; an empty table
gives no rows and leaves the index as it was; a very long text is digested whole. Extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, attach, materialise, shared_dir

#: Buckets of a new index, and the version of its layout.
BUCKETS = 64
LAYOUT = 2


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


class DigestIndex:
    """Digests seen so far, with the doc_id that stays for each.

    ``path`` is a folder that all executors share: ``digests`` has the bucketed data, ``about`` the layout
    and ``log`` an entry for each call that finished. Reopening the path finds what was there, under
    the bucket count it was made with, whatever ``buckets`` says. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        about = self._read("about", "layout int, buckets int")
        if about is None:
            self.buckets = buckets or BUCKETS
            spark.range(1).select(F.lit(LAYOUT).alias("layout"), F.lit(self.buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/about")
        else:
            row = about.first()
            if row is None or row.layout != LAYOUT:
                raise ValueError(f"{path} holds no digest index of layout {LAYOUT}")
            self.buckets = row.buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, call STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _read(self, part: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def table(self) -> DataFrame:
        """digest, keep_id of every call that finished."""
        log = self._read("log", "call string")
        if log is None:
            return self.spark.table(self.name).where(F.lit(False)).drop("call")
        # One row for each call, so the log is small beside the digests; the join leaves their order as it is.
        return self.spark.table(self.name).join(F.broadcast(log), "call", "left_semi").drop("call")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Append what is new in ``docs`` and return a decision for every row of it:
        doc_id, keep_id, group_size, kept, text_sha256.

        A digest that the index already has keeps its keep_id, so none of its new rows stays.
        group_size counts the rows of ``docs``.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("digest")))
        rows = materialise(rows, "digests")
        found = rows.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("group_size"))
        known = self.table().withColumn("was_known", F.lit(True))
        groups = found.join(known.hint("merge"), "digest", "left").select(
            "digest",
            F.when(F.col("was_known"), F.col("keep_id")).otherwise(F.col("min_id")).alias("keep_id"),
            "group_size",
            F.coalesce("was_known", F.lit(False)).alias("was_known"),
        )
        groups = materialise(groups, "groups")
        call = uuid.uuid4().hex
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(call).alias("call"))
        (fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.range(1).select(F.lit(call).alias("call")).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return attach(rows, groups, "digest", "group_size").select(
            "doc_id",
            "keep_id",
            "group_size",
            (~F.col("was_known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )

    def close(self) -> None:
        """Take the table out of the catalog; the data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Decisions for ``docs`` against the index at ``path`` (a new, empty one by default)."""
    spark = docs.sparkSession
    index = DigestIndex(spark, path or f"{shared_dir(spark)}/digest_index", buckets)
    try:
        return index.add(docs)
    finally:
        index.close()
