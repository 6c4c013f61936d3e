"""The corpus pipeline: each stage's result is written as Parquet and read as the next one's documents.

Every stage keeps rows whole, so columns beyond those of documents come through, whatever their
names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontamination, language_id, mixing, sharding, simhash
from seriesforge.llm.common import materialise, table

#: A document is rejected if no language scores this much (any text with letters scores more
#: than its share among the learned languages).
LEAST_SCORE = 0.3


def _rows(docs: DataFrame, *needed: str) -> DataFrame:
    """Each row whole, as a struct, beside the columns that an operator needs: no names can clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), *needed)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text (null, empty, no letter), or no language that fits.

    Rows are judged by their text alone, so repeated rows stay or go together; long texts are read whole.
    """
    found = language_id.identify(_rows(docs), language_id.train(docs), keep=("row",), text="row.text")
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; texts link at a similarity of
    0.8 or more over 5-word shingles.

    Null and empty texts are alike; of repeated rows, and of rows that share a doc_id and text, one
    stays; a null doc_id is never the smallest.
    """
    return simhash.keep_one(docs, simhash.similar)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, single passages of a test item are cut.

    Null and empty texts pass; repeated rows are judged alike; n_chars is counted anew where text was cut.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number (0 to 3).

    A document without words (null, empty or blank text) is taken 0 times; a null source is a source;
    repeated rows are documents of their own.
    """
    mixed = mixing.mix(_rows(docs, "doc_id", "text", "source"), keep=("row",))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its place there, with its text; null texts have shards as any other."""
    return sharding.shard(docs.select("doc_id", "text"), keep=("text",))


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Language identification has no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
