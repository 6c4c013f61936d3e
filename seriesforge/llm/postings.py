"""Positional postings of chosen terms, made in one pass over whole texts without a shuffle.

Used by decontamination (terms of the benchmark) and the licence scan (terms of the templates).
Words are looked up as they are, in a broadcast table of the terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, join_in_parts

#: So many terms, or windows, are broadcast at a time.
MAX_BROADCAST = 500_000


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``words``: the lower-cased words."""
    return docs.withColumn("words", alnum_words(F.col(text)))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: occurrences in all documents of each of ``terms`` (column term, distinct)."""
    words = with_words(docs.select("text")).select(F.explode("words").alias("term"))
    if terms.count() <= MAX_BROADCAST:
        found = words.join(F.broadcast(terms.select("term")), "term").groupBy("term").agg(F.count("*").alias("n"))
        return F.broadcast(terms.select("term")).join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("df"))
    found = words.groupBy("term").agg(F.count("*").alias("n"))  # combined before the shuffle: a row for each word and task
    return terms.select("term").join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("df"))


def postings(docs: DataFrame, terms: DataFrame, reach: int, id_col: str = "doc_id") -> DataFrame:
    """row, doc_id, text_hash, n_words, term, pos, near_from, near: a row for every occurrence of a term.

    ``near`` holds the words from ``near_from`` on, up to ``reach`` words on either side, for
    terms whose ``wide`` is true, else null. Every document has one more row, whose term and pos are
    null and which carries n_words and text_hash. ``row`` numbers the rows of ``docs``; it is fixed
    only once the result is written. More terms than ``MAX_BROADCAST`` are looked up in several passes.
    """
    end = terms.sparkSession.range(1).select(F.lit("").alias("w"), F.lit(False).alias("wide"))
    keyed = terms.select(F.col("term").alias("w"), "wide").unionByName(end)
    df = with_words(docs.select(F.col(id_col).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))).withColumn("row", F.monotonically_increasing_id())
    # The empty word is no word: it stands for the end of the text.
    df = df.select("row", "doc_id", "text_hash", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "w"))
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    real = F.col("w") != ""
    columns = (
        "row",
        "doc_id",
        F.when(~real, F.col("text_hash")).alias("text_hash"),
        F.when(~real, F.col("pos")).cast("long").alias("n_words"),
        F.when(real, F.col("w")).alias("term"),
        F.when(real, F.col("pos")).alias("pos"),
        F.when(real & F.col("wide"), start).alias("near_from"),
        F.when(real & F.col("wide"), F.slice("words", start + 1, F.lit(2 * reach + 1))).alias("near"),
    )
    return join_in_parts(df, keyed, "w", MAX_BROADCAST, lambda df: df.select(*columns))
