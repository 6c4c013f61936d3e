"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

Test texts are cut into windows of consecutive words. The index stores the postings of the
training tokens that are among the two rarest words of some window, written next to each other by
document as the scan meets them; the rarest word's postings carry the words around them. A window
is looked up from its rarest word: its list and that of the second rarest word, both
shifted by the word's place in the window, are intersected on (document, start); the lists of
the other words are intersected at the posting, in its surroundings. Nothing is cut off: a
common rarest word only has a longer list.

Defined results: a null or empty text has no words; a text of fewer words than a window is one
window; an item without words has none; equal windows of several items count for each; rows that
share a doc_id, and equal rows, are judged on their own and each return a row; a null item_id
is not listed; empty tables give no rows or no hits; a very long text takes time in proportion to its words.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import postings as lists_of
from .common import covered, join_in_parts, materialise, without
from .postings import postings, term_counts, with_words

WINDOW = 8
ITEMS = 2


def windows(tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (hash), win_words, item_ids: the distinct windows of all items."""
    df = with_words(tests.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    df = df.withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    df = df.select("item_id", "words", "n", F.explode(starts).alias("s"))
    words = F.slice("words", F.col("s") + 1, F.least(F.col("n"), F.lit(window)))
    return df.select("item_id", words.alias("win_words")).groupBy("win_words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("win", F.xxhash64(F.concat_ws(" ", "win_words"), F.size("win_words")))


def ranked(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """win, len, term, offset, nth: the words of each window from its rarest on."""
    df = wins.select("win", F.size("win_words").alias("len"), F.posexplode("win_words").alias("offset", "term")).join(counts, "term")
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("win").orderBy("df", "term", "offset")))


def build_index(docs: DataFrame, signature: DataFrame, window: int = WINDOW) -> DataFrame:
    """The stored index: postings of the signature's terms, with surroundings for the rarest."""
    terms = signature.groupBy("term").agg((F.min("nth") == 1).alias("wide"))
    return materialise(postings(docs, terms, window - 1), "positional_index")


def phrase_matches(index: DataFrame, wins: DataFrame, signature: DataFrame) -> DataFrame:
    """row, win, start, len: every place where a window stands word by word."""
    most = lists_of.MAX_BROADCAST
    lists = join_in_parts(index.where(F.col("term").isNotNull()), signature, "term", most)
    lists = lists.withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0")
    rarest = lists.where("nth = 1").select("row", "win", "start", "len", "near_from", "near")
    second = lists.where("nth = 2").select("row", "win", "start")
    met = rarest.where("len > 1").join(second, ["row", "win", "start"], "left_semi").unionByName(rarest.where("len = 1"))
    same = F.slice("near", F.col("start") - F.col("near_from") + 1, F.col("len")) == F.col("win_words")
    return join_in_parts(met, wins.select("win", "win_words"), "win", most, lambda df: df.where(same).select("row", "win", "start", "len"))


def proximity_matches(index: DataFrame, wins: DataFrame, signature: DataFrame) -> DataFrame:
    """row, win, pos: places of a window's rarest word that have all its words, in any order,
    within a window's length on either side."""
    first = materialise(signature.where("nth = 1").join(wins.select("win", "win_words"), "win").select("win", "term", "win_words"), "rarest")
    every = F.size(F.array_except("win_words", "near")) == 0
    return join_in_parts(index.where(F.col("near").isNotNull()), first, "term", lists_of.MAX_BROADCAST, lambda df: df.where(every).select("row", "win", "pos"))


def items_of(found: DataFrame, wins: DataFrame) -> DataFrame:
    """row, items: the items of the windows found (row, wins). Windows of the same items are one set of items, so a
    row meets each set once, however many of its windows it has."""
    sets = wins.withColumn("set", F.md5(F.to_json(F.array_sort("item_ids"))))
    each = found.select("row", F.explode("wins").alias("win"))
    each = join_in_parts(each, sets.select("win", "set"), "win", lists_of.MAX_BROADCAST).select("row", "set").distinct()
    sets = materialise(sets.groupBy("set").agg(F.first("item_ids").alias("item_ids")), "item_sets")
    few = (sets.agg(F.sum(F.size("item_ids"))).first()[0] or 0) <= lists_of.MAX_BROADCAST
    each = each.join(F.broadcast(sets) if few else sets.hint("merge"), "set")
    return each.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))


def judge(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (row, doc_id, text_hash, n_words), hits (row, hit, items), near (row, n_near).

    The last two have only rows with a hit; hit has the places of the hit words, each once, items sorted ids.
    """
    wins = materialise(windows(tests, window), "windows")
    counts = term_counts(docs, wins.select(F.explode("win_words").alias("term")).distinct())
    signature = materialise(ranked(wins, counts).where("nth <= 2").select("win", "len", "term", "offset", "nth"), "signature")
    index = build_index(docs, signature, window)
    found = phrase_matches(index, wins, signature)
    found = found.groupBy("row").agg(covered(F.collect_set(F.struct("start", "len"))).alias("hit"), F.collect_set("win").alias("wins"))
    found = materialise(found, "found")
    hits = found.select("row", "hit").join(items_of(found, wins), "row")
    near = proximity_matches(index, wins, signature).groupBy("row").agg(F.count_distinct("win").alias("n_near"))
    return index.where(F.col("term").isNull()).select("row", "doc_id", "text_hash", "n_words"), hits, near


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, items: int = ITEMS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_near counts the windows with a proximity match.
    """
    files, hits, near = judge(docs, tests, window)
    none = F.array().cast("array<string>")
    df = files.join(hits, "row", "left").join(near, "row", "left")
    df = df.withColumn("items", F.coalesce("items", none)).withColumn("n_items", F.size("items").cast("long"))
    n_hit = F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit")).cast("long")
    return df.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_items") >= items).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def clean(docs: DataFrame, tests: DataFrame, window: int = WINDOW, items: int = ITEMS) -> DataFrame:
    """``docs`` without contaminated documents; from the others the hit words are cut, with the
    separators after them, and n_chars, where there is such a column, is counted anew."""
    files, hits, _ = judge(docs, tests, window)
    key = {"k_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "k_null": F.col("doc_id").isNull()}
    hits = files.join(hits, "row").withColumns(key).groupBy("k_id", "k_null", "text_hash").agg(F.first("hit").alias("cuts"), (F.max(F.size("items")) >= items).alias("contaminated"))
    hits = materialise(hits, "hits")
    few = (hits.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= 2 * lists_of.MAX_BROADCAST
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in key.items()], F.xxhash64("text").alias("text_hash"))
    df = keyed.join(F.broadcast(hits) if few else hits.hint("merge"), list(key) + ["text_hash"], "left").where("contaminated is null or not contaminated")
    text = F.col("row.text")
    # Each piece is a word, in either case, and what follows it, so piece i holds word i.
    apart = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
    pieces = F.regexp_extract_all(text, F.lit(f"([^{apart}]+[{apart}]*)"), F.lit(1))
    df = df.withColumn("pieces", F.when(F.col("cuts").isNotNull(), pieces))
    kept = without(F.col("pieces"), F.size("pieces"), F.col("cuts"))
    cut = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.regexp_extract(text, f"^[{apart}]*", 0), F.concat_ws("", kept)))
    anew = {"text": cut}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.when(F.col("cuts").isNull(), F.col("row.n_chars")).otherwise(F.char_length(cut))
    return df.select(*[anew.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
