"""Entity names: clusters of spellings, rules for hierarchy levels, the lookup and its use."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import kept
from .inspect import best_spellings
from .profile import union_all

THRESHOLD = 80.0
#: Up to so many names are clustered in a task for each block, more in rounds over their similar pairs.
LEADER_NAMES = 20_000


def _confidence(texts: list[str]) -> float:
    """Mean similarity of all pairs of a cluster's different texts."""
    texts = sorted(set(texts))
    total = sum(tx.token_sort_ratio(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :])
    return round(total / (len(texts) * (len(texts) - 1) / 2) / 100, 3) if len(texts) > 1 else 1.0


def cluster_names(values: DataFrame, threshold: float = THRESHOLD, block: str | None = None) -> DataFrame:
    """raw, normalized, cluster, canonical, confidence for distinct spellings (column raw).

    In their order, a name joins the first leader it is similar to, or leads a cluster itself; ``block`` (a column) keeps
    names apart. confidence is the mean similarity of all pairs of a cluster's different normalised texts.
    """
    names = values.select("raw", *([F.col(block).alias("block")] if block else [])).distinct()
    names = names if block else names.withColumn("block", F.lit(""))
    names = names.where("raw is not null")
    many = threshold <= 100 and names.limit(LEADER_NAMES + 1).count() > LEADER_NAMES
    names = names.withColumn("normalized", tx.normalize(F.col("raw"))).withColumn("score", tx.canonical_score(F.col("raw")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw").reset_index(drop=True)
        pdf["cluster"] = tx.leaders(pdf["normalized"].tolist(), threshold)
        pdf["confidence"] = pdf["cluster"].map({c: _confidence(part["normalized"].tolist()) for c, part in pdf.groupby("cluster")})
        return pdf[["block", "raw", "normalized", "score", "cluster", "confidence"]]

    if many:
        out = _clusters_in_rounds(kept(names), threshold)
    else:
        out = names.groupBy("block").applyInPandas(group, "block string, raw string, normalized string, score int, cluster int, confidence double")
    best = out.groupBy("block", "cluster").agg(F.max_by("raw", F.struct("score", "raw")).alias("canonical"))
    return out.join(best, ["block", "cluster"]).select("block", "raw", "normalized", "cluster", "canonical", "confidence")


def _clusters_in_rounds(names: DataFrame, threshold: float) -> DataFrame:
    """The same clusters without all names of a block in one task. A name's place in the order is that of the first
    spelling with its normalised text; each round settles the names whose similar earlier ones are settled."""
    nodes = kept(names.groupBy("block", F.col("normalized").alias("v")).agg(F.min("raw").alias("first")))
    pairs = similar_texts(nodes.select("block", "v"), threshold)
    place = lambda s: nodes.select("block", F.col("v").alias(s), F.col("first").alias(f"first_{s}"))
    pairs = pairs.join(place("a"), ["block", "a"]).join(place("b"), ["block", "b"])
    earlier = F.col("first_a") < F.col("first_b")
    links = kept(pairs.select("block", F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("before")))
    state = nodes.withColumn("leads", F.lit(None).cast("boolean"))
    while True:
        state = kept(state)
        if not state.where("leads is null").limit(1).count():
            break
        seen = links.join(state.select("block", F.col("v").alias("before"), "leads"), ["block", "before"])
        seen = seen.groupBy("block", "v").agg(F.coalesce(F.max("leads"), F.lit(False)).alias("_joins"), F.count_if(F.col("leads").isNull()).alias("_open"))
        settled = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("_joins", F.lit(False)), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = state.join(seen, ["block", "v"], "left").select("block", "v", "first", settled.alias("leads"))
    heads = state.where("leads")
    numbers = heads.select("block", F.col("v").alias("head"), (F.row_number().over(Window.partitionBy("block").orderBy("first")) - 1).cast("int").alias("cluster"))
    joined = links.join(heads.select("block", F.col("v").alias("before"), F.col("first").alias("_f")), ["block", "before"]).groupBy("block", "v").agg(F.min_by("before", "_f").alias("_head"))
    own = state.join(joined, ["block", "v"], "left").select("block", F.col("v").alias("normalized"), F.when(F.col("leads"), F.col("v")).otherwise(F.col("_head")).alias("head"))
    own = kept(own.join(numbers, ["block", "head"]).select("block", "normalized", "cluster"))

    def sure(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _confidence(pdf["normalized"].tolist()))], columns=["block", "cluster", "confidence"])

    known = own.groupBy("block", "cluster").applyInPandas(sure, "block string, cluster int, confidence double")
    return names.join(own, ["block", "normalized"]).join(known, ["block", "cluster"]).select("block", "raw", "normalized", "score", "cluster", "confidence")


def sequence_clusters(values: DataFrame, threshold: float = 82.0) -> DataFrame:
    """raw, cluster, canonical by the similarity of longest common blocks, without normalising; for one column's names."""
    names = values.select("raw").where("raw is not null").distinct()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw").reset_index(drop=True)
        return pdf.assign(cluster=tx.sequence_groups(pdf["raw"].tolist(), threshold))[["raw", "cluster"]]

    out = names.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(group, "raw string, cluster int")
    return out.join(best_spellings(out, "cluster", "raw").withColumnRenamed("raw", "canonical"), "cluster").select("raw", "cluster", "canonical")


def normalization_graph(lookup: DataFrame, levels: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from raw spellings to their canonical name and up the levels; a later cluster wins."""
    chain = ["raw_value", "canonical", *[x for x in levels if x != "product"]]
    at = lambda c: F.concat(F.lit(f"{column}.{'product' if c == 'canonical' else c}="), F.col(c))
    ids = [lookup.where(F.col(c).isNotNull()).select(at(c).alias("id"), F.lit("VALUE").alias("node_type"), F.lit(f"{column}.{c}").alias("name"), F.col(c).alias("value")) for c in chain]
    links = [lookup.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(at(a).alias("source"), at(b).alias("target"), F.lit("CHILD_OF").alias("edge_type")) for a, b in zip(chain, chain[1:])]
    return union_all(ids).distinct(), union_all(links).distinct()


def fuzzy_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """a, b, score of distinct names that are at least so similar, a before b."""
    return similar_texts(values.select(F.lit("").alias("block"), F.col("raw").alias("v")).distinct(), threshold).drop("block")


def similar_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """block, a, b, score of the pairs of different texts (block, v) within a block that are at least so similar.

    Candidates come from a prefix filter that loses no pair: the characters that two names have in common, copies
    numbered, are at least as many as their longest common subsequence. A name of n characters that reaches the
    threshold with any other shares at least n * t / (2 - t) of them, so of its characters in order of rarity
    the first n + 1 less that number hold one that the other has among its own first.
    """
    t = threshold / 100
    sorted_words = F.array_join(F.array_sort(F.split(F.trim(F.lower("v")), r"(?U)\s+")), " ")
    names = kept(texts.where("v is not null").withColumn("k", sorted_words).withColumn("n", F.length("k")))
    chars = names.select("block", "v", "n", F.explode(F.split("k", "")).alias("c")).where("c <> ''").groupBy("block", "v", "n", "c").agg(F.count("*").alias("m"))
    marks = kept(chars.select("block", "v", "n", "c", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i")))
    rank = marks.groupBy("c", "i").agg(F.count("*").alias("_f"))  # a row for each character and copy
    w = Window.partitionBy("block", "v").orderBy("_f", "c", "i")
    placed = marks.join(F.broadcast(rank), ["c", "i"]).withColumn("_at", F.row_number().over(w))
    first = placed.where(F.col("_at") <= F.col("n") + 1 - F.ceil(F.col("n") * (t / (2 - t)) - 1e-9)).select("block", "v", "n", "c", "i")
    none = names.where("n = 0").select("block", "v", "n", F.lit("").alias("c"), F.lit(0).alias("i"))
    first = first.unionByName(none)
    # 2 * lcs / (x + y) >= t with lcs <= min(x, y) gives y <= x * (2 - t) / t for x <= y.
    a, b = (first.select("block", F.col("v").alias(s), F.col("n").alias(f"n{s}"), "c", "i") for s in "ab")
    near = (F.col("nb") <= F.floor(F.col("na") * ((2 - t) / t) + 1e-9)) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = a.join(b, ["block", "c", "i"]).where(near).select("block", "a", "b").distinct()
    key = lambda s: names.select("block", F.col("v").alias(s), F.col("k").alias(f"k{s}"))
    pairs = pairs.join(key("a"), ["block", "a"]).join(key("b"), ["block", "b"]).withColumn("score", tx.similarity(F.col("ka"), F.col("kb")))
    return pairs.where(F.col("score") >= threshold).select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def classify(df: DataFrame, col: str, rules: dict, levels: list[str]) -> DataFrame:
    """Columns of the levels from the first rule whose pattern is found.

    rules: {pattern: {level: value}}, with default: {level: value}, else Unclassified; a level that a
    rule lacks takes the default's, or Unknown.
    """
    default = rules.get("default") or dict.fromkeys(levels, "Unclassified")
    for level in levels:
        pairs = [(p, r.get(level, default.get(level, "Unknown"))) for p, r in rules.items() if p != "default"]
        df = df.withColumn(level, tx.first_match(F.col(col), pairs, default.get(level, "Unknown")))
    return df


def build_lookup(clusters: DataFrame, rules: dict, levels: list[str], first: str = "product") -> DataFrame:
    """raw_value, canonical and levels, with both raw and normalised spellings as keys, each once (later clusters win)."""
    named = classify(clusters.withColumn(first, F.col("canonical")), "canonical", rules, [x for x in levels if x != first])
    keys = named.select(F.explode(F.array("raw", "normalized")).alias("raw_value"), "canonical", "cluster", *levels)
    w = Window.partitionBy("raw_value").orderBy(F.desc("cluster"), "canonical")
    return keys.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "cluster")


def lookup_enrich(df: DataFrame, lookup: DataFrame, col: str, levels: list[str], max_broadcast: int = 200_000) -> DataFrame:
    """norm_{col}_{level} by the raw value; rows without a match keep nulls, and no row is added."""
    side = lookup.select(F.col("raw_value").cast("string").alias("_k"), *[F.col(v).alias(f"norm_{col}_{v}") for v in levels]).dropDuplicates(["_k"])
    side = F.broadcast(side) if side.limit(max_broadcast + 1).count() <= max_broadcast else side
    return df.join(side, F.col(col).cast("string") == F.col("_k"), "left").drop("_k")


def resolve(df: DataFrame, lookup: DataFrame, col: str) -> DataFrame:
    """canonical by the raw value, else by its normalised text."""
    keys = lookup.select("raw_value", "canonical")
    a, b = keys.select(F.col("raw_value").alias("_a"), F.col("canonical").alias("_ca")), keys.select(F.col("raw_value").alias("_b"), F.col("canonical").alias("_cb"))
    out = df.withColumn("_n", tx.normalize(F.col(col))).join(a, F.col(col) == F.col("_a"), "left").join(b, F.col("_n") == F.col("_b"), "left")
    return out.withColumn("canonical", F.coalesce("_ca", "_cb")).drop("_a", "_b", "_ca", "_cb", "_n")


def level_values(lookup: DataFrame, level: str) -> DataFrame:
    return lookup.select(level).distinct()


def children(lookup: DataFrame, parent: str, value: str, child: str) -> DataFrame:
    return lookup.where(F.col(parent) == value).select(child).distinct()


def summary(lookup: DataFrame, levels: list[str]) -> DataFrame:
    return lookup.agg(F.count("*").alias("raw_values"), F.count_distinct("canonical").alias("canonicals"), *[F.count_distinct(v).alias(f"n_{v}") for v in levels])


def prompt(names: list[str], levels: list[str], known: dict[str, list[str]] | None = None) -> str:
    """What to ask a language model for rules; ``known`` has the values that each level has already."""
    lines = [f"Give a JSON list of objects with the keys pattern, {', '.join(levels)} that classify these names:", *names]
    lines += [f"Use these values of {level} where they fit: {', '.join(sorted(values))}" for level, values in (known or {}).items() if values]
    return "\n".join(lines)


def parse_rows(answer: str) -> list[dict]:
    """The JSON list of objects in a model's answer, fenced or not; nothing where there is none."""
    found = re.search(r"\[.*\]", re.sub(r"```\w*", "", answer), re.S)
    try:
        rows = json.loads(found[0]) if found else []
    except json.JSONDecodeError:
        return []
    return [r for r in rows if isinstance(r, dict)]


def rules_from_model(ask: Callable[[str], str], names: list[str], levels: list[str], most: int = 200, known: dict[str, list[str]] | None = None) -> dict:
    """Rules from a language model behind ``ask``, which sees ``most`` names at a time, so all are asked for."""
    names, rules = sorted(set(names)), {}
    for at in range(0, len(names), most):
        for r in parse_rows(ask(prompt(names[at : at + most], levels, known))):
            if "pattern" in r:
                rules.setdefault(r["pattern"], {k: r[k] for k in levels if k in r})
    return rules


def mapping_from_model(ask: Callable[[str], str], column: str, names: list[str], most: int = 200) -> dict:
    """An entity_resolution operation from a model's groups ({canonical, names}); names it does not know are left out."""
    names = sorted(set(names))
    mapping = {}
    for at in range(0, len(names), most):
        part = set(names[at : at + most])
        text = "Give a JSON list of objects with the keys canonical and names that group spellings of one thing:\n" + "\n".join(sorted(part))
        for r in parse_rows(ask(text)):
            mapping |= {n: r["canonical"] for n in r.get("names", []) if n in part and isinstance(r.get("canonical"), str) and n != r["canonical"]}
    return {"operation": "entity_resolution", "column": column, "mapping": mapping}
