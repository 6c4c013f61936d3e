"""Licence scan by a positional rare-token index (DataFrame operations only).

Licence notices are templates: words at places, with key phrases that must stand word by word. The
corpus gives the key words their inverse document frequency, and each file is looked up by its
highest-IDF licence words: a file that has a notice has the words of its first key phrase, so the two
rarest of them miss none. Their postings are intersected by position relative to the template, the
key phrases are verified, and the notice is aligned with the words around: a template word is in place if
it stands within ``GAP`` words of where the key phrase puts it, so words that were put in or left out
move the rest but do not lose it. The share of the words in place is the score.

Notices and identifiers are data (licences.txt). The base phrases must stand as they are.

Defined results: a null or empty text has no words and no labels (empty strings, score 0);
overlapping places all count; rows that share a doc_id, and equal rows, each return a row; an
empty table gives no rows; a very long text only has more postings. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .postings import postings, term_counts

#: Words by which a notice's words may be out of place.
GAP = 8


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    #: The first says where the template is; the others must stand within ``gap`` words of it.
    keys: tuple[str, ...]
    #: Least share of the words that must be in place.
    share: float = 1.0
    gap: int = GAP
    #: One of the fixed phrases whose places are counted.
    base: bool = False

    @property
    def key_at(self) -> int:
        key = tuple(self.keys[0].split())
        return next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)

    @property
    def spare(self) -> int:
        return int((1 - self.share) * len(self.words) + 1e-9)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def read_templates(text: str) -> tuple[Template, ...]:
    """Templates from the blocks of a notice file."""
    found = []
    for block in re.split(r"\n\s*\n", re.sub(r"(?m)^#.*$", "", text)):
        lines = [tuple(x.strip() for x in line.split(":", 1)) for line in block.splitlines() if ":" in line]
        for label, name in (x.split(" = ") for k, x in lines if k == "spdx"):
            words = words_of(f"SPDX-License-Identifier: {name}")
            found.append(Template(label, words, (" ".join(words),)))
        has = dict(lines)
        if "text" in has:
            words, base = words_of(has["text"]), has.get("base") == "yes"
            keys = tuple(x for k, x in lines if k == "key") or (" ".join(words),)
            found.append(Template(has["label"], words, keys, float(has.get("share", 1)), 0 if base else GAP, base))
    return tuple(found)


TEMPLATES = read_templates(Path(__file__).with_name("licences.txt").read_text("utf-8"))


def _templates(spark: SparkSession, templates) -> DataFrame:
    """The templates as rows, parsed from a literal by one task of the JVM."""
    rows = [{"template": n, "label": t.label, "twords": t.words, "keys": t.keys[1:], "key_at": t.key_at, "key_len": len(t.keys[0].split()), "spare": t.spare, "gap": t.gap, "base": t.base} for n, t in enumerate(templates)]
    schema = "array<struct<template int, label string, twords array<string>, keys array<string>, key_at int, key_len int, spare int, gap int, base boolean>>"
    return spark.range(1).coalesce(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def signature(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """template, term, tpos, nth: the two rarest words of each template's first key phrase, the rarest first."""
    places = templates.select("template", "key_at", "key_len", F.posexplode("twords").alias("tpos", "term"))
    places = places.where("tpos >= key_at and tpos < key_at + key_len")
    places = places.join(term_counts(docs, places.select("term").distinct()), "term")
    nth = F.row_number().over(Window.partitionBy("template").orderBy("df", "term", "tpos"))
    return places.withColumn("nth", nth).where("nth <= 2").select("template", "term", "tpos", "nth")


def matches(docs: DataFrame, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """The files (row, doc_id, n_words) and every match: row, label, base, start (place of the
    template's first word), score."""
    spark = docs.sparkSession
    known = materialise(_templates(spark, templates), "license_templates")
    sign = materialise(signature(docs, known), "license_signature")
    terms = sign.groupBy("term").agg(F.max(F.col("nth") == 1).alias("wide"))
    longest = max(len(t.words) + t.gap for t in templates)
    index = materialise(postings(docs, terms, longest), "license_postings")
    lists = index.where(F.col("term").isNotNull()).join(F.broadcast(sign), "term").withColumn("start", F.col("pos") - F.col("tpos"))
    rarest = lists.where("nth = 1").select("row", "template", "start", "near_from", "near")
    second = lists.where("nth = 2").select("row", "template", "start")
    few = [n for n, t in enumerate(templates) if len(t.keys[0].split()) == 1]
    alone = F.col("template").isin(few) if few else F.lit(False)
    met = rarest.where(~alone).join(second, ["row", "template", "start"], "left_semi").unionByName(rarest.where(alone))
    met = met.join(F.broadcast(known), "template")
    at = F.col("start") - F.col("near_from")
    key = F.slice("near", at + F.col("key_at") + 1, F.col("key_len")) == F.slice("twords", F.col("key_at") + 1, F.col("key_len"))
    met = met.withColumn("at", at).where(F.col("at") + F.col("key_at") >= 0).where(key)
    around = F.concat(F.lit(" "), F.array_join(F.expr("slice(near, greatest(at - gap, 0) + 1, at + size(twords) + gap - greatest(at - gap, 0))"), " "), F.lit(" "))
    met = met.withColumn("around", F.when(F.size("keys") > 0, around)).where("forall(keys, k -> contains(around, concat(' ', k, ' ')))")
    # slice() is empty outside of the text, so template words before its start or after its end are not in place.
    met = met.withColumn("placed", F.expr("size(filter(sequence(0, size(twords) - 1), i -> at + i + gap >= 0 and array_contains(slice(near, greatest(at + i - gap, 0) + 1, at + i + gap + 1 - greatest(at + i - gap, 0)), twords[i])))"))
    met = met.where(F.col("placed") + F.col("spare") >= F.size("twords"))
    files = index.where(F.col("term").isNull()).select("row", "doc_id", "n_words")
    return files, met.select("row", "label", "base", "start", (F.col("placed") / F.size("twords")).alias("score"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best share of a template's words in place, 0 without a label.
    """
    files, found = matches(docs, templates)
    found = found.groupBy("row").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    zero = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return files.join(found, "row", "left").select("doc_id", "n_words", *[F.coalesce(c, zero[c]).alias(c) if c in zero else c for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def oracle_sql(templates=TEMPLATES) -> str:
    """The same by plain search: every place of every template in every text."""
    listed = lambda xs: f"[{', '.join(repr(x) for x in xs)}]::VARCHAR[]"
    values = ", ".join(f"('{t.label}', {listed(t.words)}, '{t.keys[0]}', {listed(t.keys[1:])}, {t.key_at}, {len(t.keys[0].split())}, {t.spare}, {t.gap}, {str(t.base).lower()})" for t in templates)
    return rf"""
WITH t(label, tw, key, keys, ka, kl, spare, gap, base) AS (VALUES {values}),
d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
k AS (SELECT d.doc_id, t.*, unnest(list_filter(range(1, len(w) - kl + 2), lambda i: w[i] = string_split(key, ' ')[1] AND array_to_string(w[i:i + kl - 1], ' ') = key)) - ka AS s, w FROM d JOIN t ON contains(d.line, ' ' || key || ' ')),
v AS (SELECT *, ' ' || array_to_string(w[greatest(s - gap, 1):s + len(tw) - 1 + gap], ' ') || ' ' AS near FROM k),
m AS (SELECT doc_id, label, base, s - 1 AS start, spare, len(tw) AS n, len(list_filter(range(1, len(tw) + 1), lambda i: s + i - 1 + gap >= 1 AND list_contains(w[greatest(s + i - 1 - gap, 1):greatest(s + i - 1 + gap, 1)], tw[i]))) AS placed
  FROM v WHERE len(list_filter(keys, lambda x: contains(near, ' ' || x || ' '))) = len(keys)),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(placed / n) AS score FROM m WHERE placed + spare >= n GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)
"""
