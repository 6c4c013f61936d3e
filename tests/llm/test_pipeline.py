"""The pipeline against a plain walk through its stages."""

import re
from collections import Counter

import pytest
from oracle import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from seriesforge.llm import language_id  # noqa: E402
from seriesforge.llm.common import materialise  # noqa: E402


def held_to_brute_force(docs, kept):
    """The near-duplicate stage against the similarity of all pairs: it finds what is alike and leaves the rest alone."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for d, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    having = {}
    for d in sorted(sets):
        for s in sets[d]:
            having.setdefault(s, []).append(d)
    pairs = {(a, b) for ds in having.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    near = [(a, b) for (a, b), j in alike.items() if j >= 0.8]
    kept = set(kept)
    assert len(near) > 50 and sum(not (a in kept and b in kept) for a, b in near) >= 0.9 * len(near)
    linked = {d for (a, b), j in alike.items() if j >= 0.6 for d in (a, b)}
    assert not set(texts) - kept - linked
    smaller = {}
    for (a, b), j in alike.items():
        if j == 1:
            smaller[b] = min(smaller.get(b, b), a)
    assert not set(smaller) & kept  # of equal texts only the smallest doc_id may stay


def test_stages(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontamination", "source_mixing", "sharding"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf), name))
        if name != "sharding":
            assert seen[-1].columns == docs.columns
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    model = language_id.train(docs)
    texts = docs.select("doc_id", "text").collect()
    langs, scores = language_id.predict([r.text for r in texts], model)
    assert sorted(ids[1]) == sorted(r.doc_id for r, a, s in zip(texts, langs, scores) if a != "und" and s >= corpus_pipeline.LEAST_SCORE)
    held_to_brute_force(seen[1], ids[2])
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {tuple(w[i : i + 8]) for w in (words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in bench) for i in range(max(len(w) - 8, 0) + 1)}
    for r in seen[3].select("text").collect():
        w = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        assert not any(tuple(w[i : i + 8]) in wins for i in range(len(w)))
    assert max(Counter(ids[4]).values()) <= 3 and set(ids[4]) <= set(ids[3])
    assert sorted(ids[5]) == sorted(ids[4])


def test_odd_rows_pass(spark, odd, tmp_path):
    sf = f"{DATA}/sf0.001"
    n = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, odd, sf), name)
        again = materialise(stage(spark, odd.limit(0), sf), name)
        assert again.count() == 0
        rows = out.collect()
        if name != "sharding":
            assert out.columns == odd.columns and all(r.shard == r["size"] == "x" for r in rows)
        if name == "language_id":  # odd has no labels, so no text has a language
            assert not rows
        if name == "simhash":  # null and blank texts are alike, as the long ones, and a null doc_id is never the smallest
            assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 4, 5, 7, 7, 8]
        if name == "decontamination":
            assert len(rows) == n and sum(r.text is None for r in rows) == 2
        if name == "source_mixing":
            assert all(r.text and r.text.strip() for r in rows) and max(Counter((r.doc_id, r.text) for r in rows).values()) <= 6
        if name == "sharding":
            assert len(rows) == n and sum(r.text is None for r in rows) == 2 and {r["size"] for r in rows if r.text is None} == {8}


def test_labelled_odd_rows_keep_their_language(spark, odd):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").unionByName(odd.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    out = corpus_pipeline.identify_language(spark, docs, f"{DATA}/sf0.001").collect()
    assert all(r.text and any(map(str.isalpha, r.text)) for r in out) and any(r.doc_id and r.doc_id > 1000000 for r in out)
