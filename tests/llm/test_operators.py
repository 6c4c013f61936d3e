"""Each operator against brute force, planted cases and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import DATA, compare, connect
from pyspark.sql import functions as F

from seriesforge.llm import decontamination, exact_dedup, html_extract, language_id, license_scan, line_dedup, mixing, queries, sharding, simhash, substring_dedup
from seriesforge.llm.common import materialise

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert compare(df, connect(f"{DATA}/sf0.001"), queries.ORACLES[name]) == ""


# --- exact dedup


def test_exact_dedup_odd(odd, empty):
    got = sorted(exact_dedup.exact_dedup(odd).collect(), key=repr)
    assert len(got) == odd.count()
    assert Counter(r.kept for r in got if r.doc_id == 4) == {True: 1, False: 1}
    blank = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert sorted((r.doc_id or 0, r.kept, r.keep_id, r.group_size) for r in blank) == [(0, False, 1, 3), (1, True, 1, 3), (2, False, 1, 3)]
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_persists(spark, make, tmp_path):
    path = f"{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert sum(r.kept for r in first.add(make((5, "a b"), (3, "a  b"), (9, "c"))).collect()) == 2
    again = exact_dedup.DigestIndex(spark, path, 4)
    got = {r.doc_id: (r.kept, r.keep_id) for r in again.add(make((1, "a\tb"), (2, "new"))).collect()}
    assert got == {1: (False, 3), 2: (True, 2)} and again.table().count() == 3


def test_digest_index_keeps_its_buckets(spark, make, tmp_path):
    docs = make(*[(i, f"text {i}") for i in range(100)])
    for n, (first, then) in enumerate(((4, 64), (64, 4), (4, None))):
        index = exact_dedup.DigestIndex(spark, f"{tmp_path}/i{n}", first)
        assert sum(r.kept for r in index.add(docs).collect()) == 100
        index.close()
        again = exact_dedup.DigestIndex(spark, f"{tmp_path}/i{n}", then)
        assert again.buckets == first and sum(r.kept for r in again.add(docs).collect()) == 0 and again.table().count() == 100
        again.close()
    assert not [t for t in spark.catalog.listTables() if t.name in (index.name, again.name)]


def test_unfinished_calls_do_not_count(spark, make, tmp_path):
    import shutil

    docs = make(*[(i, f"text {i}") for i in range(20)])
    index = exact_dedup.DigestIndex(spark, f"{tmp_path}/i", 4)
    index.add(docs).count()
    shutil.rmtree(f"{tmp_path}/i/log")  # as if the driver was lost after the append
    assert sum(r.kept for r in exact_dedup.exact_dedup(docs, f"{tmp_path}/i").collect()) == 20
    assert sum(r.kept for r in exact_dedup.exact_dedup(docs, f"{tmp_path}/i").collect()) == 0
    spark.range(1).selectExpr("1 AS layout", "4 AS buckets").write.parquet(f"{tmp_path}/old/about")
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, f"{tmp_path}/old")


def test_heavy_groups_are_split(spark, make, monkeypatch):
    import seriesforge.llm.common as common

    rows = spark.range(150_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("digest"))
    rows = materialise(rows, "rows")
    groups = materialise(rows.groupBy("digest").agg(F.count("*").alias("n")), "groups")
    out = common.attach(rows, groups, "digest", "n")
    assert out.count() == 150_000 and out.where("digest = 'hot'").agg(F.min("n"), F.max("n")).first()[:] == (50_000, 50_000)


def test_both_sides_of_every_limit(spark, odd, monkeypatch):
    """Limits only choose how tables are joined: with all of them at their least, every result is the same."""
    import seriesforge.llm.common as common
    from seriesforge.llm import postings

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(30).withColumn("doc_id", F.col("doc_id") + 10**6)).unionByName(docs.limit(3))
    tests = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    runs = {
        "exact": lambda: exact_dedup.exact_dedup(docs),
        "near": lambda: simhash.near_duplicates(docs),
        "keep": lambda: simhash.keep_one(docs, simhash.similar),
        "lines": lambda: line_dedup.line_dedup(docs),
        "words": lambda: substring_dedup.substring_dedup(docs),
        "odd words": lambda: substring_dedup.substring_dedup(odd),
        "clean": lambda: decontamination.clean(docs, tests),
        "pages": lambda: html_extract.extract(pages),
    }
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = {name: rows(run()) for name, run in runs.items()}
    few = decontamination.windows(tests).count() // 2
    for module, name, value in (
        (common, "FEW_ROWS", 0), (common, "HEAVY_KEYS", 3), (simhash, "MAX_BROADCAST", 0), (simhash, "PARTITION_BYTES", 1_000_000), (substring_dedup, "MAX_BROADCAST", 0), (substring_dedup, "PACK_BYTES", 20_000), (substring_dedup, "PARTITION_BYTES", 200_000),
        (substring_dedup, "BUCKET_BYTES", 50_000), (postings, "MAX_BROADCAST", few), (html_extract, "MAX_COPIED", 0), (html_extract, "MAX_BROADCAST", 2), (html_extract, "MAX_TOKENS", 200),
    ):
        assert hasattr(module, name)
        monkeypatch.setattr(module, name, value)
    assert {name: rows(run()) for name, run in runs.items()} == want


# --- sharding


def test_shard_laws(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want
    loads, slots = Counter(), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r.slot)
    assert set(loads) == set(range(24)) and max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    got = sharding.shard(odd).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r.text_crc32 == 0} == {8}
    assert sharding.shard(empty).count() == 0


def test_copies_are_spread(make):
    docs = make(*[(i, "a copy of one text") for i in range(2400)], *[(5000 + i, f"text {i} " * (i % 9)) for i in range(4800)])
    rows = sharding.shard(docs, keep=("text",)).collect()
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 24 and {r.text for r in rows if r.doc_id == 3} == {"a copy of one text"}
    assert len({r["shard"] for r in rows if r.text == "a copy of one text"}) == 24


def test_map_versions(spark, make, tmp_path):
    sharding.shard(make(*[(i, "x" * (i % 50)) for i in range(300)]), 4, 64, f"{tmp_path}/map").count()
    slots = sharding.SlotMap(spark, f"{tmp_path}/map")
    assert {r.version for r in slots.versions().select("version").distinct().collect()} == {0, 1} and slots.latest().count() == 64
    moved = sharding.rebalance([0] * 64, [1 + i % 7 for i in range(64)], 4)
    loads = Counter()
    for i, s in enumerate(moved):
        loads[s] += 1 + i % 7
    assert max(loads.values()) - min(loads.values()) <= 1
    heavy = sharding.rebalance([0] * 500, [1 + i * i for i in range(500)], 3)
    loads = Counter()
    for i, s in enumerate(heavy):
        loads[s] += 1 + i * i
    full, empty = max(loads, key=loads.get), min(loads, key=loads.get)
    assert all(1 + i * i >= loads[full] - loads[empty] for i, s in enumerate(heavy) if s == full)


# --- mixing


def test_mix_targets(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes = {r.doc_id: len(WHITE.findall(r.text or "")) for r in docs.collect()}
    assert all(r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r.sid] += r.taken
        target[r.sid], size[r.sid] = r.target, r.source_size
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 50 and target[s] <= 3 * size[s] + 1e-6 for s in target)


def test_targets_brute(spark):
    rng = np.random.default_rng(0)
    for sizes in ([10, 0, 1000, 3], [5, 5, 5], [1], [0, 0], list(map(int, rng.integers(0, 10_000, 12)))):
        totals = spark.createDataFrame([(f"+{i:03d}", s) for i, s in enumerate(sizes)], "source_key string, source_size long")
        got = [r.target for r in mixing.targets(totals).orderBy("sid").collect()]
        w, total, full = [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes), set()
        while True:
            rest, weight = total - sum(3 * sizes[i] for i in full), sum(x for i, x in enumerate(w) if i not in full)
            want = [3 * s if i in full else rest * w[i] / weight for i, s in enumerate(sizes)]
            over = {i for i in range(len(sizes)) if want[i] > 3 * sizes[i] + 1e-9} - full
            if not over:
                break
            full |= over
        assert np.allclose(got, want)


def test_tiny_sources_beside_a_large_total(make):
    docs = [(i, "w " * 400, "large" if i % 2 else "big") for i in range(500)]
    docs += [(1000 + i, "w " * (5 + i % 11), f"tiny{i % 30:02d}") for i in range(300)]
    rows = mixing.mix(make(*docs), slots=1000).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r.sid] += r.taken
        target[r.sid], size[r.sid] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r["size"]
    tiny = [s for s in size if size[s] < 1000]
    assert len(tiny) == 30 and all(abs(taken[s] - target[s]) <= 1 for s in tiny)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in size)


def test_many_sources_are_shuffled(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_mix_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert sorted(map(repr, mixing.mix(odd).collect())) == sorted(map(repr, rows))
    assert mixing.mix(empty).count() == 0


# --- decontamination


def brute_hits(docs, tests, n=8):
    wins = {}
    for item, text in tests:
        w = ALNUM.findall(lower(text))
        for s in range(max(len(w) - n, 0) + 1) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, items = set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if found := wins.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return sorted(out, key=repr)


def test_decontamination_brute(spark, make):
    rng = np.random.default_rng(7)
    word = lambda k: " ".join(rng.choice(list("abcdeé"), k))
    tests = [(i, word(rng.integers(1, 14))) for i in range(12)] + [(20, "Zebra"), (21, None), (22, "..."), (20, "zebra"), (30, "x y x y x y x y x y")]
    docs = [(i, f"{word(40)} {rng.choice(['', tests[i % 12][1], 'ZEBRA!', 'x Y-x y x y x y x y x'])}; {word(20)}") for i in range(40)] + [(41, None), (42, ""), (43, "zebra"), (0, "zebra again"), (44, tests[0][1])]
    got = decontamination.decontaminate(make(*docs), spark.createDataFrame(tests, "item_id long, text string"))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()], key=repr) == brute_hits(docs, tests)


def test_many_terms_are_looked_up_in_parts(spark, monkeypatch):
    from seriesforge.llm import postings

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    tests = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    want = sorted(map(tuple, decontamination.decontaminate(docs, tests).collect()))
    kept = sorted(map(tuple, decontamination.clean(docs, tests).collect()), key=repr)
    n = decontamination.windows(tests).select(F.explode("win_words")).distinct().count()
    monkeypatch.setattr(postings, "MAX_BROADCAST", n // 4)
    assert sorted(map(tuple, decontamination.decontaminate(docs, tests).collect())) == want
    assert sorted(map(tuple, decontamination.clean(docs, tests).collect()), key=repr) == kept


def test_long_texts_take_time_in_proportion(spark, make):
    import time

    tests = spark.createDataFrame([(i, f"stock line {i} " + " ".join(f"t{i}x{j}" for j in range(8))) for i in range(50)], "item_id long, text string")
    took = {}
    for n in (1_000, 32_000, 64_000):
        # Every second pair of lines repeats, so half of the lines are covered by stretches of their own.
        body = "\n".join(f"same {i % 500 if i // 4 % 2 else i} line" for i in range(n))
        hits = " ".join(f"word{i} stock line {i % 50} " + " ".join(f"t{i % 50}x{j}" for j in range(8)) for i in range(n // 8))
        docs = make((1, body), (2, body + "\nend"), (3, hits))
        a = time.time()
        got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
        b = time.time()
        kept = decontamination.clean(docs, tests, items=100).collect()
        took[n] = (b - a, time.time() - b)
        assert got[2].n_lines == n + 1 and got[2].n_removed == n and len(kept) == 3
        assert {r.doc_id: r.text for r in kept}[3].split() == [f"word{i}" for i in range(n // 8)]
    assert all(b <= 2 * a + 2 for a, b in zip(took[32_000], took[64_000]))


def test_clean_cuts_and_drops(spark, make):
    a, b = "one two three four five six seven eight nine", "uno dos tres cuatro cinco seis siete ocho"
    tests = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    docs = make((1, f"Keep, this. {a.upper()}! And that."), (2, f"{a} {b}"), (3, "clean  text"), (4, None), (None, b + " rest"))
    got = {r.doc_id: (r.text, r.n_chars) for r in decontamination.clean(docs, tests).collect()}
    assert got == {1: ("Keep, this. And that.", 21), 3: ("clean  text", 11), 4: (None, None), None: ("rest", 4)}


def test_decontamination_odd(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    tests = spark.createDataFrame([(1, "a b c"), (None, "no id here")], "item_id long, text string")
    got = decontamination.decontaminate(odd, tests).collect()
    assert len(got) == odd.count() and sum(r.n_items for r in got) == 2 and [r.n_hit for r in got if r.doc_id is None and r.n_words] == [3]
    assert decontamination.decontaminate(empty, tests).count() == 0 and decontamination.decontaminate(odd, none).count() == odd.count()
    kept = decontamination.clean(odd, tests)
    assert kept.columns == odd.columns and all(r.cuts == r.k_id == "x" for r in kept.collect())


# --- licences


def test_license_scan_cases(make, odd, empty):
    docs = make((1, "Released Under the MIT License. under-the mit LICENSE"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "CC BY-NC 4.0, cc by sa"), (4, "under the mit"), (5, "apache license version 2 apache license, version 2.0"), (6, "the gnu general public license version 2 applies"))
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(docs).collect()}
    assert got[1] == (2, 1, 5, "mit", "mit") and got[2] == (0, None, None, "", "gpl-3") and got[3] == (1, 0, 0, "cc-by-nc", "cc-by-nc,cc-by-sa")
    assert got[4] == (0, None, None, "", "") and got[5] == (2, 0, 4, "apache-2", "apache-2") and got[6][4] == "gpl-2"
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


NOTICES = {
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3": "// SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd": "Redistribution and use in source and binary forms (of this library), with or without modification, are permitted provided that the following conditions are met:",
    "mit": "Permission is hereby granted, free of charge, to any individual or person obtaining a copy of this software and associated documentation files",
    "lgpl,lgpl-2.1": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "isc": "Permission to use, copy, modify, and distribute this software",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


def test_notices_with_changes(spark, make, tmp_path):
    docs = [(i, f"Some words before. {t} And after.") for i, t in enumerate(NOTICES.values())]
    docs += [(50, "permission is hereby granted free of charge to park here"), (51, "the general public of the license"), (52, NOTICES["bsd"] + " " + NOTICES["mit"])]
    got = {r.doc_id: r.labels for r in license_scan.scan(make(*docs)).collect()}
    want = {i: ("" if label == "isc" else label) for i, label in enumerate(NOTICES)}  # the key phrase of isc is cut short
    assert got == {**want, 50: "", 51: "", 52: "bsd,mit"}
    make(*docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(license_scan.scan(make(*docs)), connect(str(tmp_path)), license_scan.oracle_sql()) == ""


def test_every_notice_gets_its_label(make):
    docs = [(i, " ".join(["before", *t.words, "after"])) for i, t in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(make(*docs)).collect()}
    assert all(t.label in got[i] for i, t in enumerate(license_scan.TEMPLATES)) and len({t.label for t in license_scan.TEMPLATES}) >= 25


# --- substring dedup


def brute_kept(docs, n=20):
    first, out = {}, []
    key = lambda d: 2**63 - 1 if d is None else d
    words = [(d, (WHITE.findall(t) if t else [])) for d, t in docs]
    for d, w in words:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, (key(d), s)), (key(d), s))
    for d, w in words:
        gone = {i for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < (key(d), s) for i in range(s, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_brute(make):
    rng = np.random.default_rng(11)
    for letters, seed in (("a", 0), ("ab", 1), ("abcdefghij", 2)):
        base = list(rng.choice(list(letters), 70))
        docs = []
        for i in range(30):
            a = int(rng.integers(0, 40))
            docs.append((int(i * 3 % 31), " ".join([*rng.choice(list(letters), int(rng.integers(0, 30))), *base[a : a + int(rng.integers(10, 60))], *rng.choice(list(letters), 5)])))
        docs += [(None, " ".join(base)), (90, None), (91, ""), (90, " ".join(base)), (90, " ".join(base))]
        got = substring_dedup.substring_dedup(make(*docs)).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == brute_kept(docs)


def test_substring_dedup_odd(odd, empty):
    got = substring_dedup.substring_dedup(odd, with_text=True).collect()
    assert len(got) == odd.count()
    long = {r.doc_id: r for r in got}
    assert long[6].n_words == 30_001 and long[6].n_words - long[6].n_removed <= 1 + 19
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_a_common_passage_does_not_fill_its_bucket(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PACK_BYTES", 400_000)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.range(200_000).selectExpr("id AS doc_id", f"concat('a', id, ' b', id % 7, ' {passage} c', id) AS text")
    texts = substring_dedup._keyed(docs).select("doc", "tag", F.col("text").cast("binary").alias("text"))
    common = substring_dedup.common_minimisers(texts, texts.agg(F.sum(F.length("text"))).first()[0], 20, substring_dedup.BUCKET_BYTES)
    sizes = texts.mapInArrow(substring_dedup._packed(20, 20, common), "bucket long, blob binary, size long")
    sizes = {r.bucket: r.n for r in sizes.groupBy("bucket").agg(F.sum("size").alias("n")).collect()}
    assert max(sizes.values()) <= 4 * substring_dedup.BUCKET_BYTES
    got = substring_dedup.substring_dedup(docs).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in got} == {(0, 1), (40, 6), (41, 199_993)}  # with the word before the passage, which has 7 values


def test_a_common_phrase_is_spread(spark, make, monkeypatch):
    rng = np.random.default_rng(12)
    phrase = "click here to subscribe"
    docs = [(i, " ".join([*(f"x{v}" for v in rng.integers(0, 10**6, 20)), phrase, *(f"y{v}" for v in rng.integers(0, 10**6, 20))])) for i in range(300)]
    docs += [(400 + i, docs[i][1] + " tail") for i in range(0, 300, 10)]
    monkeypatch.setattr(substring_dedup, "SAMPLE_SHARE", 1.0)
    keyed = substring_dedup._keyed(make(*docs))
    texts = keyed.select("doc", "tag", F.col("text").cast("binary").alias("text"))
    common = substring_dedup.common_minimisers(texts, 100_000, 20, 60_000)
    _, _, _, least = substring_dedup.super_kmers([phrase.encode().split()], 4)
    if least[0] in np.concatenate([substring_dedup.super_kmers([t.encode().split()])[3] for _, t in docs]):
        assert least[0] in common
    want = brute_kept(docs)
    for some in (np.zeros(0, np.uint64), least, np.sort(np.concatenate([least, common]))):
        monkeypatch.setattr(substring_dedup, "common_minimisers", lambda *a, some=some: np.unique(some))
        got = substring_dedup.substring_dedup(make(*docs)).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=repr) == want


def test_hash_collisions_are_compared(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_roll", lambda x, n: np.zeros(len(x) - n + 1, np.uint64))
    words = [[b"%d" % (i + j) for j in range(25)] for i in range(3)] + [[b"%d" % j for j in range(25)]]
    strings = [b" ".join(w) for w in words]
    doc, tag, a, b = substring_dedup.repeated_places(strings, np.arange(4), np.arange(4), np.zeros(4, int), np.zeros(4, int))
    gone = {(int(d), i) for d, x, y in zip(doc, a, b) for i in range(x, y)}
    assert gone == {(1, i) for i in range(24)} | {(2, i) for i in range(24)} | {(3, i) for i in range(25)}


# --- line dedup


def test_line_dedup_brute(make):
    rng = np.random.default_rng(21)
    docs = [(int(i), "\n".join(rng.choice(["a", "b", "", "c d", "é"], int(rng.integers(1, 14))))) for i in rng.permutation(40)]
    docs += [(None, docs[0][1]), (50, None), (51, ""), (52, "x\ny"), (3, "a\nb\nc d\nlast"), (53, "\n\n\n\n"), (60, docs[5][1]), (60, docs[5][1])]
    key = lambda d: 2**63 - 1 if d is None else d
    lines = [(d, t.split("\n") if t else []) for d, t in docs]
    first, want = {}, []
    for d, ls in lines:
        for s in range(len(ls) - 2):
            k = tuple(ls[s : s + 3])
            first[k] = min(first.get(k, (key(d), s)), (key(d), s))
    for d, ls in lines:
        gone = {i for s in range(len(ls) - 2) if first[tuple(ls[s : s + 3])] < (key(d), s) for i in range(s, s + 3)}
        body = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        want.append((d, len(ls), len(gone), hashlib.sha256(body.encode()).hexdigest()))
    got = line_dedup.line_dedup(make(*docs)).collect()
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got], key=repr) == sorted(want, key=repr)


def test_line_dedup_odd(odd, empty):
    assert line_dedup.line_dedup(odd, with_text=True).count() == odd.count() and line_dedup.line_dedup(empty).count() == 0


# --- near duplicates


def test_fingerprint_and_components_brute(spark, make):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 900, 400)]
    docs = []
    for i in range(60):
        w = list(base) if i % 2 else [f"v{x}" for x in rng.integers(0, 900, 120)]
        for p in rng.integers(0, len(w), i % 7):
            w[p] = "Changed"
        docs.append((100 - i, " ".join(w)))
    docs += [(1, None), (2, ""), (3, "One two"), (3, "one TWO"), (200, docs[5][1])]
    got = sorted(simhash.near_duplicates(make(*docs)).select("doc_id", "fingerprint", "component_id").collect())
    fps = []
    for d, t in docs:
        w = WHITE.findall(lower(t))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    assert [tuple(r) for r in got] == sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs))


def test_links_lose_no_connection(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20, 20, 3), dtype=np.uint64), axis=2)
    fps = np.unique(np.concatenate([centres, (centres[:, None] ^ flips).ravel()]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()

    def groups(pairs):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(y for y in root if find(y) == r) for r in {find(x) for x in root}}

    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    signed = fps.view(np.int64)
    assert groups([(r.a, r.b) for r in edges]) == groups([(int(signed[i]), int(signed[j])) for i, j in near])


def test_similar_texts_link(spark, make):
    rng = np.random.default_rng(14)
    docs, pairs, clean = [], [], []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        copy = list(words)
        for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.015, 0.02])))):
            copy[at] = f"new{rng.integers(0, 10**6)}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    alike = {i: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(150)}
    got = {r.doc_id: r.component_id for r in simhash.similar(make(*docs, (900, None), (901, ""), (902, docs[0][1]))).collect()}
    near = [i for i in alike if alike[i] >= 0.8]
    assert len(near) > 80 and sum(got[2 * i] == got[2 * i + 1] for i in near) >= 0.9 * len(near)
    assert all(got[2 * i] != got[2 * i + 1] for i in alike if alike[i] < 0.6) and len({got[2 * i] for i in alike}) == 150
    assert got[900] == got[901] == 900 and got[902] == 0


def test_wide_budgets():
    assert simhash.budget(512, 0.8, 0) == 77 and simhash.budget(512, 1.0, 3) == 0
    keys = simhash.chain_keys(np.arange(16, dtype=np.uint64).reshape(2, 8) * np.uint64(0x0101010101010101))
    assert keys.shape == (2, 256) and len(set(keys[0].tolist())) == 256
    hashes = simhash.shingle_hashes(b"a b c d e f g", 5)
    assert len(hashes) == 3 and simhash.wide_fingerprint(None).tolist() == [0] * 8


def test_wide_links_lose_no_connection_and_stay_few(spark):
    rng = np.random.default_rng(15)
    base = [[f"w{g}x{i}" for i in range(200)] for g in range(2)]
    wide = []
    for g, changes in [(0, 2)] * 400 + [(1, 5)] * 400:
        words = list(base[g])
        for at in rng.integers(0, 200, changes):
            words[at] = f"new{rng.integers(0, 10**9)}"
        wide.append(simhash.wide_fingerprint(" ".join(words).encode()))
    wide = np.array(list({int(w[0]): w for w in wide}.values()))
    fps, keys = wide[:, 0], simhash.chain_keys(wide)
    rows = [(int(w[0]), [int(x) for x in w]) for w in wide.view(np.int64)]
    edges = [(r.a, r.b) for r in simhash.wide_links(spark.createDataFrame(rows, "fp long, words array<long>")).collect()]
    assert len(edges) <= 4 * len(fps)

    root = {int(x): int(x) for x in fps.view(np.int64)}

    def groups(pairs):
        up = dict(root)

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        found = {}
        for x in up:
            found.setdefault(find(x), set()).add(x)
        return {frozenset(f) for f in found.values()}

    near, most = simhash.budget(64, 0.8, simhash.PRUNE), simhash.budget(512, 0.8, simhash.DECIDE)
    linked, loose = [], []
    for i in range(len(fps) - 1):
        alike = np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1) <= most
        meet = alike & (keys[i + 1 :] == keys[i]).any(axis=1)
        close = np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= near
        linked += [(rows[i][0], rows[i + 1 + j][0]) for j in np.flatnonzero(meet & close)]
        loose += [(rows[i][0], rows[i + 1 + j][0]) for j in np.flatnonzero(meet)]
    got = groups(edges)
    assert groups(edges + linked) == got  # all pairs that meet are connected
    assert groups(edges + loose) == groups(loose) and len(got) > 50  # and nothing else


def test_star_rounds_split_their_hub(spark):
    n = 60_000
    edges = spark.range(1, n).selectExpr("0L AS a", "id AS b").unionByName(spark.range(n - 1).selectExpr("id + 1 AS a", "id + 2 AS b"))
    found = simhash.components(edges)
    assert found.agg(F.count("*"), F.min("root"), F.max("root")).first()[:] == (n, 0, 0)
    chain = simhash.components(spark.range(10_000).selectExpr("(id * 7919) % 10007 AS a", "((id + 1) * 7919) % 10007 AS b"))
    assert chain.select("root").distinct().count() == 1 and chain.count() == 10_000


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect())[4] == 1 and kept.where("text_hash = 'x' and k_id = 'x'").count() == kept.count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar(empty).count() == 0
    kept = simhash.keep_one(odd, simhash.similar)
    assert kept.columns == odd.columns and simhash.similar(odd).count() == odd.count() and kept.where("doc_id in (1, 2, 3)").count() == 1


# --- language


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = queries.QUERIES["op8_language_id"](spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert len(out) > 150 and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_language_kernel_brute():
    texts = ["abc abd", "xyz xya zz", "abca bda", "zyx"]
    langs = ["p", "q", "p", "q"]
    model = language_id.fit(texts, langs, landmarks=4)

    def grams(t):
        line = "".join(c if c.isalpha() else " " for c in t.lower())
        return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)} - {" "}

    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    order = [0, 2, 1, 3]
    k = np.array([[kernel(t, texts[j]) for j in order] for t in texts])
    values, vectors = np.linalg.eigh(k[order])
    z = np.hstack([k @ (vectors / np.sqrt(values)), np.ones((4, 1))])
    y = np.array([[1.0 if x == n else -1.0 for n in ("p", "q")] for x in langs])
    w = np.linalg.solve(z.T @ z + language_id.RIDGE * 4 * np.eye(5), z.T @ y)
    want = z @ w
    got = language_id.product([language_id.grams(t, model["letters"]) for t in texts], model)
    assert np.allclose(got, want, atol=1e-4) and language_id.predict([None, "", "12 ..", "abc"], model)[0] == ["und", "und", "und", "p"]


SCRIPTS = {"la": (0x61, 26), "ru": (0x430, 32), "el": (0x3B1, 25), "hi": (0x915, 37), "th": (0xE01, 46), "ko": (0xAC00, 900), "zh": (0x4E00, 1500), "ja": (0x3041, 83), "he": (0x5D0, 27), "ka": (0x10D0, 33), "ar": (0x628, 20)}


def test_every_script_is_told(spark, make):
    rng = np.random.default_rng(8)

    def text(lang):
        low, n = SCRIPTS[lang]
        return " ".join("".join(chr(low + int(x)) for x in rng.integers(0, n, 4)) for _ in range(30))

    langs = [name for name in SCRIPTS for _ in range(40)]
    model = language_id.fit([text(x) for x in langs], langs)
    tests = [name for name in SCRIPTS for _ in range(30)]
    got = language_id.predict([text(x) for x in tests], model)[0]
    right = Counter(g == t for g, t in zip(got, tests))
    assert right[True] >= 0.97 * len(tests)


def test_long_text_in_pieces(monkeypatch):
    known = language_id.letters()
    text = "".join(np.random.default_rng(2).choice(list("abcé 中文字"), 5000))
    want = language_id.grams(text, known)
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert (language_id.grams(text, known) == want).all()
    assert len(language_id.grams("", known)) == 0 and len(language_id.grams("x", known)) == 1


def test_language_odd(spark, odd, empty):
    model = language_id.fit(["hello there you", "bonjour les amis"], ["en", "fr"])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, model).collect() if r.doc_id}
    assert got[1] == got[2] == got[3] == "und" and got[5] in ("en", "fr")
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(odd)).collect()} == {"und"}


# --- pages

PAGE = (
    "<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class=page><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad -->"
    '<div class="cookie-notice">We use cookies</div><div class="ad">Buy {i}</div><article><header><h2>Title {i}</h2></header><p>First &amp; <b>bold</b>\n word{i}<br>line<p>Second &eacute;&nbsp;{i}'
    '<p>Share this now<form><input>Mail</form><div class="comments"><p>nice {i}</p></div><p>a < b {i}</article><aside>More</aside><footer>&copy; {i}</footer>'
)


def test_extract_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(20)] + [(50, None, None), (51, "x", ""), (52, "http://o.example/", "just text &lt; <p>two"), (53, "http://H.example/x", PAGE.format(i=53)), (53, "http://h.example/x", PAGE.format(i=53))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "tokens": F.lit(2), "text": F.lit(3)})
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()]
    want = "\n\n".join(["Title 3", "First & bold word3 line", "Second é 3", "Share this now", "a < b 3"])
    assert (3, want, len(want)) in got and len(got) == len(rows)
    assert (50, "", 0) in got and (51, "", 0) in got and (52, "just text <\n\ntwo", 16) in got
    assert html_extract.extract(df.limit(0)).count() == 0


def pages_of(spark, *htmls):
    return spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def texts_of(spark, *htmls):
    return [r.text for r in html_extract.extract(pages_of(spark, *htmls)).orderBy("page_id").collect()]


def test_odd_pages_leave_the_template(spark):
    page = '<html><body><div class="x0"><p>Brought to you by the desk {j}</p></div><div class="x1"><p>Story {i} of the day</p></div><p>Bye</p></body></html>'
    odd = [None, " ", "<html><body><h1>Error</h1></body></html>"] + ["<html><body><p>Copied</p></body></html>"] * 30
    got = texts_of(spark, *[page.format(i=i, j="") for i in range(20)], *odd)
    assert got[:20] == [f"Story {i} of the day" for i in range(20)]
    assert got[20] == got[21] == "" and got[22] == "Error" and got[23] == "Copied"


def test_hosts_of_any_size_give_the_same_article(spark):
    page = '<body><nav>Menu</nav><div class="k9">All about us</div><article><p>Intro all share</p><p>Body {i} goes on</p><p class="share">Same closing sentence</p><div class="related-work">Older work</div><div class="social">A social part</div><section id="notice">Notice this</section></article><footer>End</footer></body>'
    for n in (1, 2, 9, 12):
        want = [f"Intro all share\n\nBody {i} goes on\n\nSame closing sentence\n\nOlder work\n\nA social part\n\nNotice this" for i in range(n)]
        assert texts_of(spark, *[page.format(i=i) for i in range(n)]) == want


def test_the_template_finds_what_names_do_not(spark):
    # No name tells the boxes apart; a teaser is an article element, and the story is in a plain container.
    page = '<html><body><div class="a"><ul><li>Start</li><li>Sport and weather</li></ul></div><article>Try our app today</article><div class="b"><h1>Head {i}</h1><div class="c"><p>{body}</p></div><p>More {i} on this</p></div><div class="d"><p>All rights with the paper and its owners</p></div></body></html>'
    rng = np.random.default_rng(3)
    bodies = [" ".join(f"w{x}" for x in rng.integers(0, 99, 40)) for _ in range(12)]
    htmls = [page.format(i=i, body=b) for i, b in enumerate(bodies)]
    want = [f"Head {i}\n\n{b}\n\nMore {i} on this" for i, b in enumerate(bodies)]
    short = page.format(i=12, body="Brief")
    got = texts_of(spark, *htmls, short)
    assert got == [*want, "Head 12\n\nBrief\n\nMore 12 on this"]
    assert html_extract.main_text(short) != got[12] and "Start" in html_extract.main_text(short)


def brute_texts(pages):
    """Occurrence vectors laid out over a host's different pages, classes by equal vectors, then the same choice of the article."""
    out, hosts = {}, {}
    for page_id, url, html in pages:
        hosts.setdefault(re.sub("^[a-z]+://([^/?#]*).*", r"\1", url or "", flags=re.S), []).append((page_id, html))
    for rows in hosts.values():
        different = sorted({h for _, h in rows if h and h.strip()})
        read = {h: html_extract.read(h) for h in different}
        seen = [Counter(read[h].keys) for h in different]
        always = {k for c in seen for k in c if sum(k in x for x in seen) >= 0.8 * len(seen)}
        # characters of varying text below each container of the template, and which of them is gone into
        weight, kinds, around = Counter(), {}, {}
        for h in different:
            p = read[h]
            around |= p.around
            for k, kind, path, text in zip(*p[:4]):
                kinds[k] = kind
                if text and (len(different) < 2 or k not in always):
                    while True:
                        weight[path] += len(text)
                        if not path:
                            break
                        path = p.around[path]

        def chosen(boxes, weight):
            named = {b for b in boxes if kinds[b] == html_extract.ARTICLE and not any(kinds[b[:i]] == html_extract.ARTICLE for i in range(len(b)) if b[:i] in boxes)}
            if weight[""] and 2 * sum(weight[b] for b in named) >= weight[""]:
                return named
            now = ""
            while weight[now]:
                within = [b for b in boxes if b and around[b] == now]
                best = max(within, key=lambda b: weight[b], default=None)
                if best is None or weight[best] < 0.8 * weight[now] or weight[now] - sum(weight[b] for b in within) > 0.02 * weight[now]:
                    break
                now = best
            return {now} if html_extract._deep(now) else set()

        boxes = {k for k in always if kinds[k] >= html_extract.CONTAINER}
        shared = chosen(boxes, weight) if len(different) > 1 else set()
        for page_id, html in rows:
            p = read.get(html)
            if p is None:
                out[page_id] = ""
                continue
            main = shared if shared <= set(p.keys) else set()
            if not main:
                fixed = always if len(different) > 1 else set()
                main = {b for b in html_extract.own_article(p, {html_extract._hash(k) for k in fixed if kinds[k] == html_extract.TEXT})}
            else:
                fixed = set()

            def inside(path):
                while path:
                    if path in main:
                        return True
                    path = p.around[path]
                return False

            out[page_id] = "\n\n".join(t for k, t, path in zip(p.keys, p.texts, p.paths) if t and (inside(path) if main else k not in fixed))
    return out


def test_extraction_brute(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    rng = np.random.default_rng(5)
    for i in range(60):  # other layouts beside the given ones, some of them odd pages of their host
        body = " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 30))))
        box = f'<div class="b{i % 3}"><p>{body}</p><p>Fixed of {i % 3}</p></div>' if i % 7 else f"<p>{body}</p>"
        rows.append((10**6 + i, f"http://odd{i % 3}.example/{i}", f'<html><body><div class="top">Site {i % 3}</div>{box}<p>Same foot</p></body></html>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == brute_texts(rows)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>Block {i}</p>" for i in range(50_000)) + "</article>"
    got = texts_of(spark, deep, long, "<", "<p", "&#0;&bogus;<p>x</p></p></div>", "<article></article><p>out</p>", "\x00<b>z")
    assert got[0] == "deep" and got[1].count("\n\n") == 49_999 and got[3] == "<p" and got[5] == "out"
    assert len(got) == 7 and "x" in got[4]


def test_few_or_equal_pages_keep_their_text(spark):
    html = "<html><body><article><p>Same text</p></article></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", html) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(df).collect()} == {"Same text"}


def test_vectors_add_up(spark, monkeypatch):
    from functools import reduce

    rows = [(f"h{i % 3}", PAGE.format(i=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, html string")
    read = lambda d: {(r.host, frozenset((t.token, t["rank"], t["size"]) for t in r.tokens)) for r in html_extract.templates(d).collect()}
    a, b = (read(d) for d in (df.coalesce(1), df.repartition(7)))
    monkeypatch.setattr(html_extract, "MAX_BROADCAST", 1)
    monkeypatch.setattr(html_extract, "MAX_COPIED", 0)
    assert a == b == read(df) and len(a) == 3 and reduce(min, (len(x[1]) for x in a)) > 10


def test_crossing_classes_are_dropped():
    classes = {1: (10, 0), 2: (10, 1), 3: (20, 0), 4: (20, 1)}
    assert html_extract.valid_tokens([1, 3, 4, 2], classes) == {1, 2, 3, 4}
    assert html_extract.valid_tokens([1, 3, 2, 4], classes) == {1, 2}
    assert html_extract.valid_tokens([2, 1, 3, 4], classes) == {3, 4}
