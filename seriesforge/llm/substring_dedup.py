"""Substring deduplication by super-k-mer partitioning.

A window is 20 consecutive words. Its minimiser is the least hash of its 4-word sequences; the
consecutive windows of a document that share their minimiser overlap so much that they travel as
one packed string (a super-k-mer) to the minimiser's bucket, and equal windows always meet there.
A bucket gives its words numbers, sorts the windows' rolling hashes and compares equal
hashes word by word, so the count is exact.

Copies are settled before the shuffle: of equal super-k-mers that a task packs together, all but
the earliest also start earlier, so their places are removed at once and only the earliest travels
to the bucket. A passage that stands in every document so costs its bucket a string for each pack
of ``PACK_BYTES``. Sequences that would be the minimiser of more text than a bucket should hold (by a
sample, which decides nothing but where windows meet) rank behind all others, so a common
phrase does not draw all windows around it to one bucket. Buckets and partitions are made in
proportion to the bytes of all texts, so one fits a task's memory at any size. Only places of
removed words come back to the documents, by a join on the doc_id.

Defined results: a null or empty text has no words; a text of fewer than 20 words keeps them all;
rows that share a doc_id count as one document, so equal places of theirs are none earlier and
equal rows get equal results; a null doc_id comes after every other one; an empty table gives no
rows; a very long text is one document, packed alone if it is larger than a pack. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 20
MINIMISER = 4
#: Bytes of packed text that a bucket should hold.
BUCKET_BYTES = 6_000_000
#: Bytes of text that a task packs at once: more combines more copies and takes more memory.
PACK_BYTES = 8_000_000
#: Bytes of packed text for each partition of the shuffle to the buckets.
PARTITION_BYTES = 24_000_000
#: Texts sampled to find common minimisers: their bytes, and their most share of the corpus.
SAMPLE_BYTES = 64_000_000
SAMPLE_SHARE = 1 / 16
#: At most so many minimisers rank last.
MOST_COMMON = 100_000
#: Up to so many doc_ids that several rows share are broadcast.
MAX_BROADCAST = 1_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)  # odd, with bits set all over
_LAST = np.uint64(1 << 63)  # set in the rank of a common minimiser


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    span, out = 1, x
    while 2 * span <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = n - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _roll(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, from the hashes of 1, 2, 4, ... values."""
    power = {1: _MULTIPLY}
    level, span, out, done = x, 1, None, 0
    size = len(x) - n + 1
    while span <= n:
        if n & span:
            part = level[done : done + size]
            out = part if out is None else out * power[span] + part
            done += span
        if 2 * span <= n:
            power[2 * span] = np.uint64(int(power[span]) ** 2 % 2**64)
            level = level[:-span] * power[span] + level[span:]
        span *= 2
    return out


def super_kmers(docs: list[list[bytes]], window: int = WINDOW, m: int = MINIMISER, common: np.ndarray | None = None):
    """Runs of windows that share a minimiser: (document, first word, packed string, minimiser).

    ``common`` (sorted) has the minimisers that rank behind all others.
    """
    docs_at = [(i, w) for i, w in enumerate(docs) if len(w) >= window]
    if not docs_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.uint64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for _, words in docs_at for w in words], np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))[ids]
    ranks = _mix(_roll(hashes, m)) & ~_LAST
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, ranks), len(common) - 1)
        ranks = np.where(common[at] == ranks, ranks | _LAST, ranks)
    least = _slide_min(ranks, window - m + 1)  # one for each window start of the whole line
    sizes = np.array([len(w) for _, w in docs_at])
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(docs_at)), sizes)[: len(least)]
    at = np.arange(len(least)) - first[doc]
    real = at <= sizes[doc] - window
    starts = np.flatnonzero(real & np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    # A run ends before the next one starts, or with the last window of its document.
    ends = np.minimum(np.r_[starts[1:], len(least)], (first + sizes - window + 1)[doc[starts]]) + window - 1
    line = b" ".join(w for _, words in docs_at for w in words)
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(w) + 1 for _, words in docs_at for w in words], out=offsets[1:])
    texts = [line[a:b] for a, b in zip(offsets[starts].tolist(), (offsets[ends] - 1).tolist())]
    return np.array([i for i, _ in docs_at])[doc[starts]], at[starts], texts, least[starts]


_CODEC = "zstd"


def pack(strings: list[bytes], sid: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, long: np.ndarray | None = None) -> tuple[bytes, int]:
    """Strings and places as bytes, and their size unpacked; settled places carry ``long``, their words, for a string's number."""
    head = np.array([len(sid)], np.int64).tobytes()
    sid = np.cumsum(long) if long is not None else sid
    raw = b"".join([head, np.diff(sid, prepend=0).astype(np.int32).tobytes(), np.diff(doc, prepend=0).tobytes(), tag.tobytes(), start.astype(np.int32).tobytes(), b"\n".join(strings)])
    return pa.compress(raw, codec=_CODEC, asbytes=True), len(raw)


def unpack(blob: bytes, size: int):
    raw = pa.decompress(blob, decompressed_size=size, codec=_CODEC, asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at = 8
    parts = []
    for kind in (np.int32, np.int64, np.int64, np.int32):
        part = np.frombuffer(raw, np.uint8, n * np.dtype(kind).itemsize, at).view(kind) if n else np.zeros(0, kind)
        at += part.nbytes
        parts.append(part)
    sid, doc, tag, start = parts
    return raw[at:].split(b"\n"), np.cumsum(sid, dtype=np.int64), np.cumsum(doc, dtype=np.int64), tag, start.astype(np.int64)


def _first_places(sid: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray):
    """Which rows, in the order of (sid, doc, start, tag), are the earliest of their string, ties with them
    included, and which repeat a row wholly."""
    new = np.r_[True, np.diff(sid) != 0]
    lead = np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(sid)]))
    again = np.r_[False, ~new[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (tag[1:] == tag[:-1])]
    return (doc == doc[lead]) & (start == start[lead]), again


def _packed(buckets: int, window: int, common: np.ndarray):
    """Arrow batches of (doc, tag, text) -> (bucket, blob, size): the earliest place of each string of a pack for
    the string's bucket, and the places of its copies, settled already, for a bucket below zero."""

    def flush(held):
        if not held:
            return None
        doc, tag, start, least = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 4))
        texts = [t for h in held for t in h[3]]
        bucket = (_mix(least) % np.uint64(buckets)).astype(np.int64)
        number: dict[bytes, int] = {}
        sid = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        order = np.lexsort((tag, start, doc, sid))
        first, again = _first_places(sid[order], doc[order], tag[order], start[order])
        later = order[~first & ~again]
        out = []
        if len(later):
            sizes = np.fromiter((t.count(b" ") + 1 for t in number), np.int64, len(number))
            later = later[np.lexsort((start[later], doc[later]))]
            spans = pack([], np.zeros(len(later), np.int64), doc[later], tag[later], start[later], sizes[sid[later]])
            out.append((-1 - int(_mix(doc[later[:1]].astype(np.uint64))[0] % np.uint64(buckets)), *spans))
        order = order[first & ~again]
        order = order[np.lexsort((start[order], doc[order], bucket[order]))]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            number = {}
            sids = np.array([number.setdefault(texts[i], len(number)) for i in at.tolist()], np.int64)
            out.append((int(bucket[at[0]]), *pack(list(number), sids, doc[at], tag[at], start[at])))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["bucket", "blob", "size"])

    def run(batches):
        held, held_bytes, words, ids, tags, now = [], 0, [], [], [], 0

        def cut():
            at, start, texts, least = super_kmers(words, window, common=common)
            if texts:
                held.append((np.array(ids, np.int64)[at], np.array(tags, np.int64)[at], start, texts, least))

        for batch in batches:
            for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not text:
                    continue
                words.append(text.split())
                ids.append(doc)
                tags.append(tag)
                now += len(text)
                if now > PACK_BYTES // 8:
                    cut()
                    held_bytes += now
                    words, ids, tags, now = [], [], [], 0
                    if held_bytes > PACK_BYTES:
                        if (out := flush(held)) is not None:
                            yield out
                        held, held_bytes = [], 0
        cut()
        if (out := flush(held)) is not None:
            yield out

    return run


def repeated_places(strings: list[bytes], sid: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, window: int = WINDOW):
    """(doc, tag, first word, word after the last) of what is to be removed, from one bucket's
    super-k-mers: strings[sid] stands in document doc at word start."""
    number: dict[bytes, int] = {}
    sid = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)[sid]
    order = np.lexsort((start, doc, sid))
    sid, doc, tag, start = sid[order], doc[order], tag[order], start[order]
    lead = np.r_[0, np.flatnonzero(np.diff(sid)) + 1]  # the earliest place of each string
    lead_of = np.repeat(lead, np.diff(np.r_[lead, len(sid)]))
    later = (doc != doc[lead_of]) | (start != start[lead_of])
    by_sid = list(number)
    # Strings in the order of their earliest places: then so are all their windows.
    rank = np.lexsort((start[lead], doc[lead]))
    split = [by_sid[s].split(b" ") for s in sid[lead][rank].tolist()]
    sizes = np.array([len(w) for w in split])
    of_sid = np.empty(len(by_sid), np.int64)
    of_sid[sid[lead][rank]] = sizes
    out = [(doc[later], tag[later], start[later], start[later] + of_sid[sid[later]])]
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for words in split for w in words], np.int64)
    del split
    first = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[of] + shift
    hashes = _roll(_mix(ids.astype(np.uint64) * _MULTIPLY + _MULTIPLY), window)[at]
    by_hash = np.argsort(hashes)
    ordered = hashes[by_hash]
    cuts = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    many = np.diff(np.r_[cuts, len(ordered)])
    if (many > 1).any():
        earliest = np.minimum.reduceat(by_hash, cuts)
        group = np.repeat(np.arange(len(cuts)), many)
        some = np.flatnonzero(many[group] > 1)
        win, ref = by_hash[some], earliest[group[some]]
        span = np.arange(window)
        same = np.ones(len(win), bool)
        for a in range(0, len(win), 100_000):
            same[a : a + 100_000] = (ids[at[win[a : a + 100_000], None] + span] == ids[at[ref[a : a + 100_000], None] + span]).all(axis=1)
        for g in np.unique(group[some][~same]):  # different windows with one hash: compare them all
            seen: dict[bytes, int] = {}
            for i in np.sort(win[group[some] == g]).tolist():
                ref[win == i] = seen.setdefault(ids[at[i] : at[i] + window].tobytes(), i)
        place = lead[rank]
        win_doc, win_start = doc[place][of[win]], start[place][of[win]] + shift[win]
        gone = (doc[place][of[ref]] != win_doc) | (start[place][of[ref]] + shift[ref] != win_start)
        win = np.sort(win[gone])
        if len(win):
            # Consecutive windows of one string make one place, at its earliest place and what ties with it.
            cut = np.r_[0, np.flatnonzero((np.diff(win) != 1) | (np.diff(of[win]) != 0)) + 1]
            head, tail = win[cut], win[np.r_[cut[1:] - 1, len(win) - 1]]
            ties = np.diff(np.r_[np.flatnonzero(~later & (np.arange(len(sid)) == lead_of)), len(sid)])  # rows of a string
            for a, b in zip(head.tolist(), tail.tolist()):
                p = int(place[of[a]])
                n = int(ties[np.searchsorted(lead, p)])
                for q in range(p, p + n):
                    if later[q]:
                        break
                    out.append((doc[q : q + 1], tag[q : q + 1], start[q : q + 1] + shift[a], start[q : q + 1] + shift[b] + window))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def _in_bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        strings, cols, n = [], [], 0
        settled = table.column("bucket")[0].as_py() < 0
        for blob, size in zip(table.column("blob").to_pylist(), table.column("size").to_pylist()):
            s, sid, doc, tag, start = unpack(blob, size)
            cols.append((np.diff(sid, prepend=0) if settled else sid + n, doc, tag, start))
            strings += s
            n += len(s)
        sid, doc, tag, start = (np.concatenate([c[i] for c in cols]) for i in range(4))
        if settled:
            a, b = start, start + sid
        else:
            doc, tag, a, b = repeated_places(strings, sid, doc, tag, start, window=window)
        return pa.table({"doc": pa.array(doc, pa.int64()), "tag": pa.array(tag, pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, null last), tag (0, or a hash of the text where rows share a doc_id), and the rest."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    df = docs.withColumn("doc", doc)
    shared = df.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(1).alias("shared"))
    shared = materialise(shared, "shared_ids")
    if shared.isEmpty():
        return df.withColumn("tag", F.lit(0).cast("long"))
    shared = F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared
    return df.join(shared, "doc", "left").withColumn("tag", F.when(F.col("shared") == 1, F.xxhash64("text")).otherwise(F.lit(0))).drop("shared")


def _cleaned(batches):
    for batch in batches:
        doc_ids, texts, spans = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        words_n, gone_n, shas, kept_texts = [], [], [], []
        for text, span in zip(texts, spans):
            words = text.split() if text else []
            total = len(words)
            if span:
                keep = np.ones(total, bool)
                for s in span:
                    keep[s["a"] : s["b"]] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            kept = b" ".join(words)
            words_n.append(total)
            gone_n.append(total - len(words))
            shas.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        yield pa.RecordBatch.from_arrays([doc_ids, pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def common_minimisers(texts: DataFrame, total: int, window: int, bucket_bytes: int) -> np.ndarray:
    """Minimisers whose windows would make up half a bucket or more, by a sample of the texts (column text, binary)."""
    share = min(SAMPLE_SHARE, SAMPLE_BYTES / max(1, total))

    def count(batches):
        for batch in batches:
            texts = [t.split() for t in batch.column(0).to_pylist() if t]
            _, _, strings, least = super_kmers(texts, window)
            if strings:
                which, at = np.unique(least, return_inverse=True)
                size = np.bincount(at, weights=[len(s) for s in strings]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(size)], names=["least", "size"])

    drawn = texts.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    sizes = drawn.mapInArrow(count, "least long, size long").groupBy("least").agg(F.sum("size").alias("size"))
    rows = sizes.where(F.col("size") >= share * bucket_bytes / 2).orderBy(F.desc("size"), "least").limit(MOST_COMMON).select("least").collect()
    return np.sort(np.array([r.least for r in rows], np.int64).view(np.uint64))


def places(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc, tag, a, b: stretches of words that also start earlier (they may overlap). ``docs`` is keyed."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-3 * total // bucket_bytes))  # packed strings hold each word about three times
    texts = docs.select("doc", "tag", F.col("text").cast("binary").alias("text"))
    common = common_minimisers(texts, total, window, bucket_bytes)
    packed = texts.mapInArrow(_packed(buckets, window, common), "bucket long, blob binary, size long")
    parts = max(1, -(-3 * total // PARTITION_BYTES))
    return packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_in_bucket(window), "doc long, tag long, a int, b int")


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay)."""
    keyed = _keyed(docs.select("doc_id", "text"))
    found = places(keyed, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    found = materialise(found, "removed_places")  # the packed strings' shuffle can go before the texts' begins
    # Always by a join on the document: the places grow with the corpus, and a broadcast would only serve small ones.
    df = keyed.join(found.hint("merge"), ["doc", "tag"], "left")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans").mapInArrow(_cleaned, out)
    return df.withColumn("kept", F.col("kept").cast("string")) if with_text else df.drop("kept")
