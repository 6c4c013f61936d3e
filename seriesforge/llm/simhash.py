"""Near-duplicates by SimHash fingerprints and pigeonring filtering.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's word shingles. Two link at 4
or fewer differing bits. The 64 bits form a ring of 5 segments; if two fingerprints differ in at
most 4 bits, some chain of consecutive segments keeps within its proportional budget at every
length: no difference in its first segment, at most 1 in the first two, 2 in three, 3 in four.
The first two segments, with one bit of the second left out, are the key under which
candidates meet (64 keys a fingerprint); longer chains prune them before the whole comparison.

``similar`` links texts of a Jaccard similarity of 0.8 or more over 5-word shingles, which differ in some 15 %
of their bits: no chain that is sure to keep its budget then has enough bits to meet under. Its fingerprints
have 512 bits in a ring of 64 segments, and candidates meet under chains of three segments without a
difference, taken round the ring in four orders (256 keys). So it is a filter of measured recall. All 512 bits
decide, in the search, so a refused pair takes no node out of it. 16 chains go first with whole fingerprints; under the
others the first 64 bits tell which nodes have company that is not connected yet, and only those are sent whole.

Copies share a fingerprint and are one node. Within a key a search from one node at a time takes
what it links out of the rest, so a key with k nodes emits at most k - 1 links, whatever their
number of pairs, and a dense group costs about one comparison a node. Components are found by
rounds of large-star and small-star joins over those links. Only fingerprints, ids and links are
ever shuffled.

Defined results: a null or empty text, and one of separators only, has fingerprint zero, linked
as any other; a text of fewer words than a shingle is one shingle; rows that share a doc_id and
equal rows each return a row; a null doc_id is never the smallest, and a component of such
rows only has none; a very long text is hashed whole; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, broadcast_if_small, materialise

SHINGLE = 4
DISTANCE = 4
#: Up to so many rows to drop are broadcast, else joined by a shuffle.
MAX_BROADCAST = 500_000
SEED = 42
#: Segments of the ring as (lowest bit, number of bits).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Of ``similar``: words of a shingle, least similarity, 64-bit words of a fingerprint, segments of its ring, those of a
#: chain, and the steps in which chains go round.
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_WORDS = 8
WIDE_RING = 64
CHAIN = 3
STEPS = (1, 5, 11, 23)
CHAINS = tuple((step, start) for step in STEPS for start in range(WIDE_RING))
#: Chains that go first; no two of them share a segment.
FIRST = range(0, 48, CHAIN)
#: Standard deviations above the mean difference of texts that are just similar enough, for the pruning and the decision.
PRUNE, DECIDE = 1.7, 1.5
#: Bytes of keys for each partition of their shuffle.
PARTITION_BYTES = 64_000_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), (starts[shingle:] - 1).tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bytes of a fingerprint, by bit the majority over the rows of ``hashes`` (n, words)."""
    n = len(hashes)
    parts = np.ascontiguousarray(hashes).view(np.uint8)
    if n < 200:
        ones = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BITS for i in range(parts.shape[1])])
    return np.packbits(2 * ones > n, bitorder="little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; bit i is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle, seed)
    return int.from_bytes(majority(hashes[:, None]).tobytes(), "little") if len(hashes) else 0


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> np.ndarray:
    """A fingerprint of several 64-bit words; each shingle counts once."""
    hashes = np.unique(shingle_hashes(text, shingle))
    if not len(hashes):
        return np.zeros(words, np.uint64)
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(x ^ (x >> np.uint64(31))).view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed number) of every row."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return df.mapInArrow(run, "doc_id long, text_hash long, fp long")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 64): chain start, segment without a difference, next segment but for one bit, that bit."""
    keys = []
    for i, (low, n) in enumerate(RING):
        at, m = RING[(i + 1) % len(RING)]
        first = (fps >> np.uint64(low)) & np.uint64((1 << n) - 1)
        second = (fps >> np.uint64(at)) & np.uint64((1 << m) - 1)
        for bit in range(m):
            rest = second & ~np.uint64(1 << bit)
            keys.append((((np.uint64(i * 16 + bit) << np.uint64(13)) | first) << np.uint64(13)) | rest)
    return np.stack(keys, axis=1).view(np.int64)


def chain_ok(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep within the budgets at every chain length from ``start`` on, up to the whole ring."""
    x, total, ok = a ^ b, 0, None
    for length in range(1, len(RING) + 1):
        low, n = RING[(start + length - 1) % len(RING)]
        total = total + np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << n) - 1))
        within = total <= length * DISTANCE // len(RING)
        ok = within if ok is None else ok & within
        if length < len(RING) and not ok.any():
            break
    return ok


def spanning_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between distinct fingerprints of one key that connect what all its links connect."""
    links, rest = [], np.unique(fps)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            node = todo.pop()
            near = chain_ok(node, rest, start)
            links += [(int(node), int(x)) for x in rest[near]]
            todo += list(rest[near])
            rest = rest[~near]
    return links


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) that connect all that are linked."""

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(fps, max(1, len(fps) // 4096)):
                keys = ring_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["key", "fp"])

    def search(batches):
        held_key, held = None, []  # the key that the last batch broke off in

        def ended(key, fps):
            return spanning_links(np.concatenate(fps).view(np.uint64), (key >> 26) // 16) if sum(map(len, fps)) > 1 else []

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            found = []
            if held and keys[0] != held_key:
                found += ended(held_key, held)
                held = []
            held, held_key = [*held, fps[: ends[0]]], int(keys[0])
            if len(starts) > 1:
                found += ended(held_key, held)
                for n in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                    found += ended(int(keys[starts[n]]), [fps[starts[n] : ends[n]]])
                held, held_key = [fps[starts[-1] :]], int(keys[-1])
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if held:
            pairs = np.array(ended(held_key, held), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    parts = _partitions(distinct, 64 * 16)
    # Nodes are few bytes and many keys: dealt out first, so that few files do not make few tasks.
    spread_out = distinct.select("fp").repartition(parts, "fp").mapInArrow(spread, "key long, fp long")
    return spread_out.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long").distinct()


def _partitions(nodes: DataFrame, bytes_each: int) -> int:
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-nodes.count() * bytes_each // PARTITION_BYTES))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node reaches (nodes without a link have no row).

    Rounds of large-star and small-star, each written to the shared folder, until no link changes.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "links")
    mark = None
    while True:
        both = edges.select(F.col("b").alias("n"), F.col("a").alias("m")).unionByName(edges.select(F.col("a").alias("n"), F.col("b").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        edges = both.where("m > n").join(least, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = edges.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("low"))
        small = edges.select(F.col("b").alias("n"), F.col("a").alias("m")).join(least, "n")
        edges = small.select(F.col("low").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("low").alias("a"), F.col("n").alias("b")))
        edges = materialise(edges.where("a <> b").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id, text_hash."""
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    return _classes(rows, nodes, links(nodes.select("fp"))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def _classes(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the component_id of their node (fp, low, n)."""
    found = components(edges)
    classes = nodes.select("fp", "low", "n").join(found, nodes.fp == found.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = materialise(classes.join(least, "root").select("fp", "n", "component_id"), "classes")
    return attach(rows, classes, "fp", "n")


def budget(bits: int, similarity: float, deviations: float) -> int:
    """Differing bits of two sets of this Jaccard similarity and like size, ``deviations`` above their mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def chain_keys(words: np.ndarray, chains=range(len(CHAINS))) -> np.ndarray:
    """(n, chains): the number of a chain, and its segments."""
    segments = np.ascontiguousarray(words).view(np.uint8).astype(np.uint32)
    keys = []
    for n in chains:
        step, start = CHAINS[n]
        key = np.full(len(segments), n, np.uint32)
        for i in range(CHAIN):
            key = (key << np.uint32(8)) | segments[:, (start + i * step) % WIDE_RING]
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int32)


def _numpy(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of whole fingerprints as (n, words)."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE_WORDS)
    return column.to_numpy(zero_copy_only=False)


def _keyed(nodes: DataFrame, chains, carried: str, bytes_each: int) -> DataFrame:
    """key and the columns ``carried`` of nodes (with the whole fingerprint in words), sorted by key."""
    names = [c.split()[0] for c in carried.split(", ")]

    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                keys = chain_keys(_numpy(part.column("words")), chains)
                at = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(part.column(c).take(at) for c in names)], names=["key", *names])

    parts = _partitions(nodes, len(chains) * bytes_each)
    # Dealt out first, as in ``links``.
    keyed = nodes.repartition(parts).mapInArrow(spread, f"key int, {carried}")
    return keyed.repartition(parts, "key").sortWithinPartitions("key")


def _whole_keys(batches):
    """The columns behind the key, and where keys start and end, of one batch after the other; no key is broken off."""
    held = None  # the key that the last batch broke off in
    for batch in batches:
        columns = [_numpy(c) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(both) for both in zip(held, columns)]
        if not len(columns[0]):
            continue
        cuts = np.r_[0, np.flatnonzero(np.diff(columns[0])) + 1]
        held = [c[cuts[-1] :] for c in columns]
        yield columns[1:], cuts
    if held is not None:
        yield held[1:], np.array([0, len(held[0])])


def whole_links(nodes: DataFrame, chains, similarity: float) -> DataFrame:
    """a, b: links between the ids of nodes (id, and the whole fingerprint in words) that connect what all links under a
    key of these chains connect; nodes that share an id are connected as they are.

    All bits decide in the search, and what it links it takes out of its key's rest with all of its id: a key gives fewer
    links than it has ids.
    """
    most = budget(64 * WIDE_WORDS, similarity, DECIDE)

    def spanning(ids, words):
        found, rest = [], np.argsort(ids)
        while len(rest) > 1 and ids[rest[0]] != ids[rest[-1]]:
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                node, others = todo.pop(), ids[rest]
                close = np.bitwise_count(words[rest] ^ words[node]).sum(axis=1) <= most
                linked = np.unique(others[close & (others != ids[node])])
                found += [(ids[node], x) for x in linked]
                taken = np.isin(others, np.append(linked, ids[node]))
                todo += list(rest[taken])
                rest = rest[~taken]
        return found

    def search(batches):
        for (ids, words), cuts in _whole_keys(batches):
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]  # most keys with company have two nodes: compare them all at once
            two = two[(np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= most) & (ids[two] != ids[two + 1])]
            found = list(zip(ids[two], ids[two + 1]))
            for at in np.flatnonzero(sizes > 2):
                found += spanning(ids[cuts[at] : cuts[at + 1]], words[cuts[at] : cuts[at + 1]])
            pairs = np.unique(np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keyed = _keyed(nodes.select("id", "words"), chains, "id long, words array<long>", 96)
    return keyed.mapInArrow(search, "a long, b long").distinct()


def company(nodes: DataFrame, chains, similarity: float) -> DataFrame:
    """fp: the nodes (fp, root and words) that under a key have, by the first 64 bits, company of another root: all of
    each group of its nodes, connected by those bits, that has several roots."""
    near = budget(64, similarity, PRUNE)

    def mixed(fps, roots):
        found, rest = [], np.arange(len(fps))
        while len(rest) > 1 and (roots[rest] != roots[rest[0]]).any():
            todo, group, rest = [rest[0]], [rest[:1]], rest[1:]
            while todo and len(rest):
                close = np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= near
                group.append(rest[close])
                todo += list(rest[close])
                rest = rest[~close]
            group = np.concatenate(group)
            if (roots[group] != roots[group[0]]).any():
                found.append(fps[group])
        return found

    def search(batches):
        for (fps, roots), cuts in _whole_keys(batches):
            fps, sizes = fps.view(np.uint64), np.diff(cuts)  # bits are counted of magnitudes
            two = cuts[:-1][sizes == 2]
            two = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= near) & (roots[two] != roots[two + 1])]
            found = [fps[two], fps[two + 1]]
            for at in np.flatnonzero(sizes > 2):
                found += mixed(fps[cuts[at] : cuts[at + 1]], roots[cuts[at] : cuts[at + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["fp"])

    keyed = _keyed(nodes, chains, "fp long, root long", 24)
    return keyed.mapInArrow(search, "fp long").distinct()


def wide_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links between nodes (fp, and the whole fingerprint in words) that connect what is linked under a key.

    A dense group meets under most chains. So a few chains come first, and what they connect has one root: under the
    others only nodes with company of another root are compared, and links are between roots.
    """
    first = components(whole_links(nodes.select(F.col("fp").alias("id"), "words"), FIRST, similarity))
    first = materialise(first, "first")
    rooted = nodes.select("fp", "words").join(first, nodes.fp == first.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "words")
    rooted = materialise(rooted, "rooted")
    rest = [n for n in range(len(CHAINS)) if n not in FIRST]
    met = materialise(company(rooted, rest, similarity), "company")
    met = materialise(rooted.join(met, "fp").select(F.col("root").alias("id"), "words"), "met")
    return first.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(whole_links(met, rest, similarity))


def similar(docs: DataFrame, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, component_id, text_hash; texts link at this Jaccard similarity of their shingles."""

    def run(batches):
        for batch in batches:
            wide = np.array([wide_fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(wide) + 1, dtype=np.int32) * WIDE_WORDS), pa.array(wide.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide[:, 0]), words], names=["doc_id", "text_hash", "fp", "words"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = materialise(df.mapInArrow(run, "doc_id long, text_hash long, fp long, words array<long>"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.min("words").alias("words"))
    nodes = materialise(nodes, "nodes")
    return _classes(rows, nodes, wide_links(nodes, similarity)).select("doc_id", "component_id", "text_hash")


def keep_one(docs: DataFrame, find=near_duplicates) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    ``find`` names the components (``near_duplicates`` or ``similar``). Of components whose rows all have a null doc_id, one
    row of each different text stays.
    """
    found = find(docs)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), "text_hash"]
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select(*key).distinct()
    gone = broadcast_if_small(materialise(gone, "gone"), MAX_BROADCAST)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key[:2], F.xxhash64("text").alias("text_hash"))
    kept = keyed.join(gone, ["k_id", "k_null", "text_hash"], "left_anti")
    counts = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if counts[0] != counts[1]:
        kept = kept.dropDuplicates(["k_id", "k_null", "text_hash"])
    return kept.select("row.*")
