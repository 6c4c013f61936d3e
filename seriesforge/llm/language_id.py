"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of presence: the character n-grams of 1 to 3
characters (letters without case; anything else is a separator) that occur in both, over the root
of the product of their numbers. N-grams are exact: every letter of every script keeps its code point.
A bounded sample of labelled texts, the same number for each language, gives the landmarks of
a Nyström map and the rows of a one-versus-rest kernel ridge regression. A text's kernel values
with all landmarks and the regression are linear in its presence vector but for its own
norm, so both collapse into one matrix (n-grams by languages), and a batch of texts is scored
by one product of its sparse presence matrix with it.

Defined results: a null text and one without a letter is ``und`` with score 0; where scores tie,
the first language in order wins; equal rows get equal results; with no labelled
row every text is ``und``; an empty table gives no rows; a very long text is read whole, in
pieces of ``PIECE`` characters. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
#: Bounds of the fitting sample: texts for each language and landmarks for each, texts and landmarks in
#: all, and the characters of a text that may be drawn.
SAMPLE = 500
LANDMARKS = 64
MOST_TEXTS = 20_000
MOST_LANDMARKS = 2_048
LONGEST = 100_000
RIDGE = 1e-3
SHARP = 6.0
#: A text's n-grams are gathered piece by piece, a batch's product is made for so many of them at once.
PIECE = 1 << 18
AT_ONCE = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def letters() -> np.ndarray:
    """For every code point: itself in lower case if it is a letter, else 0."""
    known = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            known[i] = ord(low) if len(low) == 1 else i
    return known


def grams(text: str, known: np.ndarray) -> np.ndarray:
    """The n-grams that are present, in order; a character takes 21 bits, and each length has codes of its own."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = None
    for a in range(0, len(points), PIECE):
        c = known[points[a : a + PIECE + 2]] + 1  # a separator is 1, so the length shows in the code
        two = (c[:-1] << 21) + c[1:]
        codes = np.concatenate([c, two, (two[:-1] << 21) + c[2:]])
        codes.sort()
        codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
        found = codes if found is None else np.union1d(found, codes)
    if found is None:
        return np.zeros(0, np.int64)
    return found[found != 1]


def _places(used: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``codes`` stand in ``used``, and which of them do."""
    at = np.minimum(np.searchsorted(used, codes), max(0, len(used) - 1))
    there = used[at] == codes if len(used) else np.zeros(len(codes), bool)
    return at[there], there


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """The model: lower case of code points, languages, n-grams and their matrix by languages."""
    names = sorted(set(langs))
    if not names:
        return {"langs": []}
    known = letters()
    sets = [grams(t, known) for t in texts]
    norms = np.array([np.sqrt(max(1, len(s))) for s in sets])
    each = max(1, min(landmarks, MOST_LANDMARKS // len(names)))
    marks: list[int] = []
    for name in names:
        marks += [i for i, x in enumerate(langs) if x == name][:each]
    # Postings: the landmarks that have each n-gram.
    codes = np.concatenate([sets[i] for i in marks])
    order = np.argsort(codes, kind="stable")
    post = np.repeat(np.arange(len(marks)), [len(sets[i]) for i in marks])[order]
    used, first = np.unique(codes[order], return_index=True)
    ends = np.append(first[1:], len(post))
    mark_norms = norms[marks]

    def kernel(s: np.ndarray, norm: float) -> np.ndarray:
        at, _ = _places(used, s)
        many = ends[at] - first[at]
        spots = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(post[spots], minlength=len(marks)) / (mark_norms * norm)

    k = np.stack([kernel(s, n) for s, n in zip(sets, norms)])
    values, vectors = np.linalg.eigh(k[marks])
    values = np.where(values > 1e-8 * values.max(), values, np.inf)
    root = vectors / np.sqrt(values)  # the Nyström map of x is k(x) @ root
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.array([[1.0 if x == name else -1.0 for name in names] for x in langs])
    size = Counter(langs)
    w = np.array([len(langs) / (len(names) * size[x]) for x in langs])[:, None]
    weights = np.linalg.solve(z.T @ (w * z) + ridge * len(k) * np.eye(z.shape[1]), z.T @ (w * y))
    by_mark = (root @ weights[:-1]) / mark_norms[:, None]
    matrix = np.add.reduceat(by_mark[post], first, axis=0) if len(used) else np.zeros((0, len(names)))
    return {"langs": names, "letters": known, "grams": used, "matrix": matrix.astype(np.float32), "bias": weights[-1].astype(np.float32)}


def product(sets: list[np.ndarray], model: dict) -> np.ndarray:
    """Kernel ridge values of a batch: its sparse presence matrix, scaled by row, times the model's."""
    out = np.zeros((len(sets), len(model["langs"])))
    a = 0
    while a < len(sets):
        b, n = a + 1, len(sets[a])
        while b < len(sets) and n + len(sets[b]) <= AT_ONCE:
            n += len(sets[b])
            b += 1
        at, there = _places(model["grams"], np.concatenate(sets[a:b]))
        rows = np.repeat(np.arange(b - a), [len(s) for s in sets[a:b]])[there]
        if len(at):
            cuts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
            out[a + rows[cuts]] = np.add.reduceat(model["matrix"][at], cuts, axis=0)
        a = b
    norms = np.sqrt(np.maximum(1, [len(s) for s in sets]))
    return out / norms[:, None] + model["bias"]


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1) of each text."""
    names = model["langs"]
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    if not names:
        return langs, scores
    held, rows, n = [], [], 0

    def settle():
        if not rows:
            return
        sums = SHARP * product(held, model)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, x in zip(rows, best.tolist(), share.tolist()):
            langs[i], scores[i] = names[b], min(1.0, x)
        held.clear()
        rows.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        s = grams(t, model["letters"])
        if any(map(str.isalpha, t)):
            held.append(s)
            rows.append(i)
            n += len(s)
            if n > AT_ONCE:
                settle()
                n = 0
    settle()
    return langs, scores


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on about ``sample`` labelled texts of each language, fewer if there are many languages, chosen by a
    hash of the doc_id among those of up to ``LONGEST`` characters."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).withColumn("langs", F.count("*").over(Window.partitionBy()))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part = labelled.join(F.broadcast(counts), "lang").where(chance < F.least(F.lit(float(sample)), F.lit(float(MOST_TEXTS)) / F.col("langs")) / F.col("n"))
    rows = sorted(part.select(F.xxhash64("doc_id", "text").alias("o"), "lang", "text").collect(), key=lambda r: (r.o, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: dict | None = None, keep: tuple[str, ...] = ("doc_id", "text"), text: str = "text") -> DataFrame:
    """``docs`` (the columns in ``keep``) with lang_pred and score. The text alone decides; it is a column, or a field of
    a struct (``row.text``), so that a kept row does not carry it twice."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model if model is not None else train(docs))
    column, *path = text.split(".")
    df = docs.select(*dict.fromkeys([*keep, column]))
    kept = [c for c in df.columns if c in keep]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]

    def score(batches):
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(column))
            for field in path:
                found = found.field(field)
            langs, scores = predict(found.to_pylist(), shared.value)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return df.mapInArrow(score, ", ".join([*fields, "lang_pred string", "score double"]))
