"""What the training-data operators share: words, the shared folder, joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: white space (a Java regular expression), and all of ASCII but letters and digits.
WHITE = "[ \\x09-\\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: Column) -> Column:
    """Array of the words of a text, A-Z in lower case: runs of anything but ASCII that is no letter or digit.

    One pass over the characters makes all separators blanks, and blanks alone need no regular expression.
    """
    line = F.translate(F.coalesce(text, F.lit("")), _UPPER + _APART, _UPPER.lower() + " " * len(_APART))
    return F.array_remove(F.split(line, " "), "")


def split_words(text: Column, separators: str) -> Column:
    """Array of words with one empty element at its end, and one at its start if the text
    starts with a separator. ``lead`` and ``n_words`` below account for them.

    ``split`` stays one pass of one regular expression; cleaning the array up would copy it.
    """
    return F.split(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), separators)


def lead(words: Column) -> Column:
    return F.when(F.element_at(words, 1) == "", 1).otherwise(0)


def n_words(words: Column) -> Column:
    return F.size(words) - 1 - lead(words)


def count_words(text: Column, separators: str) -> Column:
    words = split_words(text, separators)
    return n_words(words).cast("long")


_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the folder that all executors share (``spark.checkpoint.dir``).

    Only where the session names none, on a local master as in tests, a temporary folder serves.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="shared-")
        root = _LOCAL_ROOTS[sc.applicationId]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def covered(starts: Column, length: int | None = None) -> Column:
    """The places, each once, that stretches of ``length`` cover; ``starts`` is an array of where they start, or of
    (start, len) for stretches of their own length. One pass over hash sets, so it stays linear on long texts."""
    if length is not None:
        every = F.transform(starts, lambda s: F.sequence(s, s + (length - 1)))
    else:
        every = F.transform(starts, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
    return F.array_distinct(F.flatten(every))


def without(elements: Column, n: Column, gone: Column) -> Column:
    """The elements of an array of ``n`` that do not stand at the places ``gone``, in order."""
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_except(places, gone), lambda i: F.get(elements, i))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; else leave the join to a shuffle."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df.hint("shuffle_merge")


def join_in_parts(rows: DataFrame, table: DataFrame, key: str, max_rows: int, finish=lambda df: df, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` (never null) by broadcasts of about ``max_rows`` rows each, so no key of
    ``rows`` is ever gathered in one task. With several parts each one's join is written before the next, so one part
    at a time is held; both inputs are read once a part. ``finish`` is applied to each part's join."""
    parts = max(1, -(-table.count() // max_rows))
    if parts == 1:
        return finish(rows.join(F.broadcast(table), key, how))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    return reduce(DataFrame.unionByName, [materialise(finish(rows.where(part == k).join(F.broadcast(table.where(part == k)), key, how)), "part") for k in range(parts)])


#: Tables of up to so many rows are joined as they are.
FEW_ROWS = 100_000
#: At most so many keys hold this share of all rows or more.
HEAVY_KEYS = 1024


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each ``key`` and its count in ``size``.

    Keys that hold more than 1/1024 of all rows (so fewer than 1024 of them) are broadcast;
    the rest is joined by a shuffle in which no key is large. Both inputs are read twice, so
    materialise them. Rows whose key is null are left out.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    if total <= FEW_ROWS:
        return rows.join(groups, key)
    at = max(1, total // HEAVY_KEYS)
    heavy = F.broadcast(groups.where(F.col(size) > at))
    light = rows.join(F.broadcast(groups.where(F.col(size) > at).select(key)), key, "left_anti")
    rest = light.join(groups.where(F.col(size) <= at), key)
    return rows.join(heavy, key).select(*rest.columns).unionByName(rest)
