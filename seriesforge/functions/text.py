"""Text normalisation as column expressions, and string similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Abbreviations and pack sizes in product names.
ABBREVIATIONS = {
    "lt": "light", "lgt": "light", "lte": "light", "drk": "dark", "org": "organic", "nat": "natural", "orig": "original", "choc": "chocolate",
    "van": "vanilla", "strw": "strawberry", "blueb": "blueberry", "sm": "small", "md": "medium", "lg": "large", "xl": "extra large", "oz": "oz",
    "pk": "pack", "ct": "count", "btl": "bottle", "cn": "can", "cs": "case", "bx": "box", "bg": "bag",
}
PACK_PATTERNS = (r"(\d+)\s*(?:pk|pack|ct|count)\b", r"(\d+\.?\d*)\s*(?:oz|fl\.?\s*oz)\b", r"(\d+)\s*(?:ml|l|liter|litre)\b", r"(\d+)\s*(?:gal|gallon)\b")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _spaced(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[_\-/\\|]+", " ")


def pack_info(c: Column) -> Column:
    """The first pack size, by the first pattern that matches; null if none."""
    t = _spaced(c)
    out = F.lit(None).cast("string")
    for p in reversed(PACK_PATTERNS):
        out = F.when(t.rlike(p), F.regexp_extract(t, p, 0)).otherwise(out)
    return strip(out)


def tokens(c: Column) -> Column:
    """Lower-case words without the pack size and lone numbers, abbreviations written out."""
    t = _spaced(c)
    cut = t
    for p in reversed(PACK_PATTERNS):  # only the first match of the first matching pattern goes
        at = F.regexp_instr(t, F.lit(p))
        gone = F.length(F.regexp_extract(t, p, 0))
        cut = F.when(t.rlike(p), F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + gone, F.length(t)))).otherwise(cut)
    cut = F.regexp_replace(cut, r"\b\d+\b", "")
    words = F.transform(F.split(cut, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()]+|[.,;:!?()]+$", ""))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(table, w), w))


def normalize(c: Column) -> Column:
    """Normalised text; null becomes 'none' and empty stays empty."""
    return F.when(c.isNull(), "none").otherwise(strip(F.regexp_replace(F.array_join(tokens(c), " "), r"\s+", " ")))


def canonical_score(c: Column) -> Column:
    """How well a spelling serves as the name of its group."""
    first = F.substring(c, 1, 1)
    cased = F.upper(c) != F.lower(c)
    all_caps = cased & (c == F.upper(c))
    starts = (first == F.upper(first)) & (first != F.lower(first)) & ~all_caps
    pack = F.lower(c).rlike("|".join(PACK_PATTERNS))
    return F.when(starts, 10).otherwise(0) + F.least(F.length(c), F.lit(30)) - F.when(all_caps, 15).otherwise(0) - 3 * F.regexp_count(c, F.lit("_")) - F.when(pack, 10).otherwise(0)


def safe_name(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.lower(t), 1, 60)


def numeric_string(c: Column) -> Column:
    """The number a string such as $1,234.50 or 12% stands for, else null."""
    return F.translate(F.trim(c), "$£€¥,% ", "").try_cast("double")


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern found in the text, upper and lower case alike."""
    out = None
    for pattern, label in rules:
        test = c.rlike(f"(?i){pattern}")
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """0 to 100: Indel similarity of the texts with their words sorted."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def similarity(a: Column, b: Column) -> Column:
    """token_sort_ratio of two columns, in Arrow batches."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.array([token_sort_ratio(u, v) for u, v in zip(x, y)], float))

    return pandas_udf(ratios, "double")(a, b)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Likeness (0 to 100) by the longest common blocks of two texts in lower case, of the standard library."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p.lower(), q.lower()).ratio() * 100 for p, q in zip(x, y)], dtype=float)

    return pandas_udf(ratio, "double")(a, b)


def sequence_groups(names: list[str], threshold: float = 82.0) -> list[int]:
    """The group of each name: the first earlier name that leads a group and is alike enough, or its own."""
    from difflib import SequenceMatcher

    heads: list[str] = []
    out = []
    for name in names:
        at = next((i for i, h in enumerate(heads) if SequenceMatcher(None, h.lower(), name.lower()).ratio() * 100 >= threshold), None)
        if at is None:
            at = len(heads)
            heads.append(name)
        out.append(at)
    return out


def leaders(values: list[str], threshold: float) -> list[int]:
    """Greedy clusters: each value joins the first leader that is similar enough, else leads one itself."""
    heads: list[str] = []
    out = []
    for v in values:
        at = next((i for i, h in enumerate(heads) if token_sort_ratio(h, v) >= threshold), None)
        if at is None:
            at = len(heads)
            heads.append(v)
        out.append(at)
    return out
