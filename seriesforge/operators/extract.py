"""Category extraction by rule tables: names are normalised, exclusions drop out, ordered patterns label the rest.

Rules are data: a rule set names its exclusions, its outputs with ordered (pattern, label) pairs and
an ELSE, and the patterns of which one must be found for a row to belong. They come from a mapping,
a JSON document or a table, so a deployment keeps its own word lists beside its data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_match


@dataclass
class RuleSet:
    name: str
    include: list[str]
    outputs: dict[str, list[tuple[str, str]]]
    otherwise: dict[str, str | None] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    #: Patterns that only count where none of ``unless`` is found.
    include_unless: list[str] = field(default_factory=list)
    unless: list[str] = field(default_factory=list)


def from_json(text: str) -> RuleSet:
    raw = json.loads(text)
    raw["outputs"] = {k: [tuple(p) for p in v] for k, v in raw["outputs"].items()}
    return RuleSet(**raw)


def from_table(rules: DataFrame, name: str) -> RuleSet:
    """From rows (kind, output, position, pattern, label); kind is include, exclude, unless, include_unless, rule or else."""
    out = RuleSet(name, [], {})
    for r in sorted(rules.collect(), key=lambda r: r["position"]):  # a rule table is small
        if r["kind"] == "rule":
            out.outputs.setdefault(r["output"], []).append((r["pattern"], r["label"]))
        elif r["kind"] == "else":
            out.otherwise[r["output"]] = r["label"]
        else:
            getattr(out, r["kind"]).append(r["pattern"])
    return out


def cleaned_name(c: Column) -> Column:
    """Lower case without a price ($4.50), a mixed fraction (0 1/2) and a number sign (# 12) before the name."""
    t = F.lower(F.trim(c))
    for prefix in (r"^\$[\d.]+\s*", r"^\d+\s+\d+/\d+\s*", r"^#\s*\d+\s*"):  # fixed values, in this order
        t = F.regexp_replace(t, prefix, "")
    return F.trim(t)


def found(c: Column, patterns: list[str]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | c.rlike(f"(?i){p}")
    return test


def extract(df: DataFrame, col: str, rules: RuleSet) -> DataFrame:
    """Rows that belong to the category, with its outputs; a null name belongs to none."""
    name = F.col("clean_name")
    df = df.withColumn("clean_name", cleaned_name(F.col(col))).where(F.col(col).isNotNull() & ~found(name, rules.exclude))
    belongs = found(name, rules.include)
    if rules.include_unless:
        belongs = belongs | (found(name, rules.include_unless) & ~found(name, rules.unless))
    df = df.where(belongs)
    return df.withColumns({out: first_match(name, pairs, rules.otherwise.get(out)) for out, pairs in rules.outputs.items()})


def matched_text(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, f"(?i){pattern}", 0)


def classify(df: DataFrame, col: str, categories: list[tuple[str, str]], exclude: list[str]) -> DataFrame:
    """category (the first whose pattern is found, else null) and matched text; excluded names have none."""
    name = cleaned_name(F.col(col))
    label = F.when(found(name, exclude), F.lit(None).cast("string")).otherwise(first_match(name, categories, None))
    text = F.lit(None).cast("string")
    for c, p in [(v, k) for k, v in reversed(categories)]:
        text = F.when(F.col("category") == c, matched_text(name, p)).otherwise(text)
    return df.withColumn("category", label).withColumn("matched", text)


def load_rules(spark: SparkSession, path: str, name: str) -> RuleSet:
    """Rules from a JSON document or from a table of rows in CSV or Parquet."""
    from ..sources.readers import scan

    if path.endswith(".json"):
        return from_json("\n".join(r.value for r in spark.read.text(path).collect()))
    return from_table(scan(spark, path), name)
