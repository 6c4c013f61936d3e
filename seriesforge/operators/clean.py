"""Cleaning: what is wrong with columns, and the operations that put it right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import kept
from .profile import column_stats, family, union_all


def null_rates(df: DataFrame, over: float = 0.5) -> DataFrame:
    return column_stats(df, exact=False).select("column", (F.col("n_null") / F.greatest(F.col("n"), F.lit(1))).alias("null_rate")).withColumn("is_high", F.col("null_rate") > over)


def case_variants(df: DataFrame, col: str, limit: int = 20) -> DataFrame:
    """Spellings that differ only in case or outer blanks: key, canonical (the most frequent), n_variants."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    keyed = counts.groupBy(F.lower(F.trim("value")).alias("key")).agg(F.count("*").alias("n_variants"), F.sum("n").alias("n"), F.max_by("value", F.struct(F.col("n"), F.col("value"))).alias("canonical"))
    return keyed.where("n_variants > 1").orderBy(F.desc("n"), "key").limit(limit)


def numeric_strings(df: DataFrame, cols: list[str], sample: int = 50, share: float = 0.7) -> DataFrame:
    """String columns whose first distinct values are mostly numbers with signs of currency or percent."""
    parts = []
    for c in cols:
        seen = df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).alias("value")).distinct().orderBy("value").limit(sample)
        parts.append(seen.groupBy("column").agg(F.avg(F.trim("value").rlike(r"^[$£€¥]?\s*-?[\d,]+\.?\d*\s*%?$").cast("int")).alias("share")))
    return union_all(parts).withColumn("is_numeric", F.col("share") >= share)


def timezone_marks(df: DataFrame, col: str) -> DataFrame:
    """Share of the first ten distinct values that name a zone or are midnights."""
    seen = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct().orderBy("v").limit(10)
    return seen.agg(F.avg(F.col("v").rlike(r"(Z|UTC|[+-]\d\d:?\d\d)$").cast("int")).alias("with_zone"), F.avg(F.col("v").contains("00:00:00").cast("int")).alias("at_midnight"))


def mapped(c: Column, mapping: dict[str, str]) -> Column:
    """Values replaced by a mapping of a few spellings."""
    if not mapping:
        return c
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def chained(mapping: dict[str, str]) -> dict[str, str]:
    """The mapping that applying its entries one after the other amounts to: a to b, then b to c, takes a to c."""
    out: dict[str, str] = {}
    for a, b in mapping.items():
        for k in [k for k, v in out.items() if v == a]:
            out[k] = b
        out.setdefault(a, b)
    return out


def normalize_text(df: DataFrame, col: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Trim, then map: a key with outer blanks never matches."""
    return df.withColumn(col, mapped(F.trim(col), mapping or {}))


def entity_resolution(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    return df.withColumn(col, mapped(F.col(col), chained(mapping)))


def timezone_convert(df: DataFrame, col: str, to: str, source: str = "UTC") -> DataFrame:
    return df.withColumn(col, F.convert_timezone(F.lit(source), F.lit(to), F.col(col).cast("timestamp_ntz")))


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """The column as a number, last in order; what is no number is null."""
    return df.withColumn("_num", tx.numeric_string(F.col(col))).drop(col).withColumnRenamed("_num", col)


def drop_column(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col)


def _fill_in_order(df: DataFrame, col: str, order: str) -> DataFrame:
    """The last value before, over the whole table: within ranges of the order, each of which starts from what the
    ranges before it end with, so no task holds the whole table."""
    parts = kept(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    ends = parts.where(F.col(col).isNotNull()).groupBy("_part").agg(F.max_by(col, order).alias("_end"))
    ends = parts.select("_part").distinct().join(ends, "_part", "left")  # a row for each range
    before = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.withColumn(col, F.last(col, ignorenulls=True).over(w)).join(F.broadcast(before), "_part")
    return filled.withColumn(col, F.coalesce(col, "_before")).select(*df.columns)


def fill_nulls(df: DataFrame, col: str, how: str, value=None, order: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """how: drop_rows, fill_value, fill_mean or fill_forward (which needs an order)."""
    if how == "drop_rows":
        return df.where(F.col(col).isNotNull())
    if how == "fill_value":
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    if how == "fill_mean":
        mean = df.agg(F.avg(col).alias("_mean"))
        return df.join(F.broadcast(mean)).withColumn(col, F.coalesce(F.col(col), F.col("_mean"))).drop("_mean")  # one row
    if how == "fill_forward":
        if not keys:
            return _fill_in_order(df, col, order)
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(col, F.last(col, ignorenulls=True).over(w))
    raise ValueError(f"unknown way to fill: {how}")


OPERATIONS = {
    "normalize_text": normalize_text,
    "entity_resolution": entity_resolution,
    "timezone_convert": timezone_convert,
    "coerce_numeric": coerce_numeric,
    "drop_column": drop_column,
    "fill_nulls": fill_nulls,
}


def clean(df: DataFrame, operations: list[dict]) -> tuple[DataFrame, list[dict], list[dict]]:
    """Apply operations ({operation, column, ...}) in order; one that fails is reported and left out."""
    applied, errors = [], []
    for op in operations:
        try:
            args = {k: v for k, v in op.items() if k not in ("operation", "column")}
            out = OPERATIONS[op["operation"]](df, op["column"], **args)
            if op["operation"] != "drop_column":
                _ = out.select(op["column"]).schema  # names and types are resolved here
            df = out
            applied.append(op)
        except Exception as e:  # the report carries it
            errors.append({**op, "error": str(e).splitlines()[0]})
    return df, applied, errors


#: Distinct values of a column that spellings are compared of, least likeness, clusters that are mapped.
FUZZY_VALUES, FUZZY_LEAST, FUZZY_CLUSTERS = (2, 200), 82.0, 10


def fuzzy_duplicates(df: DataFrame, col: str) -> dict[str, str]:
    """Spellings to their canonical one, for the first clusters of a column of few values."""
    from .normalize import sequence_clusters

    names = df.where(F.col(col).isNotNull()).select(F.col(col).alias("raw")).distinct()
    low, high = FUZZY_VALUES
    if not low <= names.limit(high + 1).count() <= high:
        return {}
    rows = sequence_clusters(names, FUZZY_LEAST).orderBy("cluster", "raw").collect()  # at most 200 rows
    several = [c for c in dict.fromkeys(r.cluster for r in rows) if sum(r.cluster == c for r in rows) > 1][:FUZZY_CLUSTERS]
    return {r.raw: r.canonical for r in rows if r.cluster in several and r.raw != r.canonical}


def detect(df: DataFrame) -> list[dict]:
    """Issues of all columns: high null rates, spellings, numbers as text, each with an operation to apply."""
    issues = [{"column": r["column"], "issue": "high_null_rate", "operation": "drop_column", "rate": r["null_rate"]} for r in null_rates(df).where("is_high").collect()]
    strings = [f.name for f in df.schema if family(f.dataType) == "string" and f.dataType.simpleString() == "string"]
    if strings:
        issues += [{"column": r["column"], "issue": "numeric_as_string", "operation": "coerce_numeric"} for r in numeric_strings(df, strings).where("is_numeric").collect()]
    for c in strings:
        near = fuzzy_duplicates(df, c)
        if near:
            issues.append({"column": c, "issue": "fuzzy_duplicates", "operation": "entity_resolution", "mapping": near})
        found = case_variants(df, c).collect()  # at most 20 rows
        if found:
            issues.append({"column": c, "issue": "case_variants", "operation": "normalize_text", "groups": [r["canonical"] for r in found]})
    return issues


def narrative(issues: list[dict]) -> str:
    level = "clean" if not issues else "minor" if len(issues) <= 2 else "moderate" if len(issues) <= 5 else "severe"
    return f"{level}: {len(issues)} issues" + (": " + "; ".join(f"{i['column']} {i['issue']}" for i in issues) if issues else "")


def conjunction(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def matches_all(values: dict) -> Column:
    """Equality on several columns; a null value matches null."""
    return conjunction([F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
