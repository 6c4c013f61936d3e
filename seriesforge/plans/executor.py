"""Join plans: a primary dataset and supplementary ones, joined on keys and dates by their grain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.normalize import lookup_enrich
from ..operators.profile import family


@dataclass
class Dataset:
    """A dataset in a plan; ``filter`` is (column, value)."""

    name: str
    frame: DataFrame
    time_col: str | None = None
    grain: str | None = None
    filter: tuple[str, object] | None = None
    join_key: str | None = None


@dataclass
class Plan:
    primary: Dataset
    supplementary: list[Dataset] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    #: Lookups of the primary's columns, the levels they add, and the columns to segment by.
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    levels: list[str] = field(default_factory=list)
    segment_by: list[str] = field(default_factory=list)


def keep_value(df: DataFrame, col: str, value) -> DataFrame:
    """Rows with the value, and rows with a null, which no inequality removes."""
    return df.where((F.col(col) == F.lit(value)) | F.col(col).isNull())


def prefixed(df: DataFrame, prefix: str, leave: tuple[str, ...]) -> list[Column]:
    tag = prefix.replace("-", "_")
    return [F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in leave]


def join_same_grain(left: DataFrame, right: DataFrame, key: str, prefix: str, time_col: str) -> DataFrame:
    """Left join on key and date; several right rows of a date repeat the left row. ``left`` has __date."""
    side = right.select(F.col(key).alias("_k"), F.to_date(time_col).alias("_d"), *prefixed(right, prefix, (key, time_col)))
    return left.join(side, (F.col(key) == F.col("_k")) & (F.col("__date") == F.col("_d")), "left").drop("_k", "_d")


def join_key_only(left: DataFrame, right: DataFrame, key: str, prefix: str) -> DataFrame:
    side = right.select(F.col(key).alias("_k"), *prefixed(right, prefix, (key,)))
    return left.join(side, F.col(key) == F.col("_k"), "left").drop("_k")


def join_asof(left: DataFrame, right: DataFrame, key: str, prefix: str, time_col: str) -> DataFrame:
    """Left join with the latest right row of the key at or before the row's date (__date).

    Both sides go through one shuffle, unioned, and the last right row is carried forward; no row is
    added. Right rows of one date tie by the full time, then by their values. A null key or date has no match.
    Keys are cut into stretches of ``ASOF_DAYS`` and the last row of earlier stretches is carried in, so a key with
    a large part of all rows is not one task.
    """
    own = [c for c in right.columns if c not in (key, time_col)]
    struct = F.struct(*[F.col(c).alias(f"{prefix.replace('-', '_')}_{c}") for c in own])
    tie = F.struct(F.col(time_col), *[F.col(c) for c in own])
    stretch = F.floor(F.date_diff("_d", F.lit("1970-01-01").cast("date")) / ASOF_DAYS)
    hit = F.col(key).isNotNull() & F.col("__date").isNotNull()
    names = [f"{prefix.replace('-', '_')}_{c}" for c in own]
    alone = left.where(~hit).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(n) for n, c in zip(names, own)])
    a = left.where(hit).select(F.col(key).alias("_k"), F.col("__date").alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(_type(right, tie)).alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(_type(right, struct)).alias("_r"))
    known = right.where(F.col(key).isNotNull() & F.col(time_col).isNotNull())
    b = known.select(F.col(key).alias("_k"), F.to_date(time_col).alias("_d"), F.lit(0).alias("_side"), tie.alias("_tie"), F.lit(None).cast(_type(left, F.struct(*left.columns))).alias("_l"), struct.alias("_r"))
    a, b = a.withColumn("_c", stretch), b.withColumn("_c", stretch)
    ends = b.groupBy("_k", "_c").agg(F.max_by("_r", F.struct("_d", "_tie")).alias("_r"))
    ends = a.groupBy("_k", "_c").agg(F.lit(None).cast(_type(right, struct)).alias("_r")).unionByName(ends).groupBy("_k", "_c").agg(F.first("_r", ignorenulls=True).alias("_r"))
    before = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_c", F.last("_r", ignorenulls=True).over(before).alias("_before"))
    w = Window.partitionBy("_k", "_c").orderBy("_d", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    both = both.join(carried, ["_k", "_c"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    return both.select("_l.*", *[F.col("_last")[n].alias(n) for n in names]).unionByName(alone)


#: Days of a key that one task carries a row over.
ASOF_DAYS = 90


def _type(df: DataFrame, c: Column) -> str:
    return df.select(c.alias("x")).schema["x"].dataType.simpleString()


def execute(plan: Plan) -> DataFrame:
    """The primary's rows, filtered, with each supplementary dataset's columns; one without a join key is skipped."""
    p = plan.primary
    df = keep_value(p.frame, *p.filter) if p.filter else p.frame
    if p.time_col:
        df = df.withColumn("__date", F.to_date(p.time_col))
    for s in plan.supplementary:
        right = keep_value(s.frame, *s.filter) if s.filter else s.frame
        if not s.join_key:
            plan.skipped.append(s.name)
        elif p.time_col and s.time_col and p.grain and p.grain == s.grain:
            df = join_same_grain(df, right, s.join_key, s.name, s.time_col)
        elif p.time_col and s.time_col:
            df = join_asof(df, right, s.join_key, s.name, s.time_col)
        else:
            df = join_key_only(df, right, s.join_key, s.name)
    for col, lookup in plan.lookups.items():
        df = lookup_enrich(df, lookup, col, plan.levels)
    return df


def attach(plan: Plan, lookups: dict[str, DataFrame], levels: list[str], discriminators: list[str]) -> Plan:
    """The plan with the lookups of those columns that are discriminators of its primary; their levels are what to
    segment by."""
    plan.lookups = {c: lookup for c, lookup in lookups.items() if c in discriminators and c in plan.primary.frame.columns}
    plan.levels = list(levels)
    plan.segment_by = [f"norm_{c}_{level}" for c in plan.lookups for level in levels]
    return plan


def describe(plan: Plan) -> str:
    """The plan as text."""
    p = plan.primary
    lines = [f"primary {p.name}" + (f", time {p.time_col} ({p.grain or 'any grain'})" if p.time_col else "") + (f", only {p.filter[0]} = {p.filter[1]}" if p.filter else "")]
    for s in plan.supplementary:
        how = "skipped: no key" if not s.join_key else f"on {s.join_key}" + (", same grain" if p.time_col and s.time_col and p.grain and p.grain == s.grain else ", as of" if p.time_col and s.time_col else "")
        lines.append(f"with {s.name} {how}")
    lines += [f"normalised {c}" for c in plan.lookups]
    return "\n".join(lines + ([f"segment by {', '.join(plan.segment_by)}"] if plan.segment_by else []))


def build(datasets: list[Dataset], value: tuple[str, object] | None = None, sizes: dict[str, int] | None = None) -> Plan:
    """A plan over datasets: the largest with a time is primary (the first on a tie), the others join on the
    column they share with it that has the fewest values there (the first on a tie). Measures, which are
    numbers with a fraction, and times are no keys.

    ``value`` (column, value) filters every dataset that has the column.
    """
    for d in datasets:
        if value and value[0] in d.frame.columns:
            d.filter = value
    timed = [d for d in datasets if d.time_col] or datasets
    sizes = sizes or {d.name: d.frame.count() for d in datasets}
    primary = max(timed, key=lambda d: sizes[d.name])
    rest = [d for d in datasets if d is not primary]
    for d in rest:
        if d.join_key is None:
            shared = [f.name for f in d.frame.schema if f.name in primary.frame.columns and family(f.dataType) in ("int", "string") and f.name not in (d.time_col, primary.time_col)]
            n = d.frame.agg(*[F.count_distinct(c).alias(c) for c in shared]).first() if len(shared) > 1 else {}
            d.join_key = min(shared, key=lambda c: n[c] if n else 0) if shared else None
    return Plan(primary, rest)
