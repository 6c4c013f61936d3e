"""Column profiles: statistics, roles, time grain, functional dependencies and the graph they make."""

from __future__ import annotations

from functools import reduce
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import fixed
from ..session import kept, spread

#: Limits of the role rules.
DISCRIMINATOR_MAX = 500
DISCRIMINATOR_RATIO = 0.05
IDENTIFIER_RATIO = 0.5
LEAST_CV = 0.01


def family(kind: T.DataType) -> str:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "string"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "int" if isinstance(kind, T.IntegralType) else "other"


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: Distinct values of a column, by a sketch, up to which a task may hold those of its rows.
FEW_VALUES = 20_000


def distinct_counts(df: DataFrame, rough: dict[str, int]) -> DataFrame:
    """column, n_distinct of columns, given about how many distinct values each has.

    Columns of few values are counted in place. The values of the others are dealt out by hash before they are
    counted, so a task holds a share of them and not all that its file has.
    """
    few, many = ([c for c, n in rough.items() if (n <= FEW_VALUES) == small] for small in (True, False))
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if kinds[c] == "timestamp":
            return F.unix_micros(c).cast("string")  # the clock may show two times alike
        return ((F.col(c) + F.lit(0).cast(kinds[c])) if kinds[c] in ("float", "double") else F.col(c)).cast("string")  # -0.0 is 0.0

    parts = []
    if few:
        counts = df.agg(*[F.count_distinct(c).alias(f"_{i}") for i, c in enumerate(few)])
        parts.append(counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_distinct")) for i, c in enumerate(few)])).alias("s")).select("s.*"))
    if many:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in many])).alias("s")).select("s.*").where("v is not null")
        parts.append(spread(pairs, "column", "v").distinct().groupBy("column").agg(F.count("*").alias("n_distinct")))
    return union_all(parts)


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, kind, n, n_null, n_distinct of every column.

    ``exact=False`` counts distinct values by sketches, in one pass.
    """
    fields = [f for f in df.schema if family(f.dataType) != "other"]
    aggs = [F.struct(F.lit(f.name).alias("column"), F.lit(family(f.dataType)).alias("kind"), F.count("*").alias("n"), F.count_if(F.col(f.name).isNull()).alias("n_null"), F.approx_count_distinct(F.col(f.name)).alias("n_distinct")) for f in fields]
    once = df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("s")).select("s.*")
    if not exact:
        return once
    rows = once.collect()  # a row for each column
    known = df.sparkSession.createDataFrame([tuple(r)[:4] for r in rows], "column string, kind string, n long, n_null long")
    return known.join(F.broadcast(distinct_counts(df, {r["column"]: r["n_distinct"] for r in rows})), "column")


#: Distinct values around a median that the driver may hold for each column.
MEDIAN_VALUES = 20_000


def exact_medians(df: DataFrame, cols: list[str], most: int = MEDIAN_VALUES) -> dict[str, float | None]:
    """The median of every column, without gathering a column in one task.

    Sketched quantiles bracket the middle ranks and exact counts below and inside of the bracket say
    whether it holds them; it is narrowed until few distinct values are left, which are counted.
    """
    if not cols:
        return {}
    x = {c: F.col(c).cast("double") for c in cols}
    slack = 3 / 10_000  # ranks a sketch of this accuracy may be off by, and some more

    def marks(v: Column, at: float, more: float = 0.0) -> Column:
        return F.percentile_approx(v, F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + more + slack))), 10_000)

    first = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.min(x[c]).alias("lo"), F.max(x[c]).alias("hi"), marks(x[c], 0.5).alias("q")).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    # column -> count, bracket, values below it, values inside, and a bracket to try
    state = {c: (r["n"], r["lo"], r["hi"], 0, r["n"], r["q"]) for c, r in zip(cols, first) if r["n"]}
    ready = {}
    for _ in range(20):
        names = list(state)
        if not names:
            break
        inner = {c: F.when((x[c] >= state[c][5][0]) & (x[c] <= state[c][5][1]), x[c]) for c in names}
        row = df.agg(*[F.struct(F.count_if(x[c] < state[c][5][0]).alias("b"), F.count(inner[c]).alias("w"), F.approx_count_distinct(inner[c]).alias("d")).alias(f"_{i}") for i, c in enumerate(names)]).first()
        for c, r in zip(names, row):
            n, lo, hi, below, within, q = state[c]
            held = r["b"] <= (n - 1) // 2 and n // 2 < r["b"] + r["w"]
            state[c] = (n, q[0], q[1], r["b"], r["w"], q) if held else (n, lo, hi, below, within, (lo, hi))
            if held and (r["d"] <= most or q[0] == q[1]):
                ready[c] = state.pop(c)
        names = list(state)
        if names:
            inside = {c: F.when((x[c] >= state[c][1]) & (x[c] <= state[c][2]), x[c]) for c in names}
            row = df.agg(*[marks(inside[c], ((state[c][0] - 1) / 2 - state[c][3]) / state[c][4], 1 / state[c][4]).alias(f"_{i}") for i, c in enumerate(names)]).first()
            state |= {c: (*state[c][:5], q) for c, q in zip(names, row)}
    ready |= state
    out: dict[str, float | None] = dict.fromkeys(cols)
    if not ready:
        return out
    names = list(ready)
    pairs = [F.struct(F.lit(i).alias("i"), F.when((x[c] >= ready[c][1]) & (x[c] <= ready[c][2]), x[c]).alias("v")) for i, c in enumerate(names)]
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("v is not null").groupBy("i", "v").agg(F.count("*").alias("m"))
    upto = [ready[c][3] for c in names]
    got: list[list[float]] = [[] for _ in names]
    for r in values.orderBy("i", "v").toLocalIterator():
        n = ready[names[r.i]][0]
        got[r.i] += [r.v] * sum(upto[r.i] <= w < upto[r.i] + r.m for w in ((n - 1) // 2, n // 2))
        upto[r.i] += r.m
    return out | {c: sum(g) / 2 for c, g in zip(names, got)}


def value_stats(df: DataFrame) -> DataFrame:
    """column, mean, std, min, max, median and cv of every numeric column; a statistic of 0 is null."""
    cols = [f.name for f in df.schema if family(f.dataType) in ("int", "float")]
    medians = exact_medians(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.lit(medians[c]).cast("double").alias("median")))
    out = df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("s")).select("s.*")
    out = out.withColumn("cv", F.col("std") / F.nullif(F.abs("mean"), F.lit(0.0)))
    return out.select("column", *[F.nullif(fixed(c, 4), F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max", "median")], fixed("cv", 4).alias("cv"))


def samples(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The first n distinct values of a column, as text; each task passes on the first of its own."""

    def least(batches):
        best: list[str] = []
        for batch in batches:
            found = batch.column(0)
            if len(best) == n:
                found = found.filter(pc.less(found, best[-1]))
            if len(found):
                best = sorted({*best, *found.unique().to_pylist()})[:n]
        yield pa.RecordBatch.from_pydict({"value": pa.array(best, pa.string())})

    first = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("value")).mapInArrow(least, "value string")
    return first.distinct().orderBy("value").limit(n).select(F.lit(col).alias("column"), "value")


def roles(df: DataFrame) -> DataFrame:
    """column, kind, n_distinct, n_null, role: TIME, DISCRIMINATOR, VALUE, IDENTIFIER or UNKNOWN, tried in that order.

    A string is a time if its first five distinct values all read as timestamps, an integer if one of
    them is a date written as yyyymmdd.
    """
    stats = column_stats(df)
    tested = [samples(df, f.name, 5) for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    ratio = F.col("n_distinct") / F.greatest(F.col("n"), F.lit(1))
    if tested:
        as_date = F.try_to_timestamp(F.col("value")).isNotNull()
        as_number = F.coalesce(F.expr("try_cast(value AS bigint)").between(19000101, 20991231), F.lit(False))
        seen = union_all(tested).groupBy("column").agg(F.avg(as_date.cast("int")).alias("dates"), F.max(as_number).alias("numbers"))
        stats = stats.join(F.broadcast(seen), "column", "left")  # one row for each column of the table
    else:
        stats = stats.withColumns({"dates": F.lit(None).cast("double"), "numbers": F.lit(False)})
    spread = value_stats(df).select("column", "cv") if any(family(f.dataType) in ("int", "float") for f in df.schema) else df.sparkSession.createDataFrame([], "column string, cv double")
    stats = stats.join(F.broadcast(spread), "column", "left")
    is_time = (F.col("kind") == "time") | ((F.col("kind") == "string") & (F.coalesce("dates", F.lit(0.0)) > 0.8)) | ((F.col("kind") == "int") & F.coalesce("numbers", F.lit(False)))
    card = F.col("n_distinct")
    few = (card >= 2) & (card <= DISCRIMINATOR_MAX)
    coded = (F.col("kind") == "int") & (card < 10) & (ratio < 0.01)
    is_disc = few & (((F.col("kind") == "string") & (card <= 50)) | (card <= 5) | ((ratio <= DISCRIMINATOR_RATIO) & ((F.col("kind") == "string") | coded)))
    is_value = (F.col("kind") == "float") | ((F.col("kind") == "int") & (ratio <= IDENTIFIER_RATIO) & (F.coalesce("cv", F.lit(0.0)) > LEAST_CV))
    role = F.when(is_time, "TIME").when(is_disc, "DISCRIMINATOR").when(is_value, "VALUE").when(ratio > IDENTIFIER_RATIO, "IDENTIFIER").otherwise("UNKNOWN")
    return stats.select("column", "kind", "n_distinct", "n_null", role.alias("role"))


def time_grain(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """first, last and grain by the median positive gap; a gap of exactly a day is already the next class."""
    from .series import seconds

    w = Window.partitionBy(*keys).orderBy("_s")
    gaps = df.select(*keys, seconds(F.col(ts)).alias("_s")).where("_s is not null").distinct().withColumn("_d", F.col("_s") - F.lag("_s").over(w))
    out = gaps.groupBy(*keys).agg(F.min("_s").alias("first_s"), F.max("_s").alias("last_s"), F.median("_d").alias("median_gap"))
    g = F.col("median_gap")
    return out.withColumn("grain", F.when(g.isNull(), "unknown").when(g < 3600, "hourly").when(g < 86400, "daily").when(g < 604_800, "weekly").when(g < 2_592_000, "monthly").otherwise("quarterly_or_longer"))


def dependencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """child, parent of every pair of columns where each child value has one parent value and there are
    fewer parents than children."""
    text = lambda c: F.col(c).cast("string")
    both = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), text(a).alias("a"), text(b).alias("b")) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    # One pass over the table for all pairs; equal value pairs are combined before the shuffle.
    pairs = df.select(F.explode(F.array(*both)).alias("p")).select("p.*").where("a is not null and b is not null").distinct()
    side = lambda c: pairs.groupBy("left", "right", c).agg(F.count("*").alias("m")).groupBy("left", "right").agg(F.count("*").alias(f"d{c}"), F.sum("m").alias("n"))
    counts = side("a").join(side("b").drop("n"), ["left", "right"])
    down, up = (F.col("n") == F.col("da")) & (F.col("da") > F.col("db")), (F.col("n") == F.col("db")) & (F.col("db") > F.col("da"))
    return counts.where(down | up).select(F.when(down, F.col("left")).otherwise(F.col("right")).alias("child"), F.when(down, F.col("right")).otherwise(F.col("left")).alias("parent"))


def value_edges(df: DataFrame, child: str, parent: str) -> DataFrame:
    """The value pairs of a dependency as graph edges."""
    return df.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.concat_ws("=", F.lit(child), F.col(child).cast("string")).alias("child"), F.concat_ws("=", F.lit(parent), F.col(parent).cast("string")).alias("parent")).distinct()


def climb(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, ancestor, depth: all that each start node (column node) reaches upwards, itself at depth 0, over as
    many edges as it takes; what was reached before is not followed again, so circles end."""
    edges, start = edges.select("child", "parent"), start.select("node").distinct()
    found = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    front = found
    for d in count(1):
        front = front.join(edges, front.ancestor == edges.child).select("node", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        front = front.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        front = kept(front)
        if front.isEmpty():
            break
        found = kept(found.unionByName(front)) if d % 4 == 0 else found.unionByName(front)
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def chains(dependencies_: list[tuple[str, str]]) -> list[list[str]]:
    """Longest child-to-parent chains of a few column pairs, direct parents only."""
    parents: dict[str, set[str]] = {}
    for c, p in dependencies_:
        parents.setdefault(c, set()).add(p)
    direct = {c: {p for p in ps if not any(p in parents.get(q, ()) for q in ps if q != p)} for c, ps in parents.items()}
    roots = [c for c in direct if not any(c in ps for ps in direct.values())]
    out: list[list[str]] = []

    def walk(path):
        ends = sorted(direct.get(path[-1], ()))
        if not ends:
            out.append(path)
        for p in ends:
            walk([*path, p])

    for r in sorted(roots):
        walk([r])
    return out


def join_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of the two value lists (column, value) that share values: column_a, column_b, shared."""
    left, right = a.select(F.col("column").alias("column_a"), "value").distinct(), b.select(F.col("column").alias("column_b"), "value").distinct()
    return left.join(right, "value").groupBy("column_a", "column_b").agg(F.count("*").alias("shared"))


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, value: the distinct values of columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """column, value, n, rank: the k most frequent values of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def segment_candidates(df: DataFrame, ts: str, least: int = 2, most: int = 1000, most_int: int = 50) -> DataFrame:
    """Columns fit to segment by: few enough values, no time or identifier by name, no measure."""
    #: Words in names of identifiers and times.
    ids = "id|uuid|key|code|sku|barcode|hash"
    times = "date|time|timestamp|created|updated|year|month|week|day|hour"
    stats = column_stats(df).where(F.col("column") != ts)
    ratio, name, card = F.col("n_distinct") / F.greatest(F.col("n"), F.lit(1)), F.lower("column"), F.col("n_distinct")
    number = F.col("kind").isin("int", "float")
    fit = F.when(number, (F.col("kind") == "int") & card.between(least, most_int)).otherwise(~name.rlike(times) & ~((ratio > 0.5) & name.rlike(ids)) & (ratio <= 0.9) & card.between(least, most))
    return stats.where(fit).select("column", "n_distinct")


def numeric_columns(df: DataFrame) -> DataFrame:
    """Numeric columns with at most half nulls and some spread."""
    return column_stats(df).where((F.col("n_null") <= 0.5 * F.col("n")) & F.col("kind").isin("int", "float")).join(value_stats(df).where("std is not null"), "column").select("column")


def timestamp_share(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """column, share of the first n distinct values that read as timestamps; over 0.8 is a candidate."""
    return union_all([samples(df, c, n) for c in cols]).groupBy("column").agg(F.avg(F.try_to_timestamp(F.col("value")).isNotNull().cast("int")).alias("share")).withColumn("candidate", F.col("share") > 0.8)
