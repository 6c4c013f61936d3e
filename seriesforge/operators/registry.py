"""The signal registry: embeddings, similarity search, clusters and statistics."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import fixed
from ..session import kept, spread
from . import narratives

#: Codes of grains and directions in the shape embedding.
GRAINS = {"sub_hourly": 0.0, "hourly": 0.2, "daily": 0.4, "weekly": 0.6, "monthly": 0.8, "quarterly": 0.9, "yearly": 1.0}
DIRECTIONS = {"decreasing": -1.0, "flat": 0.0, "increasing": 1.0}
SEVERITIES = ("low", "medium", "high", "critical")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one of them is all zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(df: DataFrame, vector: str, query: list[float], k: int, id_col: str) -> DataFrame:
    """The k rows most like a vector; the order is settled by partial top-k in every task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("similarity", cosine(F.col(vector), q)).where("similarity is not null").orderBy(F.desc("similarity"), id_col).limit(k)


def similar(df: DataFrame, vector: str, id_col: str, own, k: int = 10) -> DataFrame:
    """The k other rows most like a given one."""
    row = df.where(F.col(id_col) == F.lit(own)).select(vector).first()
    if row is None:
        raise KeyError(own)
    return nearest(df.where(F.col(id_col) != F.lit(own)), vector, list(row[0]), k, id_col)


def explain(df: DataFrame, id_col: str, a, b, vectors: list[str]) -> DataFrame:
    """Cosine of two rows by each vector, and the mean of those there are."""
    left = df.where(F.col(id_col) == F.lit(a)).select(*[F.col(v).alias(f"{v}_a") for v in vectors])
    right = df.where(F.col(id_col) == F.lit(b)).select(*[F.col(v).alias(f"{v}_b") for v in vectors])
    both = left.join(right).select(*[cosine(F.col(f"{v}_a"), F.col(f"{v}_b")).alias(v) for v in vectors])  # one row each
    parts = F.filter(F.array(*vectors), lambda x: x.isNotNull())
    return both.withColumn("ensemble", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(parts), F.lit(0)))


def min_max(a: Column) -> Column:
    """Array scaled to 0..1; a constant one becomes zeros."""
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda x: F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0))


def distribution(a: Column) -> Column:
    """Array over its sum; zeros where that is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(a, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(c.cast("double"), F.lit(0.0))))


def _code(c: Column, codes: dict[str, float], other: float) -> Column:
    out = None
    for k, v in codes.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def shape_embedding() -> Column:
    """54 numbers from weekly, hourly and monthly (arrays of 7, 24 and 12) and the scalar metrics."""
    part = lambda c, n: min_max(F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), n)))
    scalars = F.array(
        clip(F.col("trend_slope"), -10, 10) / 10, clip(F.col("seasonality_strength"), 0, 1), clip(F.col("residual_std"), 0, 100) / 100, clip(F.col("deviation_density"), 0, 1), clip(F.col("deviation_count_90d"), 0, 500) / 500,
        clip(F.col("critical_pct"), 0, 1), F.log1p(F.coalesce(F.nullif(F.col("row_count"), F.lit(0)), F.lit(1)).cast("double")) / 15, _code(F.col("temporal_grain"), GRAINS, 0.4), _code(F.col("trend_direction"), DIRECTIONS, 0.0),
        clip(F.col("variance_explained"), 0, 1), clip(F.col("residual_kurtosis"), -5, 20) / 20,
    )
    return F.transform(F.concat(part("weekly", 7), part("hourly", 24), part("monthly", 12), scalars), lambda x: fixed(x, 6))


def deviation_embedding(devs: DataFrame, key: str, totals: DataFrame | None = None) -> DataFrame:
    """47 numbers for each key from its deviations (start, severity, kind, z_score).

    ``totals`` may give total_observations by key; without it density counts against one.
    """
    from pyspark.sql import Window

    day = F.datediff(F.to_date("start"), F.lit("1970-01-01"))
    rows = devs.withColumn("_day", day).withColumn("_z", F.abs(F.col("z_score").cast("double")))
    w = Window.partitionBy(key)
    rows = rows.withColumns({"_gap": (F.col("_day") - F.lag("_day").over(w.orderBy("_day"))).cast("double"), "_lo": F.min("_day").over(w), "_hi": F.max("_day").over(w)})
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(7), F.floor((F.col("_day") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 8)))
    count = lambda test: F.count_if(test)
    agg = rows.withColumn("_bucket", bucket).groupBy(key).agg(
        F.count("*").alias("_n"),
        F.array(*[count(F.col("severity") == s) for s in SEVERITIES]).alias("_sev"),
        F.array(*[count(F.weekday("start") == d) for d in range(7)]).alias("_dow"),
        F.array(*[count(F.month("start") == m) for m in range(1, 13)]).alias("_month"),
        F.array(count(~F.col("kind").isin("regime_change", "trend_shift")), F.lit(0).cast("long"), count(F.col("kind").isin("regime_change", "trend_shift"))).alias("_kind"),
        F.array(*[count(F.col("_bucket") == b) for b in range(8)]).alias("_hist"),
        F.avg("_z").alias("_zm"), F.stddev_pop("_z").alias("_zs"), F.max("_z").alias("_zx"), F.skewness("_z").alias("_zk"),
        F.avg("_gap").alias("_gm"), F.stddev_pop("_gap").alias("_gs"), F.min("_gap").alias("_gl"), F.max("_gap").alias("_gx"),
    )
    if totals is not None:
        agg = agg.join(totals.select(key, "total_observations"), key, "left")
    total = F.coalesce(F.col("total_observations"), F.lit(1)) if totals is not None else F.lit(1)
    z = F.array(clip(F.col("_zm"), 0, 10) / 10, clip(F.col("_zs"), 0, 5) / 5, clip(F.col("_zx"), 0, 20) / 20, clip(F.nanvl(F.col("_zk"), F.lit(0.0)), -3, 3) / 3)
    top = F.greatest(F.col("_gx"), F.lit(1.0))
    gaps = F.when(F.col("_gx").isNotNull(), F.array(F.col("_gm") / top, F.col("_gs") / top, F.col("_gl") / top, F.lit(1.0))).otherwise(F.array_repeat(F.lit(0.0), 4))
    density = F.array(clip(F.col("_n") / F.greatest(total, F.lit(1)), 0, 1), clip(F.col("_sev")[3] / F.greatest("_n", F.lit(1)), 0, 1))
    whole = F.concat(distribution(F.col("_sev")), distribution(F.col("_dow")), distribution(F.col("_month")), z, distribution(F.col("_kind")), gaps, F.array_repeat(F.lit(0.0), 3), density, distribution(F.col("_hist")))
    return agg.select(key, F.transform(whole, lambda x: fixed(x, 6)).alias("embedding"))


def text_embedding(c: Column, size: int = 384) -> Column:
    """Signed hashed word counts, normalised: a stand-in for a text model, which callers can plug in instead."""

    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), size))
        at: dict[str, tuple[int, float]] = {}
        for v, t in zip(out, texts):
            for word in (t or "").lower().split():
                if word not in at:
                    h = zlib.crc32(word.encode())
                    at[word] = (h % size, 1.0 if h >> 31 else -1.0)
                i, sign = at[word]
                v[i] += sign
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return pd.Series(list(out / np.where(norm == 0, 1.0, norm)))

    return pandas_udf(embed, "array<double>")(c)


def nearest_texts(df: DataFrame, text: Column, query: str, k: int, id_col: str, embed=text_embedding) -> DataFrame:
    """The k rows whose text is most like the query; every different text is embedded once."""
    row = df.sparkSession.range(1).select(embed(F.lit(query)).alias("e")).first()
    rows = df.withColumn("_text", F.coalesce(text, F.lit("")))
    texts = kept(spread(rows.select("_text"), "_text").distinct())  # written, or the embedding would move before it
    texts = spread(texts, "_text").withColumn("_e", embed(F.col("_text")))
    likes = kept(texts.select("_text", cosine(F.col("_e"), F.array(*[F.lit(float(x)) for x in row[0]])).alias("similarity")).where("similarity is not null"))
    last = likes.orderBy(F.desc("similarity")).limit(k).agg(F.min("similarity")).first()[0]  # k rows are as like as this
    found = rows.join(likes.where(F.col("similarity") >= F.lit(last)), "_text")
    return found.orderBy(F.desc("similarity"), id_col).limit(k).drop("_text")


def clusters(df: DataFrame, vector: str, id_col: str, k: int, seed: int = 42, restarts: int = 10) -> DataFrame:
    """cluster, representative (the member nearest to the centre) and two principal components of each row.

    The best of several k-means runs is kept.
    """
    rows = df.select(id_col, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")).persist()
    best = min((KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(rows) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())], "cluster int, centre array<double>")
    pca = PCA(k=2, inputCol="features", outputCol="xy").fit(rows)
    out = pca.transform(best.transform(rows)).withColumns({"xy": vector_to_array("xy"), "features": vector_to_array("features")}).join(F.broadcast(centres), "cluster")
    rows.unpersist()
    far = F.aggregate(F.zip_with("features", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("_far", far)
    heads = out.groupBy("cluster").agg(F.min_by(id_col, F.struct("_far", id_col)).alias("representative"), F.count("*").alias("size"), F.avg(F.col("xy")[0]).alias("_x"), F.avg(F.col("xy")[1]).alias("_y"))
    mean = out.agg(F.avg(F.col("xy")[0]).alias("_mx"), F.avg(F.col("xy")[1]).alias("_my"))
    out = out.join(F.broadcast(heads), "cluster").join(F.broadcast(mean))  # k rows and one row
    return out.select(id_col, "cluster", "representative", "size", fixed(F.col("xy")[0] - F.col("_mx"), 4).alias("x"), fixed(F.col("xy")[1] - F.col("_my"), 4).alias("y"))


def store_statistics(df: DataFrame) -> DataFrame:
    """One row over a registry (status, dataset_name, deviation_count, registered_at)."""
    on = F.col("status") == "active"
    return df.agg(
        F.count_if(on).alias("total_active"), F.count_if(F.col("status") == "superseded").alias("total_superseded"), F.count_distinct(F.when(on, F.col("dataset_name"))).alias("datasets"),
        F.avg(F.when(on, F.col("deviation_count"))).alias("avg_deviations"), F.min(F.when(on, F.col("registered_at"))).alias("earliest_signal"), F.max(F.when(on, F.col("registered_at"))).alias("latest_signal"),
    )


def deviation_summary(df: DataFrame, top: int = 10) -> DataFrame:
    """kind, key, n: counts by severity, by type and of the most affected segments, in one pass over grouping sets."""
    from pyspark.sql import Window

    sets = df.groupingSets([["severity"], ["deviation_type"], ["segment"]], "severity", "deviation_type", "segment").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "severity").when(F.col("_g") == 5, "deviation_type").otherwise("segment")
    out = sets.select(kind.alias("kind"), F.coalesce("severity", "deviation_type", "segment").alias("key"), "n")
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    return out.withColumn("_r", rank).where((F.col("kind") != "segment") | (F.col("_r") <= top)).drop("_r")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with the text in any of the columns, upper and lower case alike."""
    test = None
    for c in columns:
        hit = F.col(c).ilike(f"%{text}%")
        test = hit if test is None else test | hit
    return df.where(test)


def describe(df: DataFrame) -> DataFrame:
    """``df`` with a description of each signal."""
    return df.withColumn("description", narratives.signal(df.columns))
