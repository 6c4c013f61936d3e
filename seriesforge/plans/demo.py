"""A small lake made by rule, for trying out and for tests: sales by day, shop and item, weather by region, spending by
brand and week, and the directories of items and shops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = (("TEA-6", "Leaf", "tea", 6), ("TEA-12", "Leaf", "tea", 12), ("CHAI-6", "Spice", "tea", 6), ("COLA-24", "Fizz", "soda", 24))
SHOPS = (("Harbour", "North", 1200), ("Mill", "North", 800), ("Station", "South", 1500))


def _noise(low: float, high: float, *seed: str | Column) -> Column:
    """A number between two that only depends on the columns."""
    return F.round(F.lit(low) + (high - low) * F.pmod(F.xxhash64(*seed), F.lit(10_000)) / 10_000, 2)


def frames(spark: SparkSession, start: str = "2024-01-01", days: int = 91) -> dict[str, DataFrame]:
    items = spark.createDataFrame(ITEMS, "item string, brand string, kind string, pack int")
    shops = spark.createDataFrame(SHOPS, "shop string, region string, area int")
    day = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    sales = day.crossJoin(F.broadcast(items.drop("pack"))).crossJoin(F.broadcast(shops.drop("area")))  # days by a few rows
    sales = sales.withColumn("units", (10 + F.when(F.dayofweek("day").isin(1, 7), 6).otherwise(0) + F.pmod(F.xxhash64("day", "item", "shop"), F.lit(5))).cast("int"))
    weather = day.crossJoin(F.broadcast(shops.select("region").distinct()))
    weeks = day.where(F.weekday("day") == 0).select(F.col("day").alias("week")).crossJoin(F.broadcast(items.select("brand").distinct()))
    return {
        "sales": sales.withColumn("revenue", F.round(F.col("units") * _noise(1.5, 4.0, "item"), 2)),
        "weather": weather.withColumn("temperature", _noise(-5, 30, "day", "region")),
        "spending": weeks.withColumn("spend", _noise(100, 900, "week", "brand")),
        "items": items,
        "shops": shops,
    }


def write(spark: SparkSession, path: str, start: str = "2024-01-01", days: int = 91) -> dict[str, str]:
    """The lake as CSV, one folder for each dataset; their paths."""
    out = {}
    for name, df in frames(spark, start, days).items():
        out[name] = f"{path}/{name}"
        df.coalesce(1).write.mode("overwrite").csv(out[name], header=True)
    return out
