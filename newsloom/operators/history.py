"""Bounded histories of observations per key: repeats suppressed, the last points kept, stale values marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 80


def points(obs: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Observations whose (time, value) differs from the one before in the key; null values are no points."""
    w = Window.partitionBy(key).orderBy(time, value)
    rows = obs.filter(F.col(value).isNotNull()).select(key, F.col(time).alias("time"), F.col(value).alias("value"))
    here = F.struct(F.col("time"), F.col("value"))
    w = Window.partitionBy(key).orderBy("time", "value")
    return rows.withColumn("_prev", F.lag(here).over(w)).filter(F.col("_prev").isNull() | ~here.eqNullSafe(F.col("_prev"))).drop("_prev")


def last_points(obs: DataFrame, key: str, time: str, value: str, n: int = POINTS) -> DataFrame:
    """key, time, value, pos: the last n points of each key, oldest first."""
    p = points(obs, key, time, value)
    cut = p.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("time"), F.desc("value")))).filter(F.col("_k") <= n)
    return cut.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("time", "value"))).drop("_k")


def with_change(p: DataFrame, key: str) -> DataFrame:
    """Points with the change and the percentage against the one before; none after a zero or nothing."""
    prev = F.lag("value").over(Window.partitionBy(key).orderBy("time", "value"))
    return p.withColumn("change", F.col("value") - prev).withColumn("percent", (F.col("value") - prev) / F.nullif(prev, F.lit(0.0)) * 100)


def or_stale(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key, value, stale: the present value, or the previous one marked stale where there is none."""
    return now.select(key, F.col("value").alias("_now")).join(before.select(key, F.col("value").alias("_old")), key, "full_outer").select(
        key, F.coalesce("_now", "_old").alias("value"), (F.col("_now").isNull()).alias("stale")
    ).filter("value IS NOT NULL")


def sparkline(p: DataFrame, key: str, width: float = 152.0) -> DataFrame:
    """x and y of each point: x in equal steps, y from 0 to 1 between the key's least and greatest value."""
    w = Window.partitionBy(key)
    n, low, high = F.count("*").over(w), F.min("value").over(w), F.max("value").over(w)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    x = F.when(n < 2, F.lit(0.0)).otherwise((F.col("pos") - 1) * width / (n - 1))
    return p.select(key, "pos", x.alias("x"), ((F.col("value") - low) / span).alias("y"))
