"""Scans: snapshots and feeds with their dimensions, redelivered rows removed, partitions chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by `order`; a pre-aggregated maximum, so no group is ever sorted or collected.

    Rows with a null key are dropped. Ties beyond `order` are settled by the whole row.
    """
    rest = F.struct(*(F.col(c) for c in df.columns if c != key))
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), rest.alias("row"))).alias("_b"))
    return best.select(key, "_b.row.*").select(df.columns)


def with_ranks(items: DataFrame, id_col: str, ranks: DataFrame, ranks_id: str, rank: str) -> DataFrame:
    """Items with best_rank, worst_rank and points of their rank history; null and 0 without one.

    The history is aggregated before the join, so the join never multiplies rows.
    """
    per_item = ranks.groupBy(F.col(ranks_id).alias("_rid")).agg(F.min(rank).alias("best_rank"), F.max(rank).alias("worst_rank"), F.count(rank).alias("points"))
    out = items.join(per_item, F.col(id_col) == F.col("_rid"), "left").drop("_rid")
    return out.withColumn("points", F.coalesce("points", F.lit(0)))


def with_source(items: DataFrame, source_col: str, sources: DataFrame, default_name: str) -> DataFrame:
    """Items with source_name of (id, name) sources, a default where the source is unknown."""
    dim = sources.select(F.col("id").alias("_sid"), F.col("name").alias("source_name"))
    return items.join(dim, F.col(source_col) == F.col("_sid"), "left").drop("_sid").withColumn("source_name", F.coalesce("source_name", F.lit(default_name)))


def partitions(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct dates of several tables' date columns, newest first."""
    out = None
    for df, col in tables:
        days = df.select(F.col(col).cast("date").alias("date")).filter("date IS NOT NULL").distinct()
        out = days if out is None else out.unionByName(days)
    return out.distinct().orderBy(F.desc("date"))


def recent_partitions(tables: Sequence[tuple[DataFrame, str]], n: int) -> DataFrame:
    """The last n dates that exist, not the last n days."""
    return partitions(tables).limit(n)
