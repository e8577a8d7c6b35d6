"""Roll-ups by category, source, month and date; rankings within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_total(df: DataFrame, group: str, measures: dict) -> DataFrame:
    """Measures per group and over all, in one pass; the total's group is 'all', a null group is 'none'."""
    out = df.withColumn(group, F.coalesce(F.col(group), F.lit("none"))).rollup(group).agg(*(m.alias(k) for k, m in measures.items()))
    return out.withColumn(group, F.coalesce(F.col(group), F.lit("all")))


def zero_filled(counts: DataFrame, groups: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Counts for every group of a dimension, 0 where there are none."""
    return groups.join(counts, group, "left").fillna(0, columns)


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The n groups with most rows, by name at a tie."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n)


def ranked_within(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """pos within the group, up to n."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("pos") <= n)


def change_groups(df: DataFrame, order: str, value: str) -> DataFrame:
    """Whether a row begins a new value in the order of a small ordered table of dates."""
    w = Window.orderBy(order)
    return df.withColumn("starts", ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1))
