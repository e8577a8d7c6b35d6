"""The N best rows of every group (problem 1).

Per-group histograms of scores give a threshold that at least N rows of the group reach: scores are put into classes
that keep their order, counts per group and class are added up from the best class down, and the class in which N is
reached is the threshold. Rows below it are dropped before anything is ranked; the few that remain are ranked exactly,
ties by id.

At scale: histograms are pre-aggregated where the rows are. Thresholds are looked up by a broadcast of at most `HOT`
rows, those of the largest groups, so no row moves to meet its threshold; a group that isn't among them has at most one
in `HOT` of all rows, and the window's own group limit cuts it before the exchange. The rows travel once, for the removal
of repeated ids, and both the histogram and the ranking read that exchange.

Defined results: rows with a null id, a null group or a null or NaN score don't count; infinite scores do; of rows with
one id the latest counts, of equally late ones that with the greatest score (null as least), then the greatest group;
-0.0 equals 0.0; a group with fewer than N rows gives all; an empty table gives no rows. Columns of other names are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose threshold is broadcast.
HOT = 10_000
#: Classes per factor e of score.
STEPS = 64
_BASE = STEPS * 800


def score_class(score: Column) -> Column:
    """A whole number that never falls as the score rises: logarithmic classes on both sides of zero."""
    size = F.floor(F.ln(F.abs(score)) * STEPS).cast("long") + _BASE
    return F.when(score == 0, F.lit(0)).when(score == float("inf"), F.lit(2 * _BASE)).when(score == float("-inf"), F.lit(-2 * _BASE)).when(score > 0, size).otherwise(-size).cast("int")


def latest(df: DataFrame, id_col: str, group_col: str, score_col: str, time_col: str) -> DataFrame:
    """row_id, group_key, score: of each id the latest row, if it counts."""
    order = F.struct(
        F.col(time_col).alias("t"), (~F.isnan(score_col)).alias("ok"), F.col(score_col).cast("double").alias("s"), F.col(group_col).cast("string").alias("g")
    )
    best = df.select(F.col(id_col).cast("long").alias("row_id"), order.alias("_o")).filter("row_id IS NOT NULL").groupBy("row_id").agg(F.max("_o").alias("_o"))
    return best.select("row_id", F.col("_o.g").alias("group_key"), (F.col("_o.s") + F.lit(0.0)).alias("score")).filter("group_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")


def thresholds(rows: DataFrame, n: int) -> DataFrame:
    """_g, _least: for each of the largest groups with more than n rows, the class that n rows reach; at most HOT rows."""
    histogram = rows.groupBy(F.col("group_key").alias("_g"), score_class(F.col("score")).alias("_class")).agg(F.count("*").alias("_c"))
    down = Window.partitionBy("_g").orderBy(F.desc("_class"))
    reached = histogram.select("_g", "_class", F.sum("_c").over(down).alias("_upto"))
    # the best class in which n is reached, and the group's number of rows
    per_group = reached.groupBy("_g").agg(F.max(F.when(F.col("_upto") >= n, F.col("_class"))).alias("_least"), F.max("_upto").alias("_rows"))
    return per_group.filter(F.col("_rows") > n).orderBy(F.desc("_rows"), "_g").limit(HOT).select("_g", "_least")


def top_n(rows: DataFrame, n: int) -> DataFrame:
    """group_key, pos, row_id of (row_id, group_key, score): the n best rows of each group, best first."""
    limit = F.broadcast(thresholds(rows, n))
    above = rows.join(limit, F.col("group_key") == F.col("_g"), "left").filter(F.col("_least").isNull() | (score_class(F.col("score")) >= F.col("_least")))
    order = Window.partitionBy("group_key").orderBy(F.desc("score"), "row_id")
    return above.select("group_key", "score", "row_id").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n).select("group_key", "pos", "row_id")
