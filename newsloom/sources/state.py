"""Small JSON inputs: watch lists and earlier states, read leniently, with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WATCHLIST = "id string, name string, symbol string, type string, market string, unit string, url string"
STATE = "generated_at string, source string, items array<struct<id string, name string, time string, price double, history array<struct<time string, price double>>, stale boolean>>, errors array<string>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file (an object, an array of objects); a missing or damaged file has none."""
    try:
        rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
        rows.isEmpty()
    except Exception:
        return spark.createDataFrame([], schema)
    return rows.filter("_corrupt IS NULL").drop("_corrupt")


def watchlist(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """Entries with an id, or the default if there are none."""
    rows = read_json(spark, path, WATCHLIST).filter("id IS NOT NULL")
    return default if rows.isEmpty() else rows


def previous_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of the last state; null histories are empty."""
    rows = read_json(spark, path, STATE).select(F.explode("items").alias("i")).select("i.*").filter("id IS NOT NULL")
    return rows.withColumn("history", F.coalesce("history", F.expr("array()").cast("array<struct<time string, price double>>")))


def observation_time(raw: Column, now: Column) -> Column:
    """Fourteen digits as a date and a time; other text as it is; now for nothing."""
    digits = raw.rlike(r"^\d{14}$")
    read = F.date_format(F.try_to_timestamp(F.when(digits, raw), F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", now).otherwise(F.coalesce(read, raw))


def derived_change(change: Column, percent: Column, price: Column, before: Column) -> tuple[Column, Column]:
    """Change and percentage, computed where they are missing; no percentage against nothing or zero."""
    c = F.coalesce(change, price - before)
    return c, F.coalesce(percent, c / F.nullif(before, F.lit(0.0)) * 100)


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from a page's address, in Arrow batches; null if either is."""

    @F.pandas_udf("string")
    def join(bases, links):  # type: ignore[no-untyped-def]
        from urllib.parse import urljoin

        def one(b, x):  # type: ignore[no-untyped-def]
            try:
                return None if b is None or x is None else urljoin(b, x)
            except ValueError:
                return None

        return bases.combine(links, one)

    return join(base, link)
