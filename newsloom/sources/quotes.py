"""Quotes from landed payloads: dispatch by type, fields by place, derived changes, an error where nothing can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.feeds import delimited
from newsloom.sources.state import derived_change

#: Type -> sign between the fields, least number of them, places of the fields.
FIELDS = {
    "tencent_stock": ("~", 35, {"name": 1, "price": 3, "before": 4, "open": 5, "time": 30, "change": 31, "percent": 32, "high": 33, "low": 34}),
    "tencent_global": (",", 14, {"price": 0, "percent": 1, "high": 4, "low": 5, "time": 6, "before": 7, "open": 8, "date": 12, "name": 13}),
}
NUMBERS = {"price", "before", "open", "change", "percent", "high", "low"}


def parsed(payloads: DataFrame, type_col: str, raw_col: str) -> DataFrame:
    """The rows with name, price, before, open, change, percent, time, high, low and error of their payloads.

    A missing or null payload, one with too few fields, one without a price and an unknown type each have an error, and
    null in the other columns.
    """
    names = ("name", "price", "before", "open", "change", "percent", "time", "high", "low")
    out = F.lit(None)
    for kind, (sign, least, places) in FIELDS.items():
        read = delimited(F.col(raw_col), sign, places, NUMBERS, least)
        value = lambda n, read=read, places=places: read[n] if n in places else F.lit(None).cast("double" if n in NUMBERS else "string")
        time = F.concat_ws(" ", read["date"], read["time"]) if "date" in places else read["time"]
        row = F.struct(*((time if n == "time" else value(n)).alias(n) for n in names))
        out = F.when(F.col(type_col) == kind, F.when(read.isNotNull(), row)).otherwise(out)
    rows = payloads.withColumn("_q", out)
    change, percent = derived_change(F.col("_q.change"), F.col("_q.percent"), F.col("_q.price"), F.col("_q.before"))
    error = F.when(~F.coalesce(F.col(type_col).isin(*FIELDS), F.lit(False)), "unknown type").when(F.col("_q").isNull(), "short payload").when(F.col("_q.price").isNull(), "no price")
    good = lambda c: F.when(error.isNull(), c)
    values = {n: change if n == "change" else percent if n == "percent" else F.col(f"_q.{n}") for n in names}
    return rows.select(*payloads.columns, *(good(v).alias(n) for n, v in values.items()), error.alias("error"))
