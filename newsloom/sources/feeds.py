"""Feeds, listings and delimited payloads as Column expressions over landed text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean_text, looks_mojibake, url_date


def rss_entries(docs: DataFrame, id_col: str, xml: str) -> DataFrame:
    """id, pos, title, link, published, description of a feed's items; items without a title or link, or with garbled
    titles, are dropped. Text that is no XML gives no rows."""
    item = F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), 1)
    rows = docs.select(id_col, F.posexplode(item).alias("pos", "_i"))

    def part(tag: str) -> Column:
        inner = F.regexp_extract("_i", rf"(?s)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
        return clean_text(inner)

    out = rows.select(id_col, "pos", part("title").alias("title"), part("link").alias("link"), part("pubDate").alias("published"), part("description").alias("description"))
    return out.filter((F.col("title") != "") & (F.col("link") != "") & ~looks_mojibake(F.col("title")))


def recent(links: DataFrame, url: str, today: Column, days: int = 3) -> DataFrame:
    """Links whose address is dated and not older than `days` before today."""
    return links.withColumn("date", url_date(F.col(url))).filter(F.col("date") >= F.date_sub(today, days))


def delimited(payload: Column, sign: str, fields: Mapping[str, int], numbers: set[str], least: int) -> Column:
    """A struct of the fields at their places (from 0) of a delimited payload, null if there are fewer than `least`.

    Numbers that can't be read, and NaN and infinity, are null.
    """
    body = F.regexp_extract(payload, r'(?s)^(?:[^"]*=\s*")?([^"]*)"?;?\s*$', 1)
    parts = F.split(body, F.lit("\\Q" + sign + "\\E"))

    def value(name: str, at: int) -> Column:
        v = F.get(parts, F.lit(at))
        if name not in numbers:
            return F.nullif(v, F.lit("")).alias(name)
        d = v.try_cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d).alias(name)

    return F.when(F.size(parts) >= least, F.struct(*(value(n, i) for n, i in fields.items())))
