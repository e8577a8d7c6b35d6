"""HTML pages: links, sections, nesting, patches; feeds as RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import clean_text, html_escape, looks_mojibake

_ANCHOR = r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def links(pages: DataFrame, id_col: str, html: str, min_chars: int = 6) -> DataFrame:
    """id, pos, url, title of a page's anchors with a title long enough and readable, script links aside."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(_ANCHOR), 1).alias("url"), F.regexp_extract_all(html, F.lit(_ANCHOR), 2).alias("title"))
    rows = pages.select(id_col, F.posexplode(pairs).alias("pos", "_a")).select(id_col, "pos", F.col("_a")["url"].alias("url"), clean_text(F.col("_a")["title"]).alias("title"))
    return rows.filter((F.length("title") >= min_chars) & ~looks_mojibake(F.col("title")) & ~F.col("url").startswith("javascript"))


def url_set(html: Column) -> Column:
    """The distinct addresses of a page's anchors, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(_ANCHOR), 1)))


def first_sections(sections: DataFrame, page: str, pos: str, urls: str) -> DataFrame:
    """Sections without those whose non-empty set of addresses an earlier section of the page has."""
    w = Window.partitionBy(page, urls).orderBy(pos)
    return sections.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") == 1) | (F.size(urls) == 0)).drop("_k")


def div_depths(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """id, pos, depth after each opening or closing div tag: a running sum, within a page."""
    tags = pages.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<(/?)div\b"), 1)).alias("pos", "_close"))
    step = F.when(F.col("_close") == "/", -1).otherwise(1)
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tags.select(id_col, "pos", F.sum(step).over(w).cast("int").alias("depth"))


def patched(html: Column, marker: str, block: str) -> tuple[Column, Column]:
    """(text, changed): a block put once before </body>, known again by its marker; a second run changes nothing."""
    has = F.contains(html, F.lit(marker))
    end = F.locate("</body>", html)
    out = F.when(has | (end == 0), html).otherwise(F.concat(F.substr(html, F.lit(1), end - 1), F.lit(marker + block), F.substr(html, end)))
    return out, ~out.eqNullSafe(html)


def rss_item(title: Column, link: Column, source: Column, summary: Column, when: Column) -> Column:
    """An RSS item; what isn't ASCII stays as it is."""
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    date = F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss")
    return F.concat(
        F.lit("<item><title>"), esc(title), F.lit("</title><link>"), esc(link), F.lit("</link><source>"), esc(source), F.lit("</source><description>"),
        esc(F.when(F.coalesce(summary, F.lit("")) == "", title).otherwise(summary)), F.lit("</description><pubDate>"), date, F.lit(" +0000</pubDate></item>"),
    )
