"""Writers: feeds as RSS, payloads as JSON, digests as Markdown. Each writes one text per partition or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.pages import rss_item

_HEAD = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{}</title>'


def rss_feed(entries: DataFrame, group: str, pos: str, channel: str, columns: tuple[str, str, str, str, str]) -> DataFrame:
    """group, xml: a feed of each group's entries in order; as long as the group, so cut the groups before."""
    item = rss_item(*(F.col(c) for c in columns))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, item.alias("i")))), lambda s: s["i"]), "")
    return entries.groupBy(group).agg(F.concat(F.lit(_HEAD.format(channel)), items, F.lit("</channel></rss>")).alias("xml"))


def ascii_references(text: Column) -> Column:
    """Characters outside ASCII as numeric references."""

    @F.pandas_udf("string")
    def encode(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: None if t is None else t.encode("ascii", "xmlcharrefreplace").decode())

    return encode(text)


def json_payload(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, json: one JSON text per row; nulls are kept."""
    return rows.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_digest(ranked: DataFrame, group: str, pos: str, title: str, url: str, must: int = 10) -> DataFrame:
    """group, text: two numbered lists of links per group, the first `must` and the rest."""
    line = F.concat(F.col(pos).cast("string"), F.lit(". ["), F.regexp_replace(title, r"([\[\]])", r"\\$1"), F.lit("]("), F.coalesce(F.col(url), F.lit("")), F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l"))))
    part = lambda keep: F.array_join(F.transform(F.filter(rows, keep), lambda s: s["l"]), "\n")
    text = F.concat(F.lit("## Must read\n"), part(lambda s: s["p"] <= must), F.lit("\n\n## More\n"), part(lambda s: s["p"] > must), F.lit("\n"))
    return ranked.groupBy(group).agg(text.alias("text"))
