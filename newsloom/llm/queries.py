"""Queries of the training-data operators: name -> callable (spark, data directory) -> DataFrame, and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.containers import fill
from newsloom.llm.garbled import restored
from newsloom.llm.history import History
from newsloom.llm.like_titles import like_pairs, plain_keys
from newsloom.llm.lookalike_rows import odd_rows
from newsloom.llm.pii import entities, masked
from newsloom.llm.survivors import records, survivors
from newsloom.llm.tokens import token_counts, token_ids
from newsloom.llm.top_n import latest, top_n
from newsloom.tables import scratch, table

#: Batch numbers that p3_found takes at once: each look-up costs some forty stages, however small the batch.
P3_STEP = 10
TITLES = {"scored_items": "item_id", "news_items": "id", "feed_entries": "entry_id"}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """scope, group_key, pos, row_id: the 5 best items of every source and the 50 best events of every category."""
    items = latest(table(spark, root, "scored_items"), "item_id", "source_id", "score", "ingested_at")
    events = latest(table(spark, root, "trend_events"), "event_id", "category", "score", "last_seen_at")
    scopes = {"source": top_n(items, 5), "category": top_n(events, 50)}
    return reduce(DataFrame.unionByName, (df.select(F.lit(s).alias("scope"), "*") for s, df in scopes.items()))


P1_SQL = """
WITH items AS (
  SELECT item_id AS row_id, source_id AS group_key, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ingested_at DESC NULLS LAST, (score IS NOT NULL AND NOT isnan(score)) DESC, score DESC NULLS LAST, source_id DESC NULLS LAST) AS k FROM scored_items) WHERE k = 1
), events_ AS (
  SELECT event_id AS row_id, category AS group_key, score FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY last_seen_at DESC NULLS LAST, (score IS NOT NULL AND NOT isnan(score)) DESC, score DESC NULLS LAST, category DESC NULLS LAST) AS k FROM trend_events) WHERE k = 1
), ranked AS (
  SELECT 'source' AS scope, group_key, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, row_id) AS pos, row_id, 5 AS n FROM items
  WHERE group_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  UNION ALL
  SELECT 'category', group_key, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, row_id), row_id, 50 FROM events_
  WHERE group_key IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
)
SELECT scope, group_key, CAST(pos AS INTEGER) AS pos, row_id FROM ranked WHERE pos <= n
"""


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """cluster_id and the member that gives each field of the surviving record."""
    return survivors(table(spark, root, "cluster_members"))


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """cluster_id and the surviving record itself."""
    return records(table(spark, root, "cluster_members"))


_P2_MEMBERS = r"""
WITH m AS (SELECT DISTINCT * FROM cluster_members),
u AS (
  SELECT cluster_id, member_id, coalesce(trust, 0) AS trust, fetched_at, title, url, summary, published_at,
    coalesce(length(regexp_replace(title, '[^\p{L}\p{Nd}]', '', 'g')) >= 5, false) AS t_ok,
    coalesce(regexp_matches(trim(url), '(?i)^https?://[^/?#:@\s]*[\p{L}\p{Nd}][^/?#:@\s]*(:\d*)?([/?#].*)?$'), false) AS u_ok,
    coalesce(length(regexp_replace(summary, '[^\p{L}\p{Nd}]', '', 'g')) >= 10, false) AS s_ok,
    length(regexp_replace(summary, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')) AS s_len,
    coalesce(regexp_matches(trim(published_at), '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d') AND epoch_us(TRY_CAST(trim(published_at) AS TIMESTAMPTZ)) BETWEEN 946684800000000 AND epoch_us(fetched_at), false) AS p_ok
  FROM m WHERE cluster_id IS NOT NULL AND member_id IS NOT NULL),
g AS (SELECT cluster_id FROM u GROUP BY 1 HAVING count(DISTINCT member_id) > 1),
t AS (SELECT cluster_id, member_id, title FROM u WHERE t_ok QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY trust DESC, fetched_at DESC, member_id) = 1),
w AS (SELECT cluster_id, member_id, url FROM u WHERE u_ok QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY trust DESC, fetched_at DESC, member_id) = 1),
s AS (SELECT cluster_id, member_id, summary FROM u WHERE s_ok QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY s_len DESC, trust DESC, fetched_at DESC, member_id) = 1),
p AS (SELECT cluster_id, member_id, published_at FROM u WHERE p_ok QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY fetched_at DESC, trust DESC, member_id) = 1)
"""
_P2_JOIN = "FROM g LEFT JOIN t USING (cluster_id) LEFT JOIN w USING (cluster_id) LEFT JOIN s USING (cluster_id) LEFT JOIN p USING (cluster_id)"
P2_SQL = f"""{_P2_MEMBERS}
SELECT cluster_id, coalesce(t.member_id, 0) AS title_member, coalesce(w.member_id, 0) AS url_member, coalesce(s.member_id, 0) AS summary_member, coalesce(p.member_id, 0) AS published_member {_P2_JOIN}
"""
P2_RECORDS_SQL = f"{_P2_MEMBERS} SELECT cluster_id, title, url, summary, published_at {_P2_JOIN}"


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """first_id, entry_id: entries that repeat an accepted one, batches in their order against the history so far."""
    number = F.floor(F.coalesce("batch_no", F.lit(-1)) / P3_STEP).cast("int").alias("batch")
    rows = table(spark, root, "feed_entries").select(number, F.col("entry_id").alias("id"), "title", "url").filter("id IS NOT NULL")
    path = scratch(spark, "history")
    # the batches as they arrive: each a part of its own, so that a batch is read once
    rows.write.partitionBy("batch").parquet(f"{path}/arrived")
    arrived = spark.read.schema("id long, title string, url string, batch int").parquet(f"{path}/arrived")
    # entries are taken by id, so batches whose ids overlap are taken together; one row per batch
    spans: list[list] = []
    for r in arrived.groupBy("batch").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect():
        if spans and r["lo"] <= spans[-1][0]:
            spans[-1] = [max(spans[-1][0], r["hi"]), [*spans[-1][1], r["batch"]]]
        else:
            spans.append([r["hi"], [r["batch"]]])
    history = History(spark, f"{path}/history")
    found = [history.accept(arrived.filter(F.col("batch").isin(*numbers)).drop("batch")) for _, numbers in spans]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "first_id long, entry_id long")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """tbl, row_id: titles with look-alike or invisible characters."""
    return reduce(
        DataFrame.unionByName,
        (odd_rows(table(spark, root, t), i, "title").select(F.lit(t).alias("tbl"), "row_id") for t, i in TITLES.items()),
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """entry_id, field, restored_md5: garbled titles and summaries, '' where the original is lost."""
    found = restored(table(spark, root, "feed_entries"), "entry_id", ["title", "summary"])
    md5 = F.when(F.col("restored") == "", F.lit("")).otherwise(F.md5("restored"))
    return found.select(F.col("row_id").alias("entry_id"), "field", md5.alias("restored_md5"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """tbl, id_a, id_b: like titles within scored_items and within news_items."""
    tables = {t: table(spark, root, t).select(F.lit(t).alias("tbl"), F.col(TITLES[t]).alias("id"), "title") for t in ("scored_items", "news_items")}
    keyed = plain_keys(reduce(DataFrame.unionByName, tables.values()))
    counts = [t.count() for t in tables.values()]
    return like_pairs(keyed, max(counts), sum(counts))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, ids: the tokens of every document."""
    return token_ids(table(spark, root, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """container, doc_id, part, start, size: the documents in containers of 2,048 tokens."""
    return fill(token_counts(table(spark, root, "documents"), "doc_id", "text"), "doc_id", "n")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, kind, start_pos: personal information in the documents."""
    return entities(table(spark, root, "documents")).select("doc_id", "kind", F.col("start").alias("start_pos"))


def p10_masked(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, text: the documents with placeholders for personal information."""
    return masked(table(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": p10_found,
    "p10_masked": p10_masked,
}

SQL: dict[str, str] = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_records": P2_RECORDS_SQL}
