"""The core's queries: name -> callable (spark, data directory) -> DataFrame. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import lexicon
from newsloom.functions import score as S
from newsloom.functions import text as T
from newsloom.operators import cluster, digest, events, history, merge, pages, rollup, scan
from newsloom.operators.instants import utc_instants
from newsloom.tables import table, written

CURATED, DIGEST = 0.76, 0.78
#: Tracks whose patterns occur in the tables; the lexicon's own name events that they lack.
TABLE_TRACKS = (("storage", ("电池|储能柜|battery",)), ("vaccines", ("疫苗|vaccine",)), ("bank-bonds", ("债券|bond", "银行|bank")), ("chips", ("芯片|chip|sensor|传感器",)))
MARKER = "<!-- global-nav -->"


# ---- base rows ---------------------------------------------------------------------------------------------------------
def news(spark: SparkSession, root: str) -> DataFrame:
    """One row per snapshot item, redelivered copies removed."""
    return scan.latest_rows(table(spark, root, "news_items"), "id", [F.col("ingested_at")])


def items(spark: SparkSession, root: str) -> DataFrame:
    """One row per scored item, the latest delivery, with its source's name and trust, as events take it."""
    latest = scan.latest_rows(table(spark, root, "scored_items"), "item_id", [F.col("ingested_at"), F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1e300))])
    sources = table(spark, root, "platforms").select("id", "name", F.lit(None).cast("int").alias("trust"))
    sources = sources.unionByName(table(spark, root, "rss_feeds").select("id", "name", "trust"))
    rows = latest.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "trust"), "source_id", "left")
    title = F.coalesce("title", F.lit(""))
    rank, count = T.positive(F.col("best_rank")), F.greatest(F.lit(1), F.coalesce("crawl_count", F.lit(1)))
    trust = F.coalesce("trust", F.lit(lexicon.DEFAULT_TRUST))
    base = S.item_score(title, F.lit(lexicon.DEFAULT_WEIGHT), count, rank, trust)
    return rows.select(
        "item_id",
        F.col("crawl_date").alias("date"),
        "kind",
        F.coalesce("source_id", F.lit("none")).alias("source_id"),
        F.coalesce("source_name", F.lit("综合来源")).alias("source_name"),
        title.alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.round(base, 4).alias("score"),
        trust.alias("trust"),
        count.alias("count"),
        rank.alias("best_rank"),
        T.crawl_time(F.col("crawl_date"), F.col("first_time")).alias("first_at"),
        T.crawl_time(F.col("crawl_date"), F.col("last_time")).alias("last_at"),
        T.title_key(F.col("title")).alias("title_key"),
    )


def event_items(spark: SparkSession, root: str) -> DataFrame:
    """Items with the key of their event: equal title keys, or equal topics."""
    rows = items(spark, root).filter("title <> ''")
    return rows.withColumn("event_key", S.cluster_key(F.col("title"), F.col("title_key"))).filter("event_key <> ''")


def scored_events(spark: SparkSession, root: str) -> DataFrame:
    rows = written(event_items(spark, root), "event-items")
    return events.event_score(events.dimensions(rows, events.roll_up(rows)))


# ---- scans ---------------------------------------------------------------------------------------------------------------
def hotlist_scan(spark: SparkSession, root: str) -> DataFrame:
    """Left joins to a dimension and to an aggregated history, with a fallback count and the score of a ranked list."""
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), "o_custkey")
    named = scan.with_source(orders, "o_custkey", table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "unknown")
    ranked = scan.with_ranks(named, "id", table(spark, root, "lineitem"), "l_orderkey", "l_linenumber")
    score = S.digest_item_score(F.lit(lexicon.DEFAULT_WEIGHT), F.greatest(F.lit(1), F.col("points")), F.col("best_rank"))
    return ranked.select("id", "title", "source_name", "best_rank", "worst_rank", "points", F.round(score, 4).alias("score"))


def news_scan(spark: SparkSession, root: str) -> DataFrame:
    named = scan.with_source(news(spark, root), "platform_id", table(spark, root, "platforms"), "综合来源")
    return named.select(
        "id", F.col("crawl_date").alias("date"), "source_name", T.clean_text(F.col("title")).alias("title"), T.positive(F.col("rank")).alias("rank"),
        T.crawl_time(F.col("crawl_date"), F.col("first_crawl_time")).alias("first_at"), T.crawl_time(F.col("crawl_date"), F.col("last_crawl_time")).alias("last_at"),
        F.greatest(F.lit(1), F.coalesce("crawl_count", F.lit(1))).alias("count"),
    )


def feed_scan(spark: SparkSession, root: str) -> DataFrame:
    entries = scan.latest_rows(table(spark, root, "feed_entries"), "entry_id", [F.col("received_at")])
    named = scan.with_source(entries, "source", table(spark, root, "rss_feeds"), "综合来源")
    return named.select("entry_id", "source_name", T.clean_text(F.col("title")).alias("title"), T.shortened(F.col("summary"), 30, r"（来源：.*?）").alias("summary"))


def source_profiles(spark: SparkSession, root: str) -> DataFrame:
    return items(spark, root).select("item_id", "source_id", "source_name", "trust")


def recent_partitions(spark: SparkSession, root: str) -> DataFrame:
    return scan.recent_partitions([(table(spark, root, "news_items"), "crawl_date"), (table(spark, root, "scored_items"), "crawl_date")], 7)


def all_partitions(spark: SparkSession, root: str) -> DataFrame:
    return scan.partitions([(table(spark, root, "news_items"), "crawl_date"), (table(spark, root, "events"), "ts")])


# ---- scalars -------------------------------------------------------------------------------------------------------------
def _titles(spark: SparkSession, root: str, *columns: Column) -> DataFrame:
    return items(spark, root).select("item_id", *columns)


def title_keys(spark: SparkSession, root: str) -> DataFrame:
    feed = T.title_key(F.col("title"), lexicon.FEED_NOISE).alias("feed_key")
    plain = T.title_key(F.col("title"), clean=False).alias("plain_key")
    return _titles(spark, root, "title_key", feed, plain)


def term_hits(spark: SparkSession, root: str) -> DataFrame:
    hits = T.term_hits(F.col("title"), lexicon.DIGEST_IMPORTANT)
    return _titles(spark, root, F.array_join(hits, ",").alias("hits"), F.size(hits).alias("n"))


def lexicon_scores(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, root, S.important_points(t).alias("important"), S.water_points(t).alias("water"), T.capped(t, lexicon.DIGEST_IMPORTANT, 3, 20).alias("terms"), S.is_digest(t).alias("digest"))


def domains(spark: SparkSession, root: str) -> DataFrame:
    return _titles(spark, root, F.array_join(S.domains(F.col("title")), ",").alias("domains"))


def category_scores(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, root, *(S.category_points(t, c).alias(c) for c in lexicon.CATEGORY_RULES), S.primary_category(t).alias("category"))


def topics_and_buckets(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, root, S.topic(t).alias("topic"), S.cluster_key(t, F.col("title_key")).alias("key"), S.bucket(t).alias("bucket"))


def item_scores(spark: SparkSession, root: str) -> DataFrame:
    shown = S.display_score(F.col("score"), F.col("title"), F.col("trust"))
    digest = S.digest_item_score(F.lit(lexicon.DEFAULT_WEIGHT), F.col("count"), F.col("best_rank"))
    return _titles(spark, root, "score", F.round(shown, 3).alias("shown"), F.round(digest, 4).alias("digest_score"))


def candidate_items(spark: SparkSession, root: str) -> DataFrame:
    """Items worth an event: by score, rank or wording, no digests and little of what fills space."""
    t, rank = F.col("title"), F.col("best_rank")
    important, water = S.important_points(t), S.water_points(t)
    out = (S.is_digest(t) & (important < 20)) | ((water >= 14) & (important < 8))
    good = (F.col("score") >= 30) | (F.coalesce(rank <= 12, F.lit(False)) & (water < 10)) | (important >= 8)
    return items(spark, root).filter(~out & good).select("item_id", "score")


def crawl_times(spark: SparkSession, root: str) -> DataFrame:
    return _titles(spark, root, "first_at", "last_at")


def mojibake_entries(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "feed_entries").filter(T.looks_mojibake(F.col("title")) | T.looks_mojibake(F.col("summary")))
    return rows.select("entry_id").distinct()


def url_dates(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "feed_entries").select("entry_id", T.url_date(F.col("url")).alias("date"), F.contains("url", F.lit(".example/")).alias("known"))
    return rows.filter("date IS NOT NULL AND known").distinct()


def escaped_titles(spark: SparkSession, root: str) -> DataFrame:
    return _titles(spark, root, T.html_escape(F.col("title")).alias("escaped"))


# ---- events --------------------------------------------------------------------------------------------------------------
def exact_events(spark: SparkSession, root: str) -> DataFrame:
    return events.roll_up(event_items(spark, root))


def event_scores(spark: SparkSession, root: str) -> DataFrame:
    return scored_events(spark, root).select("event_key", "impact", "credibility", "novelty", "follow_up", "proximity", "score")


def event_categories(spark: SparkSession, root: str) -> DataFrame:
    rows = written(event_items(spark, root), "event-items")
    return events.category_vote(rows, events.roll_up(rows))


def event_trends(spark: SparkSession, root: str) -> DataFrame:
    return events.trend(event_items(spark, root)).withColumn("prev_date", F.col("prev_date").cast("string"))


def representative_items(spark: SparkSession, root: str) -> DataFrame:
    return events.representatives(event_items(spark, root)).select("event_key", "pos", "item_id")


def top_events(spark: SparkSession, root: str) -> DataFrame:
    """The 50 best events of each date's last, marked as the first ten or the rest."""
    ranked = rollup.ranked_within(scored_events(spark, root), "last_date", [F.desc("score"), "event_key"], 50)
    return ranked.select("last_date", "pos", "event_key", "score", (F.col("pos") <= 10).alias("must"))


def tracks(spark: SparkSession, root: str) -> DataFrame:
    """The latest event of each topic."""
    rows = exact_events(spark, root).withColumn("topic", S.topic(F.col("title"), TABLE_TRACKS)).filter("topic IS NOT NULL")
    return rollup.ranked_within(rows, "topic", [F.desc("last_at"), F.desc("max_score"), "event_key"], 1).select("topic", "event_key", "last_at")


# ---- roll-ups ------------------------------------------------------------------------------------------------------------
def category_rollup(spark: SparkSession, root: str) -> DataFrame:
    latest = scan.latest_rows(table(spark, root, "trend_events"), "event_id", [F.col("last_seen_at"), F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1e300))])
    return rollup.with_total(latest, "category", {"n": F.count("*"), "sources": F.sum("source_count"), "best": F.max(F.nanvl("score", F.lit(None)))})


def category_counts(spark: SparkSession, root: str) -> DataFrame:
    known = table(spark, root, "trend_events").select(F.col("category").alias("c")).filter("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n"))
    groups = spark.createDataFrame([(c,) for c in lexicon.CATEGORIES], "c string")
    return rollup.zero_filled(known, groups, "c", ["n"]).withColumnRenamed("c", "category")


def source_rollup(spark: SparkSession, root: str) -> DataFrame:
    rows = news_scan(spark, root)
    return rollup.with_total(rows, "source_name", {"n": F.count("*"), "high": F.count_if(F.col("rank") <= 5), "first_at": F.min("first_at"), "last_at": F.max("last_at")})


def top_sources(spark: SparkSession, root: str) -> DataFrame:
    return rollup.top_groups(items(spark, root), "source_id", 16)


def source_hotlists(spark: SparkSession, root: str) -> DataFrame:
    """Each source's twenty best items of the newest date."""
    rows = items(spark, root)
    newest = rows.agg(F.max("date").alias("date"))
    return rollup.ranked_within(rows.join(newest, "date", "left_semi"), "source_id", [F.desc("score"), F.desc("count"), F.desc("last_at"), "item_id"], 20).select("source_id", "pos", "item_id", "score")


def summary_cells(spark: SparkSession, root: str) -> DataFrame:
    rows = event_items(spark, root)
    once = rows.groupBy("event_key", "source_id").agg(F.count("*").alias("n"), F.collect_set(S.primary_category(F.col("title"))).alias("c"))
    return once.agg(F.count_distinct("event_key").alias("events"), F.sum("n").alias("items"), F.count_distinct("source_id").alias("sources"), F.size(F.array_distinct(F.flatten(F.collect_set("c")))).cast("long").alias("categories"))


def archive(spark: SparkSession, root: str) -> DataFrame:
    """Per date the best title and how many items there are, 50 at most."""
    best = F.struct(F.col("score"), (-F.col("item_id")).alias("i"))
    return items(spark, root).groupBy("date").agg(F.max_by("title", best).alias("title"), F.least(F.count("*"), F.lit(50)).alias("n"))


def month_groups(spark: SparkSession, root: str) -> DataFrame:
    days = items(spark, root).groupBy("date").agg(F.count("*").alias("n")).withColumn("month", F.date_format("date", "yyyy-MM"))
    return rollup.change_groups(days, "date", "month")


# ---- histories -----------------------------------------------------------------------------------------------------------
def quote_history(spark: SparkSession, root: str) -> DataFrame:
    return history.last_points(table(spark, root, "events"), "user_id", "ts", "value")


def quote_changes(spark: SparkSession, root: str) -> DataFrame:
    out = history.with_change(quote_history(spark, root), "user_id")
    return out.select("user_id", "pos", F.round("change", 4).alias("change"), F.round("percent", 3).alias("percent"))


def stale_values(spark: SparkSession, root: str) -> DataFrame:
    """The last value of each user after a date, the one before it marked stale where there is none."""
    rows, cut = table(spark, root, "events"), F.lit("2024-01-29").cast("timestamp_ntz")
    last = lambda df: df.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    ts = F.col("ts").cast("timestamp_ntz")
    return history.or_stale(last(rows.filter((ts >= cut) & (F.col("event_type") == "purchase"))), last(rows.filter(ts < cut)), "user_id")


def sparklines(spark: SparkSession, root: str) -> DataFrame:
    out = history.sparkline(quote_history(spark, root), "user_id")
    return out.select("user_id", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def quote_stream(spark: SparkSession, root: str) -> DataFrame:
    from newsloom.streaming.quotes import history_stream

    return history_stream(spark, f"{root}/events.parquet")


# ---- pages ---------------------------------------------------------------------------------------------------------------
def batch_pages(spark: SparkSession, root: str) -> DataFrame:
    """A page per source and batch with its entries as links: batch_no, source, urls and html."""
    rows = scan.latest_rows(table(spark, root, "feed_entries"), "entry_id", [F.col("received_at")]).filter("source IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL")
    link = F.concat(F.lit('<div class="row"><a href="'), "url", F.lit('">'), T.html_escape(F.col("title")), F.lit("</a></div>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entry_id", link.alias("l")))), lambda s: s["l"])
    return rows.groupBy("source", "batch_no").agg(F.concat(F.lit("<html><body><div>"), F.array_join(lines, "\n"), F.lit("</div></body></html>")).alias("html"))


def html_links(spark: SparkSession, root: str) -> DataFrame:
    page = F.concat_ws("/", "source", "batch_no").alias("page")
    found = pages.links(batch_pages(spark, root).select(page, "html"), "page", "html")
    return found.select("page", "url", "title")


def div_depths(spark: SparkSession, root: str) -> DataFrame:
    page = F.concat_ws("/", "source", "batch_no").alias("page")
    return pages.div_depths(batch_pages(spark, root).select(page, "html"), "page", "html")


def section_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """Of a source's batches those with a set of addresses that no earlier batch has."""
    rows = batch_pages(spark, root).select("source", "batch_no", pages.url_set(F.col("html")).alias("urls"))
    return pages.first_sections(rows, "source", "batch_no", "urls").select("source", "batch_no", F.size("urls").alias("n"))


def page_patch(spark: SparkSession, root: str) -> DataFrame:
    once, changed = pages.patched(F.col("html"), MARKER, "<nav>home</nav>")
    rows = batch_pages(spark, root).select("source", "batch_no", once.alias("html"), changed.alias("changed"))
    again, second = pages.patched(F.col("html"), MARKER, "<nav>home</nav>")
    return rows.select("source", "batch_no", F.md5("html").alias("md5"), "changed", second.alias("changed_again"))


def rss_export(spark: SparkSession, root: str) -> DataFrame:
    rows = scan.latest_rows(table(spark, root, "feed_entries"), "entry_id", [F.col("received_at")]).filter("title IS NOT NULL")
    item = pages.rss_item(F.col("title"), F.col("url"), F.col("source"), F.col("summary"), F.col("received_at"))
    return rows.select("entry_id", F.md5(item).alias("md5"))


# ---- sources and the digest ----------------------------------------------------------------------------------------------
def profiles(spark: SparkSession, root: str) -> DataFrame:
    """source_id, tier, type, weight, trust, hint, digest_weight: the known profiles, given to the tables' sources in order.

    The tables have none of the sources that are profiled by name, so the k-th platform stands for the k-th profile.
    """
    known = [(i, name, *lexicon.SOURCE_PROFILES[name], lexicon.SOURCE_HINTS.get(name), lexicon.SOURCE_WEIGHTS[name]) for i, name in enumerate(lexicon.SOURCE_PROFILES)]
    dim = spark.createDataFrame(known, "k int, profile string, tier string, type string, weight int, trust int, hint string, digest_weight int")
    # 25 platforms, a fixed dimension
    placed = table(spark, root, "platforms").select(F.col("id").alias("source_id"), (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))
    return placed.join(dim, "k").drop("k", "profile")


def profiled_items(spark: SparkSession, root: str) -> DataFrame:
    """Items with the tier, type, weight and trust of their source, and the score that these give."""
    rows = items(spark, root).drop("score", "trust").join(profiles(spark, root), "source_id", "left")
    weight, trust = F.coalesce("weight", F.lit(lexicon.DEFAULT_WEIGHT)), F.coalesce("trust", F.lit(lexicon.DEFAULT_TRUST))
    score = S.item_score(F.col("title"), weight, F.col("count"), F.col("best_rank"), trust)
    return rows.select("item_id", F.coalesce("tier", F.lit(lexicon.DEFAULT_TIER)).alias("tier"), F.coalesce("type", F.lit(lexicon.DEFAULT_TYPE)).alias("type"), weight.alias("weight"), trust.alias("trust"), F.round(score, 4).alias("score"))


def category_votes(spark: SparkSession, root: str) -> DataFrame:
    """Categories of events with the sources' hints where the wording says nothing."""
    rows = event_items(spark, root).join(profiles(spark, root).select("source_id", "hint"), "source_id", "left")
    rows = written(rows, "event-items")
    found = events.category_vote(rows, events.roll_up(rows), hint=F.col("hint"))
    return found.select("event_key", "category", digest.looked_up(F.col("category"), lexicon.CATEGORY_LABELS, "综合").alias("label"))


def digest_items(spark: SparkSession, root: str) -> DataFrame:
    """Items as the digest scores them: hot lists by rank and persistence, feeds by source, day and terms."""
    latest = scan.latest_rows(table(spark, root, "scored_items"), "item_id", [F.col("ingested_at"), F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1e300))])
    rows = latest.select("item_id", "kind", "crawl_date", "published_at", "summary").join(items(spark, root).drop("kind", "score"), "item_id").join(profiles(spark, root).select("source_id", "digest_weight"), "source_id", "left")
    weight = F.coalesce("digest_weight", F.lit(8))
    score = F.when(F.col("kind") == "rss", digest.feed_score(weight, F.col("published_at"), F.col("crawl_date"), F.col("title"))).otherwise(S.digest_item_score(weight, F.col("count"), F.col("best_rank")))
    return rows.select(
        "item_id", "date", "kind", "source_id", "source_name", "title", "url", T.shortened(F.col("summary"), 180).alias("summary"), "count", "best_rank", "first_at", "last_at",
        F.round(score.cast("double"), 4).alias("score"),
    )


def feed_scores(spark: SparkSession, root: str) -> DataFrame:
    return digest_items(spark, root).select("item_id", "kind", "score", "summary")


_DIGEST = ("items", "count", "score", "title", "sources", "source_label", "rank_label", "final_score")


def _digest_rows(rows: DataFrame) -> DataFrame:
    rolled = digest.cluster_rollup(rows).withColumn("rank_label", digest.rank_label(F.col("best_rank"), F.col("worst_rank")))
    return rolled.withColumn("final_score", F.round("final_score", 4)).select("cluster", *_DIGEST)


def digest_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The digest's roll-up over each date's items with equal keys."""
    key = F.concat_ws("|", F.col("date").cast("string"), T.title_key(F.col("title"), clean=False))
    return _digest_rows(digest_items(spark, root).filter("title <> ''").withColumn("cluster", key))


def digest_ranking(spark: SparkSession, root: str) -> DataFrame:
    """The 50 best clusters of each date, clustered greedily (C2), by final score."""
    rows = written(digest_items(spark, root).filter("title <> ''"), "digest-items")
    keyed = rows.select("item_id", T.title_key(F.col("title"), clean=False).alias("key"), F.col("date").cast("string").alias("bucket"), "score")
    placed = rows.join(cluster.linked_clusters(keyed, DIGEST).withColumnRenamed("event_id", "cluster"), "item_id")
    dated = _digest_rows(placed).join(placed.select("cluster", "date").distinct(), "cluster")
    return rollup.ranked_within(dated, "date", [F.desc("final_score"), "cluster"], 50).select("date", "pos", "cluster", *_DIGEST)


def clustered_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of the greedy clustering (C1), over all dates, with their dimensions, score, category and trend."""
    placed = cluster_events(spark, root).select("item_id", F.col("event_id").cast("string").alias("event_key"))
    rows = written(items(spark, root).filter("title <> ''").join(placed, "item_id"), "clustered-items")
    rolled = written(events.roll_up(rows), "clustered-events")
    scored = events.event_score(events.dimensions(rows, rolled))
    return scored.join(events.category_vote(rows, rolled), "event_key").join(digest.trend_states(rows), "event_key").select(
        "event_key", "items", "title", "sources", "kinds", "dates", "last_date", "occurrences", "water", "score", "category", "state"
    )


def trend_states(spark: SparkSession, root: str) -> DataFrame:
    return digest.trend_states(event_items(spark, root))


def source_previews(spark: SparkSession, root: str) -> DataFrame:
    return digest.source_preview(event_items(spark, root), "event_key", "source_name")


def category_ranks(spark: SparkSession, root: str) -> DataFrame:
    """Places of events within their category and among all; the general ones have none within."""
    latest = scan.latest_rows(table(spark, root, "trend_events"), "event_id", [F.col("last_seen_at"), F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1e300))])
    rows = latest.filter("category IS NOT NULL").select("event_id", "category", F.coalesce(F.nanvl("score", F.lit(None)), F.lit(-1e300)).alias("score"))
    shown = rollup.ranked_within(rows.filter("category <> 'general'"), "category", [F.desc("score"), "event_id"], 50)
    every = rollup.ranked_within(rows.withColumn("category", F.lit("all")), "category", [F.desc("score"), "event_id"], 50)
    return shown.unionByName(every).select("category", "pos", "event_id")


def month_counts(spark: SparkSession, root: str) -> DataFrame:
    """Each date that has items, its labels, and how many dates its month has."""
    days = items(spark, root).filter("date IS NOT NULL").select("date").distinct().withColumn("month", F.date_format("date", "yyyy年MM月"))
    return days.withColumn("n", F.count("*").over(Window.partitionBy("month"))).withColumn("day", F.date_format("date", "MM月dd日"))


def archive_titles(spark: SparkSession, root: str) -> DataFrame:
    """Every date with the title of the best event that ends on it, or a placeholder."""
    dates = scan.partitions([(table(spark, root, "news_items"), "crawl_date"), (table(spark, root, "scored_items"), "crawl_date")])
    best = rollup.ranked_within(exact_events(spark, root).filter("items > 1"), "last_date", [F.desc("max_score"), "event_key"], 1)
    return dates.join(best.select(F.col("last_date").alias("date"), "title"), "date", "left").select("date", F.coalesce("title", F.lit("暂无数据")).alias("title"))


def iso_times(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "scored_items").filter("item_id IS NOT NULL").select("item_id", T.iso_time(F.col("published_at"), F.col("crawl_date"), F.col("first_time")).alias("at"))
    return rows.distinct()


def zone_days(spark: SparkSession, root: str) -> DataFrame:
    """How many entries arrive on each date of their feed's zone."""
    feeds = table(spark, root, "rss_feeds").select(F.col("id").alias("source"), "tz")
    rows = scan.latest_rows(table(spark, root, "feed_entries"), "entry_id", [F.col("received_at")]).join(feeds, "source", "left")
    return rows.groupBy(T.zone_day(F.col("received_at"), F.col("tz")).alias("day")).agg(F.count("*").alias("n"))


def change_labels(spark: SparkSession, root: str) -> DataFrame:
    c = F.round("change", 4)
    return quote_changes(spark, root).select("user_id", "pos", T.change_class(c).alias("class"), T.signed(c).alias("label"))


# ---- quotes --------------------------------------------------------------------------------------------------------------
def payloads(spark: SparkSession, root: str) -> DataFrame:
    """event_id, type, raw: payloads as sources send them, made of the events table, some cut and some of no known type."""
    e = table(spark, root, "events").select("event_id", F.col("value").cast("string").alias("v"), F.pmod("event_id", F.lit(7)).alias("m"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMddHHmmss").alias("t"))
    price = F.coalesce("v", F.lit("-"))
    stock = [F.lit("1"), F.concat(F.lit("n"), F.col("event_id")), F.lit("c"), price, F.when(F.col("m") == 0, "0").otherwise("40"), F.lit("41"), *[F.lit("0")] * 24, F.col("t"), F.lit(""), F.lit(""), price, F.lit("nan"), F.lit("x"), F.lit("1200"), F.lit("7")]
    other = [price, F.lit(""), F.lit("0"), F.lit("0"), F.lit("9.5"), F.lit("inf"), F.lit("12:00:00"), F.lit("50"), F.lit("51"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("2024-01-05"), F.concat(F.lit("g"), F.col("event_id"))]
    body = F.when(F.col("m") < 3, F.array_join(F.array(*stock), "~")).when(F.col("m") < 5, F.array_join(F.array(*other), ",")).otherwise(F.lit("1~cut"))
    kind = F.when(F.col("m") < 3, "tencent_stock").when(F.col("m") < 5, "tencent_global").when(F.col("m") == 5, "tencent_stock").otherwise("other")
    return e.select("event_id", kind.alias("type"), F.concat(F.lit('v_x="'), body, F.lit('";')).alias("raw"))


def quotes(spark: SparkSession, root: str) -> DataFrame:
    """Quotes of the payloads by type, with derived changes; what can't be read has an error instead."""
    from newsloom.sources.quotes import parsed

    return parsed(payloads(spark, root), "type", "raw").select("event_id", "name", "price", "before", F.round("change", 4).alias("change"), F.round("percent", 4).alias("percent"), "time", "high", "error")


# ---- order-dependent folds -----------------------------------------------------------------------------------------------
def cluster_events(spark: SparkSession, root: str) -> DataFrame:
    """Greedy clustering within buckets over all dates; topics join equals only."""
    rows = items(spark, root).filter("title <> ''").withColumn("key", S.cluster_key(F.col("title"), F.col("title_key"))).withColumn("bucket", S.bucket(F.col("title")))
    return cluster.linked_clusters(rows, CURATED, tuple(t for t, _ in lexicon.TRACKS))


def cluster_digest(spark: SparkSession, root: str) -> DataFrame:
    """Greedy clustering of each date's snapshot items."""
    rows = news(spark, root).select(F.col("id").alias("item_id"), T.title_key(F.col("title"), clean=False).alias("key"), F.col("crawl_date").cast("string").alias("bucket"), "crawl_count", "rank")
    score = S.digest_item_score(F.lit(lexicon.DEFAULT_WEIGHT), F.greatest(F.lit(1), F.coalesce("crawl_count", F.lit(1))), T.positive(F.col("rank")))
    return cluster.greedy_clusters(rows.withColumn("score", score), DIGEST)


def fuzzy_pairs(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of items with similar keys within a bucket of the event clustering, dates aside."""
    rows = items(spark, root).filter("title_key <> ''").select("item_id", F.col("title_key").alias("key"), S.bucket(F.col("title")).alias("bucket"))
    return cluster.fuzzy_pairs(rows, CURATED)


def timeline(spark: SparkSession, root: str) -> DataFrame:
    rows = event_items(spark, root).withColumn("event_id", F.xxhash64("event_key"))
    return cluster.timeline_nodes(rows.select("event_id", "item_id", "date", "last_at", "score", "count", F.col("title_key").alias("key")), CURATED)


def round_robin(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "feed_entries").filter("source IS NOT NULL").select("source", F.col("entry_id").alias("item_id"), T.title_key(F.col("title"), lexicon.FEED_NOISE).alias("key"))
    return merge.round_robin(rows, [], 120)


# ---- time ----------------------------------------------------------------------------------------------------------------
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """tbl, row_id, field, utc_us: every value of the time columns that denotes one instant."""
    sources = table(spark, root, "platforms").select("id", "tz", "day_first").unionByName(table(spark, root, "rss_feeds").select("id", "tz", "day_first"))
    scored = utc_instants(table(spark, root, "scored_items"), "item_id", ["first_time", "last_time", "published_at"], sources, "source_id", "crawl_date")
    entries = utc_instants(table(spark, root, "feed_entries"), "entry_id", ["published"], sources, "source")
    return scored.select(F.lit("scored_items").alias("tbl"), "*").unionByName(entries.select(F.lit("feed_entries").alias("tbl"), "*"))


QUERIES = {
    f.__name__: f
    for f in (
        hotlist_scan, news_scan, feed_scan, source_profiles, recent_partitions, all_partitions, title_keys, term_hits, lexicon_scores, domains,
        category_scores, topics_and_buckets, item_scores, candidate_items, crawl_times, mojibake_entries, url_dates, escaped_titles, exact_events, event_scores,
        event_categories, event_trends, representative_items, top_events, tracks, category_rollup, category_counts, source_rollup, top_sources,
        source_hotlists, summary_cells, archive, month_groups, quote_history, quote_changes, stale_values, sparklines, quote_stream, html_links,
        div_depths, section_dedupe, page_patch, rss_export, cluster_events, cluster_digest, fuzzy_pairs, timeline, round_robin, p5_found,
        profiled_items, category_votes, feed_scores, digest_clusters, digest_ranking, clustered_events, trend_states, source_previews, category_ranks,
        month_counts, archive_titles, iso_times, zone_days, change_labels, quotes,
    )
}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """The query that __spark_entry__.entry runs: the best events of each date."""
    return top_events(spark, root)
