"""DuckDB SQL of the core's queries, over whole tables. Fragments are generated from the same lexicons."""

from __future__ import annotations

from newsloom import lexicon
from newsloom.functions.text import SPACE

_S = f"[{SPACE}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, {_q(f'^{_S}+|{_S}+$')}, '', 'g')"


def _clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {_q(name)}, {_q(char)})"
    return _trim(f"regexp_replace(regexp_replace({out}, '<[^>]+>', '', 'g'), {_q(_S + '+')}, ' ', 'g')")


def _key(c: str, noise: tuple[str, ...] = lexicon.TITLE_NOISE, clean: bool = True) -> str:
    base = f"lower({_clean(c) if clean else f'coalesce({c}, {_q(str())})'})"
    signs = lexicon.TITLE_SIGNS.replace("\\\"", '"').replace("\\'", "'")
    return f"regexp_replace(regexp_replace({base}, {_q(f'[{signs}{SPACE}]+')}, '', 'g'), '({'|'.join(noise)})$', '')"


def _hits(c: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({c}), {_q(t.lower())}) AS INTEGER)" for t in terms) + ")"


def _important(c: str) -> str:
    return f"least(36, 4 * {_hits(c, lexicon.IMPORTANT)})"


def _water(c: str) -> str:
    return f"least(24, 5 * {_hits(c, lexicon.WATER)})"


def _digest(c: str) -> str:
    return f"({_hits(c, lexicon.DIGEST_TERMS)} > 0)"


def _rank(c: str, top: str) -> str:
    return f"coalesce({top} / pow({c} + 2, 0.72), 0.0)"


def _points(c: str, category: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({c}, {_q('(?i)' + p)}) THEN {w} ELSE 0 END" for p, w in lexicon.CATEGORY_RULES[category]) + ")"


def _best(points: dict[str, str]) -> str:
    most = f"greatest({', '.join(points.values())})"
    return "CASE " + f"WHEN {most} <= 0 THEN 'general' " + " ".join(f"WHEN {p} = {most} THEN '{c}'" for c, p in points.items()) + " END"


_CATS = [c for c in lexicon.CATEGORIES if c in lexicon.CATEGORY_RULES]


def _category(c: str) -> str:
    return _best({k: _points(c, k) for k in _CATS})


def _topic(c: str, tracks: tuple = lexicon.TRACKS) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches({c}, {_q('(?i)' + g)})" for g in groups) + f" THEN '{name}'" for name, groups in tracks) + " END"


_TABLE_TRACKS = (("storage", ("电池|储能柜|battery",)), ("vaccines", ("疫苗|vaccine",)), ("bank-bonds", ("债券|bond", "银行|bank")), ("chips", ("芯片|chip|sensor|传感器",)))


def _domains(c: str) -> str:
    parts = ", ".join(f"CASE WHEN {_hits(c, terms)} > 0 THEN '{d}' END" for d, terms in lexicon.DOMAIN_TERMS.items())
    return f"[x FOR x IN [{parts}] IF x IS NOT NULL]"


def _clock(day: str, c: str) -> str:
    hm = f"replace(coalesce({c}, '00:00'), '-', ':')"
    return f"CAST(CAST({day} AS VARCHAR) || ' ' || CASE WHEN regexp_matches({hm}, '^([01]\\d|2[0-3]):[0-5]\\d$') THEN {hm} ELSE '00:00' END || ':00' AS TIMESTAMP)"


_ITEMS = f"""
src AS (SELECT id, name, NULL AS trust FROM platforms UNION ALL SELECT id, name, trust FROM rss_feeds),
latest AS (SELECT * FROM scored_items WHERE item_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ingested_at DESC NULLS LAST, CASE WHEN score IS NULL OR isnan(score) THEN -1e300 ELSE score END DESC) = 1),
raw AS (
  SELECT item_id, crawl_date AS date, kind, coalesce(source_id, 'none') AS source_id, coalesce(s.name, '综合来源') AS source_name, coalesce(title, '') AS title, coalesce(url, '') AS url,
    coalesce(s.trust, {lexicon.DEFAULT_TRUST}) AS trust, greatest(1, coalesce(crawl_count, 1)) AS count, CASE WHEN best_rank > 0 THEN best_rank END AS best_rank,
    {_clock('crawl_date', 'first_time')} AS first_at, {_clock('crawl_date', 'last_time')} AS last_at
  FROM latest LEFT JOIN src s ON s.id = source_id),
items AS (
  SELECT *, round({lexicon.DEFAULT_WEIGHT} + {_rank('best_rank', '56.0')} + least(18.0, ln(1 + count) * 5) + trust / 10 + ({_important('title')} - {_water('title')} * 0.8 - CASE WHEN {_digest('title')} THEN 20 ELSE 0 END), 4) AS score,
    {_key('title')} AS title_key
  FROM raw)"""
_SHOWN = f"(score + trust / 18 - CASE WHEN {_digest('title')} THEN 28 ELSE 0 END - {_water('title')})"
_EVENT_ITEMS = f"{_ITEMS}, ei AS (SELECT * FROM (SELECT *, coalesce({_topic('title')}, title_key) AS event_key FROM items WHERE title <> '') WHERE event_key <> '')"
_ROLL = f"""{_EVENT_ITEMS},
shown AS (SELECT *, {_SHOWN} AS d, {_water('title')} AS w FROM ei),
best AS (SELECT event_key, title, url FROM shown QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY d DESC, item_id) = 1),
agg AS (SELECT event_key, count(*) AS items, count(DISTINCT source_id) AS sources, count(DISTINCT kind) AS kinds, count(DISTINCT date) AS dates, max(date) AS last_date, min(first_at) AS first_at,
    max(last_at) AS last_at, min(best_rank) AS best_rank, CAST(sum(greatest(1, count)) AS BIGINT) AS occurrences, max(score) AS max_score, CAST(trunc(avg(trust)) AS INTEGER) AS mean_trust, max(w) AS water
  FROM shown GROUP BY 1),
roll AS (SELECT event_key, items, title, url, sources, kinds, dates, last_date, first_at, last_at, best_rank, occurrences, max_score, mean_trust, water FROM agg JOIN best USING (event_key))"""
_BONUS = "least(22, sources * 5 + kinds * 4)"
_DIMS = f"""{_ROLL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY score DESC, item_id) AS k FROM ei),
txt AS (SELECT event_key, string_agg(title, ' ' ORDER BY k) AS t FROM ranked WHERE k <= 12 GROUP BY 1),
dom AS (SELECT event_key, bool_or({_hits('title', lexicon.DOMAIN_TERMS['finance'])} > 0) AS fin, bool_or({_hits('title', lexicon.DOMAIN_TERMS['policy'])} > 0) AS pol FROM ei GROUP BY 1),
dims AS (SELECT r.*,
    least(100, 24 + {_important('t')} + {_BONUS} + CASE WHEN coalesce(best_rank, 99) <= 3 THEN 18 WHEN coalesce(best_rank, 99) <= 10 THEN 12 WHEN coalesce(best_rank, 99) <= 30 THEN 5 ELSE 0 END) AS impact,
    least(100, mean_trust + {_BONUS}) AS credibility,
    least(100, 26 + {_hits('t', lexicon.NOVELTY)} * 9 + {_hits('t', lexicon.CONTRAST)} * 8 + CASE WHEN last_date = CAST(last_at AS DATE) THEN 10 ELSE 0 END) AS novelty,
    least(100, 18 + {_hits('t', lexicon.FOLLOW_UP)} * 6 + least(18, dates * 6) + CASE WHEN {_topic('title')} IS NOT NULL THEN 18 ELSE 0 END) AS follow_up,
    least(100, 20 + {_hits('t', lexicon.PROXIMITY)} * 8 + CASE WHEN fin THEN 12 ELSE 0 END + CASE WHEN pol THEN 10 ELSE 0 END) AS proximity
  FROM roll r JOIN txt USING (event_key) JOIN dom USING (event_key)),
ev AS (SELECT *, round(max_score + least(26, (sources - 1) * 9 + (kinds - 1) * 5) + least(26.0, ln(1 + occurrences) * 5 + dates * 5)
    + (impact * 0.28 + credibility * 0.18 + novelty * 0.16 + follow_up * 0.24 + proximity * 0.14) * 0.72 - water * 1.7, 1) AS score FROM dims)"""
_NEWS = f"""
n AS (SELECT * FROM news_items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
news AS (SELECT n.id, crawl_date AS date, coalesce(p.name, '综合来源') AS source_name, {_clean('title')} AS title, CASE WHEN rank > 0 THEN rank END AS rank,
    {_clock('crawl_date', 'first_crawl_time')} AS first_at, {_clock('crawl_date', 'last_crawl_time')} AS last_at, greatest(1, coalesce(crawl_count, 1)) AS count
  FROM n LEFT JOIN platforms p ON p.id = n.platform_id)"""
_FEED = "f AS (SELECT * FROM feed_entries WHERE entry_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY received_at DESC) = 1)"
_HISTORY = """
p AS (SELECT user_id, ts AS time, value FROM events WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, value) QUALIFY lag(ts) OVER w IS NULL OR lag(ts) OVER w <> ts OR lag(value) OVER w <> value),
h AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY time DESC, value DESC) <= 80),
q AS (SELECT user_id, time, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY time, value) AS INTEGER) AS pos FROM h)"""


def _esc(c: str) -> str:
    out = f"replace({c}, '&', '&amp;')"
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {_q(char)}, {_q(name)})"
    return out


_PAGES = f"""{_FEED},
pg AS (SELECT source, batch_no, '<html><body><div>' || string_agg('<div class="row"><a href="' || url || '">' || {_esc('title')} || '</a></div>', chr(10) ORDER BY entry_id) || '</div></body></html>' AS html,
    list_sort(list_distinct(list(url))) AS urls FROM f WHERE source IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2)"""
_PATCHED = "replace(html, '</body>', '<!-- global-nav --><nav>home</nav></body>')"
_SHORT = _trim(f"regexp_replace({_trim(chr(114) + 'egexp_replace(coalesce(summary, ' + _q('') + '), ' + _q(_S + '+') + ', ' + _q(' ') + ', ' + _q('g') + ')')}, '（来源：.*?）', '', 'g')")

SQL: dict[str, str] = {
    "hotlist_scan": f"""WITH r AS (SELECT l_orderkey, min(l_linenumber) AS best_rank, max(l_linenumber) AS worst_rank, count(l_linenumber) AS points FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderpriority AS title, coalesce(c_name, 'unknown') AS source_name, best_rank, worst_rank, coalesce(points, 0) AS points,
  round({_rank('best_rank', '68.0')} + {lexicon.DEFAULT_WEIGHT} + least(28.0, ln(1 + greatest(1, coalesce(points, 0))) * 8), 4) AS score
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN r ON l_orderkey = o_orderkey""",
    "news_scan": f"WITH {_NEWS} SELECT * FROM news",
    "feed_scan": f"""WITH {_FEED}, s AS (SELECT entry_id, coalesce(r.name, '综合来源') AS source_name, {_clean('title')} AS title, {_SHORT} AS summary FROM f LEFT JOIN rss_feeds r ON r.id = f.source)
SELECT entry_id, source_name, title, CASE WHEN length(summary) > 30 THEN regexp_replace(substr(summary, 1, 30), {_q(_S + '+$')}, '') || '...' ELSE summary END AS summary FROM s""",
    "source_profiles": f"WITH {_ITEMS} SELECT item_id, source_id, source_name, trust FROM items",
    "recent_partitions": "SELECT crawl_date AS date FROM news_items WHERE crawl_date IS NOT NULL UNION SELECT crawl_date FROM scored_items WHERE crawl_date IS NOT NULL ORDER BY date DESC LIMIT 7",
    "all_partitions": "SELECT crawl_date AS date FROM news_items WHERE crawl_date IS NOT NULL UNION SELECT CAST(ts AS DATE) FROM events",
    "title_keys": f"WITH {_ITEMS} SELECT item_id, title_key, {_key('title', lexicon.FEED_NOISE)} AS feed_key, {_key('title', clean=False)} AS plain_key FROM items",
    "term_hits": f"WITH {_ITEMS}, h AS (SELECT item_id, [x FOR x IN [{', '.join(_q(t) for t in lexicon.DIGEST_IMPORTANT)}] IF contains(lower(title), lower(x))] AS l FROM items) SELECT item_id, array_to_string(l, ',') AS hits, CAST(len(l) AS INTEGER) AS n FROM h",
    "lexicon_scores": f"WITH {_ITEMS} SELECT item_id, {_important('title')} AS important, {_water('title')} AS water, least(20, 3 * {_hits('title', lexicon.DIGEST_IMPORTANT)}) AS terms, {_digest('title')} AS digest FROM items",
    "domains": f"WITH {_ITEMS}, d AS (SELECT item_id, {_domains('title')} AS l FROM items) SELECT item_id, CASE WHEN len(l) = 0 THEN 'general' ELSE array_to_string(l, ',') END AS domains FROM d",
    "category_scores": f"WITH {_ITEMS} SELECT item_id, {', '.join(f'{_points(chr(116) + chr(105) + chr(116) + chr(108) + chr(101), c)} AS {c}' for c in _CATS)}, {_category('title')} AS category FROM items",
    "topics_and_buckets": f"""WITH {_ITEMS}, b AS (SELECT item_id, {_topic('title')} AS topic, title_key, [x FOR x IN [{', '.join(_q(t.lower()) for t in lexicon.IMPORTANT)}] IF contains(lower(title), x)] AS hits, {_domains('title')} AS doms FROM items)
SELECT item_id, topic, coalesce(topic, title_key) AS key, CASE WHEN topic IS NOT NULL THEN 'topic:' || topic WHEN len(hits) > 0 THEN 'term:' || hits[1] WHEN len(doms) > 0 THEN 'domain:' || list_min(doms) ELSE 'domain:general' END AS bucket FROM b""",
    "item_scores": f"WITH {_ITEMS} SELECT item_id, score, round({_SHOWN}, 3) AS shown, round({_rank('best_rank', '68.0')} + {lexicon.DEFAULT_WEIGHT} + least(28.0, ln(1 + count) * 8), 4) AS digest_score FROM items",
    "candidate_items": f"""WITH {_ITEMS} SELECT item_id, score FROM items WHERE NOT (({_digest('title')} AND {_important('title')} < 20) OR ({_water('title')} >= 14 AND {_important('title')} < 8))
  AND (score >= 30 OR (coalesce(best_rank <= 12, false) AND {_water('title')} < 10) OR {_important('title')} >= 8)""",
    "crawl_times": f"WITH {_ITEMS} SELECT item_id, first_at, last_at FROM items",
    "mojibake_entries": f"SELECT DISTINCT entry_id FROM feed_entries WHERE len(regexp_extract_all(coalesce(title, ''), '[{lexicon.MOJIBAKE_SIGNS}]')) >= 4 OR len(regexp_extract_all(coalesce(summary, ''), '[{lexicon.MOJIBAKE_SIGNS}]')) >= 4",
    "url_dates": "SELECT DISTINCT entry_id, CAST(try_strptime(regexp_extract(url, '/(20\\d{6})/', 1), '%Y%m%d') AS DATE) AS date, true AS known FROM feed_entries WHERE try_strptime(regexp_extract(url, '/(20\\d{6})/', 1), '%Y%m%d') IS NOT NULL AND contains(url, '.example/')",
    "escaped_titles": f"WITH {_ITEMS} SELECT item_id, {_esc('title')} AS escaped FROM items",
    "exact_events": f"WITH {_ROLL} SELECT * FROM roll",
    "event_scores": f"WITH {_DIMS} SELECT event_key, CAST(impact AS INTEGER) AS impact, CAST(credibility AS INTEGER) AS credibility, novelty, CAST(follow_up AS INTEGER) AS follow_up, proximity, score FROM ev",
    "event_categories": f"""WITH {_ROLL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY score DESC, item_id) AS k FROM ei QUALIFY k <= 16),
once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY event_key, title_key ORDER BY k) = 1),
sums AS (SELECT event_key, {', '.join(f'round(sum({_points(chr(116) + chr(105) + chr(116) + chr(108) + chr(101), c)} * (1.0 + least(2.2, greatest(0.0, score / 60)))), 6) AS s_{c}' for c in _CATS)} FROM once GROUP BY 1)
SELECT event_key, CASE WHEN greatest({', '.join(_points('title', c) for c in _CATS)}) >= 28 THEN {_category('title')} ELSE {_best({c: f's_{c}' for c in _CATS})} END AS category FROM roll JOIN sums USING (event_key)""",
    "event_trends": f"""WITH {_EVENT_ITEMS}, d AS (SELECT event_key, date, CAST(sum(count) AS BIGINT) AS n FROM ei GROUP BY 1, 2),
l AS (SELECT *, lag(date) OVER w AS prev_date, lag(n) OVER w AS prev_n FROM d WINDOW w AS (PARTITION BY event_key ORDER BY date))
SELECT event_key, date, n, CAST(prev_date AS VARCHAR) AS prev_date, prev_n, coalesce(n > prev_n, false) AS rising FROM l QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY date DESC) = 1""",
    "representative_items": f"""WITH {_EVENT_ITEMS}, o AS (SELECT * FROM ei QUALIFY row_number() OVER (PARTITION BY event_key, title_key ORDER BY last_at DESC, score DESC, item_id) = 1)
SELECT event_key, CAST(row_number() OVER (PARTITION BY event_key ORDER BY last_at DESC, score DESC, item_id) AS INTEGER) AS pos, item_id FROM o QUALIFY pos <= 8""",
    "top_events": f"WITH {_DIMS} SELECT last_date, CAST(row_number() OVER (PARTITION BY last_date ORDER BY score DESC, event_key) AS INTEGER) AS pos, event_key, score, pos <= 10 AS must FROM ev QUALIFY pos <= 50",
    "tracks": f"WITH {_ROLL} SELECT {_topic('title', _TABLE_TRACKS)} AS topic, event_key, last_at FROM roll WHERE {_topic('title', _TABLE_TRACKS)} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic ORDER BY last_at DESC, max_score DESC, event_key) = 1",
    "category_rollup": """WITH e AS (SELECT * FROM trend_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY last_seen_at DESC NULLS LAST, CASE WHEN score IS NULL OR isnan(score) THEN -1e300 ELSE score END DESC) = 1),
c AS (SELECT coalesce(category, 'none') AS category, source_count, CASE WHEN NOT isnan(score) THEN score END AS score FROM e)
SELECT category, count(*) AS n, CAST(sum(source_count) AS BIGINT) AS sources, max(score) AS best FROM c GROUP BY 1 UNION ALL SELECT 'all', count(*), CAST(sum(source_count) AS BIGINT), max(score) FROM c""",
    "category_counts": f"SELECT g.category, count(e.category) AS n FROM (SELECT unnest([{', '.join(_q(c) for c in lexicon.CATEGORIES)}]) AS category) g LEFT JOIN trend_events e ON e.category = g.category GROUP BY 1",
    "source_rollup": f"""WITH {_NEWS} SELECT source_name, count(*) AS n, count(*) FILTER (rank <= 5) AS high, min(first_at) AS first_at, max(last_at) AS last_at FROM news GROUP BY 1
UNION ALL SELECT 'all', count(*), count(*) FILTER (rank <= 5), min(first_at), max(last_at) FROM news""",
    "top_sources": f"WITH {_ITEMS} SELECT source_id, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, source_id LIMIT 16",
    "source_hotlists": f"WITH {_ITEMS} SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, count DESC, last_at DESC, item_id) AS INTEGER) AS pos, item_id, score FROM items WHERE date = (SELECT max(date) FROM items) QUALIFY pos <= 20",
    "summary_cells": f"WITH {_EVENT_ITEMS} SELECT count(DISTINCT event_key) AS events, count(*) AS items, count(DISTINCT source_id) AS sources, count(DISTINCT {_category('title')}) AS categories FROM ei",
    "archive": f"WITH {_ITEMS}, r AS (SELECT date, title, row_number() OVER (PARTITION BY date ORDER BY score DESC, item_id) AS k, count(*) OVER (PARTITION BY date) AS c FROM items) SELECT date, title, least(c, 50) AS n FROM r WHERE k = 1",
    "month_groups": f"WITH {_ITEMS}, d AS (SELECT date, count(*) AS n, strftime(date, '%Y-%m') AS month FROM items GROUP BY date) SELECT date, n, month, lag(month) OVER (ORDER BY date) IS DISTINCT FROM month AS starts FROM d",
    "quote_history": f"WITH {_HISTORY} SELECT * FROM q",
    "quote_changes": f"""WITH {_HISTORY}, c AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY time, value) AS prev FROM q)
SELECT user_id, pos, round(value - prev, 4) AS change, round((value - prev) / nullif(prev, 0.0) * 100, 3) AS percent FROM c""",
    "stale_values": """WITH now AS (SELECT user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
old AS (SELECT user_id, value FROM events WHERE ts < TIMESTAMP '2024-01-29' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, coalesce(now.value, old.value) AS value, now.value IS NULL AS stale FROM now FULL JOIN old USING (user_id) WHERE coalesce(now.value, old.value) IS NOT NULL""",
    "sparklines": f"""WITH {_HISTORY}, b AS (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM q WINDOW w AS (PARTITION BY user_id))
SELECT user_id, pos, round(CASE WHEN n < 2 THEN 0.0 ELSE (pos - 1) * 152.0 / (n - 1) END, 4) AS x, round((value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 4) AS y FROM b""",
    "quote_stream": f"WITH {_HISTORY} SELECT * FROM q",
    "section_dedupe": f"WITH {_PAGES} SELECT source, batch_no, CAST(len(urls) AS INTEGER) AS n FROM pg QUALIFY row_number() OVER (PARTITION BY source, urls ORDER BY batch_no) = 1",
    "page_patch": f"WITH {_PAGES} SELECT source, batch_no, md5({_PATCHED}) AS md5, true AS changed, false AS changed_again FROM pg",
    "html_links": f"""WITH {_FEED}, l AS (SELECT concat_ws('/', source, batch_no) AS page, url, {_clean(_esc('title').replace("'&#x27;'", "'&#39;'"))} AS title FROM f WHERE source IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL)
SELECT page, url, title FROM l WHERE length(title) >= 6 AND len(regexp_extract_all(title, '[{lexicon.MOJIBAKE_SIGNS}]')) < 4 AND NOT starts_with(url, 'javascript')""",
    "div_depths": f"""WITH {_PAGES}, t AS (SELECT concat_ws('/', source, batch_no) AS page, regexp_extract_all(html, '(?i)<(/?)div\\b', 1) AS l FROM pg),
u AS (SELECT page, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM t)
SELECT page, CAST(pos AS INTEGER) AS pos, CAST(sum(CASE WHEN c = '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS depth FROM u""",
    "rss_export": f"""WITH {_FEED} SELECT entry_id, md5('<item><title>' || {_esc('title')} || '</title><link>' || {_esc("coalesce(url, '')")} || '</link><source>' || {_esc("coalesce(source, '')")} || '</source><description>'
  || {_esc("CASE WHEN coalesce(summary, '') = '' THEN title ELSE summary END")} || '</description><pubDate>' || strftime(received_at, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>') AS md5 FROM f WHERE title IS NOT NULL""",
    "round_robin": f"""WITH RECURSIVE e AS (SELECT source, entry_id AS item_id, {_key('title', lexicon.FEED_NOISE)} AS key FROM feed_entries WHERE source IS NOT NULL),
o AS (SELECT source, key, min(item_id) AS item_id FROM e WHERE key <> '' GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_id) AS k FROM o QUALIFY k <= 120),
names AS (SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM c)),
walk AS (
  SELECT 0 AS turn, 0 AS pos, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS item_id, CAST([] AS VARCHAR[]) AS seen
  UNION ALL
  SELECT turn + 1, CASE WHEN nx IS NULL THEN pos ELSE pos + 1 END, src, nx.item_id, CASE WHEN nx IS NULL THEN seen ELSE list_append(seen, nx.key) END
  FROM (SELECT w.turn, w.pos, w.seen, s.source AS src,
      (SELECT min(struct_pack(item_id := c.item_id, key := c.key)) FROM c WHERE c.source = s.source AND NOT list_contains(w.seen, c.key)) AS nx
    FROM walk w JOIN names s ON s.i = w.turn % s.n + 1 WHERE w.pos < 120 AND w.turn < 120 * s.n))
SELECT pos, source, item_id, seen[pos] AS key FROM walk WHERE item_id IS NOT NULL""",
}


def _terms(c: str) -> str:
    return f"least(20, 3 * {_hits(c, lexicon.DIGEST_IMPORTANT)})"


def _shown_state(up: str, days: str, sources: str) -> str:
    a, b, c, d = lexicon.TREND_STATES
    return f"CASE WHEN {up} THEN '{a}' WHEN {days} >= 3 THEN '{b}' WHEN {sources} >= 3 THEN '{c}' ELSE '{d}' END"


_PROFILES = "prof AS (SELECT id AS source_id, tier, type, weight, trust, hint, dw FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM platforms) JOIN (VALUES " + ", ".join(
    f"({i}, '{tier}', '{kind}', {weight}, {trust}, {_q(lexicon.SOURCE_HINTS[n]) if n in lexicon.SOURCE_HINTS else 'NULL'}, {lexicon.SOURCE_WEIGHTS[n]})" for i, (n, (tier, kind, weight, trust)) in enumerate(lexicon.SOURCE_PROFILES.items())
) + ") v(k, tier, type, weight, trust, hint, dw) USING (k))"
_SUMMARY = _trim(f"regexp_replace(coalesce(summary, ''), {_q(_S + '+')}, ' ', 'g')")
_DIGEST = f"""{_ITEMS}, {_PROFILES},
di AS (SELECT item_id, i.date, i.kind, i.source_id, i.source_name, i.title, i.url, {_SUMMARY} AS whole, i.count, i.best_rank,
    round(CAST(CASE WHEN i.kind = 'rss' THEN 20 + coalesce(dw, 8) + CASE WHEN contains(coalesce(published_at, ''), CAST(i.date AS VARCHAR)) THEN 8 ELSE 0 END + {_terms('i.title')}
      ELSE {_rank('i.best_rank', '68.0')} + coalesce(dw, 8) + least(28.0, ln(1 + i.count) * 8) END AS DOUBLE), 4) AS score
  FROM items i JOIN latest l USING (item_id) LEFT JOIN prof p ON p.source_id = i.source_id),
dg AS (SELECT * EXCLUDE (whole), CASE WHEN length(whole) > 180 THEN regexp_replace(substr(whole, 1, 180), {_q(_S + '+$')}, '') || '...' ELSE whole END AS summary FROM di)"""
_TITLE = "title"

SQL |= {
    "profiled_items": f"""WITH {_ITEMS}, {_PROFILES}, j AS (SELECT i.item_id, i.title, i.count, i.best_rank, coalesce(p.tier, '{lexicon.DEFAULT_TIER}') AS tier, coalesce(p.type, '{lexicon.DEFAULT_TYPE}') AS type,
    coalesce(p.weight, {lexicon.DEFAULT_WEIGHT}) AS weight, coalesce(p.trust, {lexicon.DEFAULT_TRUST}) AS trust FROM items i LEFT JOIN prof p USING (source_id))
SELECT item_id, tier, type, weight, trust, round(weight + {_rank('best_rank', '56.0')} + least(18.0, ln(1 + count) * 5) + trust / 10 + ({_important('title')} - {_water('title')} * 0.8 - CASE WHEN {_digest('title')} THEN 20 ELSE 0 END), 4) AS score FROM j""",
    "category_votes": f"""WITH {_ROLL}, {_PROFILES},
ranked AS (SELECT ei.*, p.hint, row_number() OVER (PARTITION BY event_key ORDER BY score DESC, item_id) AS k FROM ei LEFT JOIN prof p USING (source_id) QUALIFY k <= 16),
once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY event_key, title_key ORDER BY k) = 1),
sums AS (SELECT event_key, {', '.join(f'round(sum({_points(_TITLE, c)} * (1.0 + least(2.2, greatest(0.0, score / 60)))), 6) AS s_{c}, count(*) FILTER (hint = {_q(c)}) AS h_{c}' for c in _CATS)} FROM once GROUP BY 1),
c AS (SELECT event_key, CASE WHEN greatest({', '.join(_points('title', c) for c in _CATS)}) >= 28 THEN {_category('title')} WHEN greatest({', '.join(f's_{c}' for c in _CATS)}) > 0 THEN {_best({c: f's_{c}' for c in _CATS})}
  ELSE {_best({c: f'h_{c}' for c in _CATS})} END AS category FROM roll JOIN sums USING (event_key))
SELECT event_key, category, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.CATEGORY_LABELS.items())} END AS label FROM c""",
    "feed_scores": f"WITH {_DIGEST} SELECT item_id, kind, score, summary FROM dg",
    "digest_clusters": f"""WITH {_DIGEST}, k AS (SELECT *, concat_ws('|', CAST(date AS VARCHAR), {_key('title', clean=False)}) AS cluster FROM dg WHERE title <> ''),
t AS (SELECT *, max(score) OVER (PARTITION BY cluster) AS top FROM k),
best AS (SELECT cluster, title FROM t WHERE score = top QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY item_id DESC) = 1),
named AS (SELECT cluster, source_id, min(struct_pack(s := -score, i := item_id)) AS o, arg_max(source_name, struct_pack(s := -score, i := item_id)) AS source_name FROM k GROUP BY 1, 2),
lab AS (SELECT cluster, count(*) AS sources, string_agg(source_name, ' / ' ORDER BY o) AS source_label FROM named GROUP BY 1),
agg AS (SELECT cluster, count(*) AS items, CAST(sum(count) AS BIGINT) AS count, max(score) AS score, min(best_rank) AS b, max(best_rank) AS w FROM k GROUP BY 1)
SELECT cluster, items, count, score, title, sources, source_label, CASE WHEN b IS NULL THEN 'RSS' WHEN b = w THEN CAST(b AS VARCHAR) ELSE b || '-' || w END AS rank_label,
  round(score + (sources - 1) * 16 + least(24.0, ln(1 + count) * 7) + {_terms('title')}, 4) AS final_score FROM agg JOIN best USING (cluster) JOIN lab USING (cluster)""",
    "trend_states": f"""WITH {_EVENT_ITEMS}, d AS (SELECT event_key, date, sum(count) AS n FROM ei GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER (PARTITION BY event_key ORDER BY date) AS p, count(*) OVER (PARTITION BY event_key) AS days FROM d QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY date DESC) = 1),
s AS (SELECT event_key, count(DISTINCT source_id) AS sources FROM ei GROUP BY 1)
SELECT event_key, {_shown_state('n > p', 'days', 'sources')} AS state FROM l JOIN s USING (event_key)""",
    "source_previews": f"""WITH {_EVENT_ITEMS}, n AS (SELECT event_key, list_sort(list(DISTINCT source_name)) AS l FROM ei GROUP BY 1)
SELECT event_key, array_to_string(l[1:4], '、') || CASE WHEN len(l) > 4 THEN '等' ELSE '' END AS preview FROM n""",
    "category_ranks": """WITH e AS (SELECT event_id, category, CASE WHEN score IS NULL OR isnan(score) THEN -1e300 ELSE score END AS s FROM trend_events WHERE event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY last_seen_at DESC NULLS LAST, CASE WHEN score IS NULL OR isnan(score) THEN -1e300 ELSE score END DESC) = 1),
c AS (SELECT * FROM e WHERE category IS NOT NULL), r AS (SELECT category, event_id, s FROM c WHERE category <> 'general' UNION ALL SELECT 'all', event_id, s FROM c)
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY s DESC, event_id) AS INTEGER) AS pos, event_id FROM r QUALIFY pos <= 50""",
    "month_counts": f"WITH {_ITEMS}, d AS (SELECT DISTINCT date FROM items WHERE date IS NOT NULL) SELECT date, strftime(date, '%Y年%m月') AS month, count(*) OVER (PARTITION BY strftime(date, '%Y年%m月')) AS n, strftime(date, '%m月%d日') AS day FROM d",
    "archive_titles": f"""WITH {_ROLL}, b AS (SELECT last_date, title FROM roll WHERE items > 1 QUALIFY row_number() OVER (PARTITION BY last_date ORDER BY max_score DESC, event_key) = 1),
d AS (SELECT crawl_date AS date FROM news_items WHERE crawl_date IS NOT NULL UNION SELECT crawl_date FROM scored_items WHERE crawl_date IS NOT NULL)
SELECT date, coalesce(title, '暂无数据') AS title FROM d LEFT JOIN b ON b.last_date = d.date""",
    "iso_times": f"""WITH r AS (SELECT *, regexp_replace(published_at, '(?:Z|[+-]\\d{{2}}:?\\d{{2}})$', '') AS p FROM scored_items WHERE item_id IS NOT NULL)
SELECT DISTINCT item_id, coalesce(CASE WHEN regexp_matches(p, '^\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[T ]\\d{{2}}:\\d{{2}}(?::\\d{{2}}(?:\\.\\d{{1,6}})?)?)?$') THEN try_cast(CASE WHEN regexp_matches(p, '[T ]\\d{{2}}:\\d{{2}}$') THEN p || ':00' ELSE p END AS TIMESTAMP) END, {_clock('crawl_date', 'first_time')}) AS at FROM r""",
    "zone_days": f"""WITH {_FEED} SELECT CAST((received_at AT TIME ZONE 'UTC') AT TIME ZONE coalesce(r.tz, 'Asia/Shanghai') AS DATE) AS day, count(*) AS n FROM f LEFT JOIN rss_feeds r ON r.id = f.source GROUP BY 1""",
    "change_labels": f"""WITH {_HISTORY}, c AS (SELECT user_id, pos, round(round(value - lag(value) OVER (PARTITION BY user_id ORDER BY time, value), 4), 4) AS c FROM q)
SELECT user_id, pos, CASE WHEN c > 0.0001 THEN 'up' WHEN c < -0.0001 THEN 'down' ELSE 'flat' END AS class,
  coalesce(CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '' END || format('{{:,.2f}}', abs(c)), '-') AS label FROM c""",
    "quotes": """WITH e AS (SELECT event_id, value AS v, event_id % 7 AS m, strftime(ts, '%Y%m%d%H%M%S') AS t FROM events),
r AS (SELECT *, m < 3 AS stock, m IN (3, 4) AS world FROM e)
SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN stock THEN 'n' || event_id WHEN world THEN 'g' || event_id END AS name, CASE WHEN stock OR world THEN v END AS price,
  CASE WHEN v IS NULL THEN NULL WHEN stock THEN CASE WHEN m = 0 THEN 0.0 ELSE 40.0 END WHEN world THEN 50.0 END AS before,
  round(CASE WHEN stock THEN v - CASE WHEN m = 0 THEN 0.0 ELSE 40.0 END WHEN world THEN v - 50.0 END, 4) AS change,
  round(CASE WHEN v IS NULL THEN NULL WHEN stock THEN CASE WHEN m > 0 THEN (v - 40.0) / 40.0 * 100 END WHEN world THEN CASE WHEN event_id IS NOT NULL THEN (v - 50.0) / 50.0 * 100 END END, 4) AS percent,
  CASE WHEN v IS NULL THEN NULL WHEN stock THEN t WHEN world THEN '2024-01-05 12:00:00' END AS time, CASE WHEN v IS NULL THEN NULL WHEN stock THEN v WHEN world THEN 9.5 END AS high,
  CASE WHEN m = 6 THEN 'unknown type' WHEN m = 5 THEN 'short payload' WHEN v IS NULL THEN 'no price' END AS error FROM r""",
}
