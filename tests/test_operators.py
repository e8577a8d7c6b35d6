import random
from datetime import date, datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from newsloom.operators import cluster, history, merge, pages, rollup, scan


@pytest.mark.parametrize(
    ("a", "b", "least", "want"),
    [
        ("abc", "abc", 0.76, True), ("abcdefgh", "abcdefghZZZZZZ", 0.76, True), ("abcdefg", "abcdefgZZZZZZ", 0.76, False),
        ("abcdefghijklm", "abcdefghij123", 0.76, True), ("abcdefghijklm", "abcdefghij123", 0.78, False), ("", "", 0.76, False),
    ],
)
def test_similar(a, b, least, want):
    assert cluster.similar(a, b, least) is want


def _greedy(rows, least, topics):
    out, open_ = {}, {}
    for b, i, k, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        for c in open_.setdefault(b, []):
            if (k == c[0] and (k or topics)) or (k not in topics and c[0] not in topics and cluster.similar(k, c[0], least)):
                out[i] = c[1]
                if len(k) > len(c[0]) and k not in topics:
                    c[0] = k
                break
        else:
            open_[b].append([k, i])
            out[i] = i
    return out


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("topics", [(), ("gold-trend",)])
def test_greedy_clusters_like_the_plain_walk(spark, partitions, topics):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((4, 9, 14, 20)))) for _ in range(25)]
    rows = []
    for i in range(600):
        k = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            k[rng.randrange(len(k)) : rng.randrange(len(k))] = rng.choice("abcdefghxyz")
        key = rng.choice(["", "gold-trend"]) if rng.random() < 0.05 else "".join(k)
        rows.append((f"b{rng.randrange(3)}", i, key, float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "bucket string, item_id long, key string, score double").repartition(partitions)
    got = {r.item_id: r.event_id for r in cluster.greedy_clusters(df, 0.76, topics).collect()}
    assert got == _greedy(rows, 0.76, topics)


def test_ratio_bound_is_lossless():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcde中文") for _ in range(rng.randrange(10, 40))) for _ in range(2))
        both = sum(min(x, y) for x, y in zip(cluster._counts(a).tolist(), cluster._counts(b).tolist()))
        assert SequenceMatcher(None, a, b).ratio() <= 2 * both / (len(a) + len(b)) + 1e-9


def _interleave(rows, order, limit):
    queues = {}
    for s, i, k in sorted(rows, key=lambda r: r[1]):
        queues.setdefault(s, []).append((i, k))
    names = [s for s in order if s in queues] + sorted(s for s in queues if s not in order)
    seen, out = set(), []
    while any(queues.values()) and len(out) < limit:
        for s in names:
            while queues[s]:
                i, k = queues[s].pop(0)
                if k and k not in seen:
                    seen.add(k)
                    out.append((len(out) + 1, s, i, k))
                    break
            if len(out) >= limit:
                break
    return out


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_round_robin(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("ABCD"), i, rng.choice(["", None, *map(str, range(60))])) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, item_id long, key string")
    got = [tuple(r) for r in merge.round_robin(df, ["C", "A"], limit).orderBy("pos").collect()]
    assert got == _interleave(rows, ["C", "A"], limit)


def test_round_robin_skips(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 2, "y"), ("A", 3, "z"), ("B", 4, "x"), ("B", 5, "w"), ("C", 6, "y"), ("C", 7, "v")], "source string, item_id long, key string")
    assert [r.key for r in merge.round_robin(df, ["A", "B", "C"], 10).orderBy("pos").collect()] == ["x", "w", "y", "z", "v"]


def test_history(spark):
    t = [datetime(2026, 1, 1) + timedelta(minutes=i) for i in range(200)]
    rows = [("a", t[1], 5.0), ("a", t[1], 5.0), ("a", t[2], 5.0), ("a", t[3], None), ("a", t[4], 6.0)] + [("b", t[i], float(i)) for i in range(100)] + [("c", t[0], None)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    got = history.last_points(df, "k", "t", "v").orderBy("k", "pos").collect()
    assert [(r.time, r.value) for r in got if r.k == "a"] == [(t[1], 5.0), (t[2], 5.0), (t[4], 6.0)]
    assert [r.value for r in got if r.k == "b"] == [float(i) for i in range(20, 100)]


def test_stale(spark):
    now, old = (spark.createDataFrame(r, "k string, value double") for r in ([("a", 1.0), ("b", None)], [("b", 2.0), ("c", None)]))
    assert {tuple(r) for r in history.or_stale(now, old, "k").collect()} == {("a", 1.0, False), ("b", 2.0, True)}


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (None, 3, "d")], "id long, t int, v string")
    assert {tuple(r) for r in scan.latest_rows(df, "id", [F.col("t")]).collect()} == {(1, 2, "b"), (2, None, "c")}
    assert scan.latest_rows(df.limit(0), "id", [F.col("t")]).count() == 0


def test_ranks_and_partitions(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    ranks = spark.createDataFrame([(1, 3), (1, 1), (9, 9)], "item long, rank int")
    assert {(r.id, r.best_rank, r.worst_rank, r.points) for r in scan.with_ranks(items, "id", ranks, "item", "rank").collect()} == {(1, 1, 3, 2), (2, None, None, 0)}
    days = spark.createDataFrame([(date(2026, 1, d),) for d in (1, 5, 9)] + [(None,)], "d date")
    assert [r.date.day for r in scan.recent_partitions([(days, "d"), (days, "d")], 2).collect()] == [9, 5]


def test_rollups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "g string, n int")
    assert {tuple(r) for r in rollup.with_total(df, "g", {"s": F.sum("n")}).collect()} == {("a", 3), ("none", 3), ("all", 6)}


def test_pages(spark):
    html = '<html><body><div><a href="u1">First title</a><a href="javascript:x">Second title</a><div></div></div><a href="u2"><b>Third</b> title</a></body></html>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id long, html string")
    assert [(r.url, r.title) for r in pages.links(df, "id", "html").orderBy("pos").collect()] == [("u1", "First title"), ("u2", "Third title")]
    assert [r.depth for r in pages.div_depths(df, "id", "html").orderBy("id", "pos").collect()] == [1, 2, 1, 0]
    once, changed = pages.patched(F.col("html"), "<!-- m -->", "<nav/>")
    first = df.select("id", once.alias("html"), changed.alias("c")).orderBy("id")
    again, second = pages.patched(F.col("html"), "<!-- m -->", "<nav/>")
    assert [r.c for r in first.collect()] == [True, False, False]
    assert first.select(second.alias("s")).filter("s").count() == 0
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b"]), (1, 3, []), (1, 4, [])], "p int, k int, u array<string>")
    assert [r.k for r in pages.first_sections(rows, "p", "k", "u").orderBy("k").collect()] == [1, 3, 4]
