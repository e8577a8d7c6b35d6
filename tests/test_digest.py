"""The digest's roll-up and ranks, trend states, quotes."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import lexicon
from newsloom.functions import text as T
from newsloom.operators import digest
from newsloom.sources.quotes import parsed

T0 = datetime(2026, 1, 1)
SCHEMA = "cluster string, item_id long, title string, url string, summary string, source_id string, source_name string, count int, score double, first_at timestamp_ntz, last_at timestamp_ntz, best_rank int"


def _walk(rows):
    """Clusters grown item by item."""
    out = {}
    for r in sorted(rows, key=lambda r: (-r[8], r[1])):
        c = out.setdefault(r[0], {"title": "", "url": "", "summary": "", "sources": {}, "count": 0, "score": -math.inf, "ranks": [], "items": 0})
        c["items"] += 1
        c["count"] += r[7]
        c["sources"].setdefault(r[5], r[6])
        c["score"] = max(c["score"], r[8])
        c["ranks"] += [r[11]] if r[11] is not None else []
        if r[8] >= c["score"]:
            c["title"], c["url"], c["summary"] = r[2], r[3] or c["url"], r[4] or c["summary"]
    return out


def test_rollup_like_a_walk(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice("abcdefgh"), i, rng.choice(["央行通报", "芯片", "x", "AI 关税"]), rng.choice([None, "", "u1", "u2"]), rng.choice([None, "", "s1"]), s := rng.choice("mnop"), s.upper(), rng.randrange(1, 9), float(rng.randrange(3)), T0 + timedelta(hours=i % 7), T0 + timedelta(hours=i % 11), rng.choice([None, 1, 5, 30]))
        for i in range(300)
    ]
    got = {r.cluster: r for r in digest.cluster_rollup(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))).collect()}
    want = _walk(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.title, g.url, g.summary, g["count"], g.score, g["items"], g.sources) == (w["title"], w["url"], w["summary"], w["count"], w["score"], w["items"], len(w["sources"]))
        assert g.source_label == " / ".join(w["sources"].values()) and (g.best_rank, g.worst_rank) == (min(w["ranks"]), max(w["ranks"]))
        terms = min(20, 3 * sum(t.lower() in w["title"].lower() for t in lexicon.DIGEST_IMPORTANT))
        assert g.final_score == pytest.approx(w["score"] + 16 * (len(w["sources"]) - 1) + min(24, 7 * math.log1p(w["count"])) + terms)
    assert digest.cluster_rollup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_final_score_of_the_fixture(spark):
    row = spark.range(1).select(digest.final_score(F.lit(50.0), F.lit(3), F.lit(8), F.lit("央行与AI")).alias("s")).first()
    assert row.s == pytest.approx(103.380572, abs=1e-6)


def test_states_and_labels(spark):
    up, lasting, spread, new = lexicon.TREND_STATES
    days = {"up": [("d1", 2), ("d2", 3)], "down": [("d1", 3), ("d2", 2)], "three": [("d1", 1), ("d2", 1), ("d3", 1)], "wide": [("d1", 1)] * 3, "null": [("d1", None)]}
    rows = [(k, d, c, f"s{i}") for k, v in days.items() for i, (d, c) in enumerate(v)]
    got = {r.event_key: r.state for r in digest.trend_states(spark.createDataFrame(rows, "event_key string, date string, count int, source_id string")).collect()}
    assert got == {"up": up, "down": new, "three": lasting, "wide": spread, "null": new}
    ranks = spark.createDataFrame([(None, None), (3, 3), (1, 9)], "b int, w int").select(digest.rank_label(F.col("b"), F.col("w")).alias("l")).collect()
    assert [r.l for r in ranks] == ["RSS", "3", "1-9"]
    times = spark.createDataFrame([("2026-05-19T08:00:00Z",), ("2026-05-19T08:00:00+08:00",), ("bad",), (None,), ("2026-13-19T08:00",)], "v string")
    at = [r.t for r in times.select(T.iso_time(F.col("v"), F.lit("2026-05-19").cast("date"), F.lit("09:15")).alias("t")).collect()]
    assert at == [datetime(2026, 5, 19, 8)] * 2 + [datetime(2026, 5, 19, 9, 15)] * 3


def test_quotes_that_can_not_be_read(spark):
    stock = "~".join(["1", "n", "c", "11", "10"] + ["0"] * 26 + ["", "", "12", "9"])
    rows = [("tencent_stock", f'v_a="{stock}";'), ("tencent_stock", 'v_a="1~2";'), ("tencent_stock", None), ("gold", "x"), (None, "x"), ("tencent_global", ",".join(["nan"] + ["1"] * 13))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, type string, raw string")
    got = [tuple(r) for r in parsed(df, "type", "raw").select("price", "change", "percent", "error").orderBy("id").collect()]
    assert got == [(11.0, 1.0, 10.0, None), (None, None, None, "short payload"), (None, None, None, "short payload"), (None, None, None, "unknown type"), (None, None, None, "unknown type"), (None, None, None, "no price")]


def test_clustered_events_hold_every_item(spark, data):
    from newsloom.plans.queries import QUERIES

    events = QUERIES["clustered_events"](spark, data).toPandas()
    clusters = QUERIES["cluster_events"](spark, data).toPandas()
    assert events["items"].sum() == len(clusters) and set(events.event_key) == set(clusters.event_id.astype(str))
    assert (events.dates > 1).any() and (events.sources > 1).any() and events.category.notna().all()
