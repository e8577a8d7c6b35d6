"""Problems 1 and 2: the best of groups, and one record of each."""

import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from newsloom.llm.queries import QUERIES, SQL
from newsloom.llm.survivors import layers, survivors
from newsloom.llm.top_n import latest, score_class, thresholds, top_n

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_sql(spark, data, duck, name):
    assert same_rows(QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df())


def test_score_class_keeps_order(spark):
    rng = random.Random(2)
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.c for r in df.select("v", score_class(F.col("v")).alias("c")).orderBy("v").collect()]
    assert got == sorted(got)


def _best(rows, n):
    last = {}
    for i, g, s, t in rows:
        if i is None:
            continue
        k = (t is not None, t or T0, s is not None and s == s, s if s is not None and s == s else -math.inf, g is not None, g or "")
        if i not in last or k > last[i][0]:
            last[i] = (k, g, s)
    groups = {}
    for i, (_, g, s) in last.items():
        if g is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, i))
    return {(g, p + 1, i) for g, v in groups.items() for p, (_, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n_like_brute_force(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(4000):
        # a hot group with a third of all rows, ties, bad scores, missing groups, repeated ids
        g = "hot" if rng.random() < 0.33 else rng.choice([None, "", *(f"g{k}" for k in range(200))])
        s = rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, float(rng.randrange(-30, 30)), rng.random()])
        rows.append((rng.choice([None, *range(3500)]), g, s, rng.choice([None, T0 + timedelta(hours=rng.randrange(9))])))
    df = spark.createDataFrame(rows, "id long, grp string, score double, t timestamp_ntz").withColumn("row_id", F.lit("clash")).withColumn("pos", F.lit(0))
    kept = latest(df, "id", "grp", "score", "t")
    assert {tuple(r) for r in top_n(kept, n).collect()} == _best(rows, n)
    assert thresholds(kept, n).count() <= 202 and top_n(kept.limit(0), n).count() == 0


def _brute_survivors(rows):
    out = {}
    for c in {r[0] for r in rows if r[0] is not None}:
        own = {r for r in rows if r[0] == c and r[1] is not None}
        if len({r[1] for r in own}) < 2:
            continue
        letters = lambda s: sum(ch.isalpha() or ch.isdecimal() for ch in s or "")
        key = lambda r: (-(r[2] or 0), -(r[7] - T0).total_seconds(), r[1])
        title = sorted((r for r in own if letters(r[3]) >= 5), key=key)
        url = sorted((r for r in own if (r[4] or "").startswith("http") and len(r[4]) > 9), key=key)
        summary = sorted((r for r in own if letters(r[5]) >= 10), key=lambda r: (-len(r[5].strip()), *key(r)))
        parse = lambda s: datetime.fromisoformat(s.replace("Z", "")) if s and s.endswith("Z") and s[0] == "2" and "-02-31" not in s else None
        pub = sorted((r for r in own if parse(r[6]) and parse(r[6]) <= r[7]), key=lambda r: (-(r[7] - T0).total_seconds(), -(r[2] or 0), r[1]))
        out[c] = tuple(x[0][1] if x else 0 for x in (title, url, summary, pub))
    return out


def test_survivors_like_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        c = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 300)])
        when = T0 + timedelta(hours=rng.randrange(40))
        rows.append(
            (c, rng.randrange(1, 2500), rng.choice([None, 0, 50, 50, 90]), rng.choice([None, "", "null", "A title", "标题标题标"]), rng.choice([None, "#", "http://", "https://a.example/x", "www"]),
             rng.choice([None, "-", "  ten letters and more  ", "查看全文", "另一段足够长的摘要文字"]), rng.choice([None, "-", "2026-02-31T10:00:00Z", "1970-01-01T00:00:00Z", "2026-01-01T05:00:00Z", "2099-01-01T00:00:00Z"]), when)
        )
    # one id has one row
    rows = list({r[1]: r for r in rows}.values())
    rows += rows[:50]
    schema = "cluster_id long, member_id long, trust int, title string, url string, summary string, published_at string, fetched_at timestamp_ntz"
    df = spark.createDataFrame(rows, schema).withColumn("cluster", F.lit("x")).withColumn("member", F.lit(1)).repartition(7)
    got = {r.cluster_id: tuple(r)[1:] for r in survivors(df).collect()}
    assert got == _brute_survivors(rows)
    assert survivors(df.limit(0)).count() == 0


def test_layers():
    import numpy as np

    rows = np.array([[1, i, a, 0, b, 0, c, 0] for i, (a, b, c) in enumerate([(1, 5, 5), (1, 4, 4), (0, 9, 1), (0, 1, 1)])])
    assert layers(rows, 3).tolist()[0] == 1 and layers(rows, 3).tolist()[2] == 1 and 2 in layers(rows, 3).tolist()
