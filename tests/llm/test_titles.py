"""Problems 3, 4, 6 and 7: look-alikes, encodings, like titles, history."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm.charsets import explanations, is_garbled
from newsloom.llm.garbled import restored
from newsloom.llm.grams import grams_of, minhash, odd_sketch, similarity
from newsloom.llm.history import History, address_key
from newsloom.llm.like_titles import banding, like_pairs, plain_keys
from newsloom.llm.lookalike_rows import consistent, odd_rows
from newsloom.llm.lookalikes import build_mapping, fold
from newsloom.tables import shared_dir

PLAIN = [
    "骁萱镇公布Ω型试验，批次818份", "α系列债券", "Данюрэльким мирпол №193", "Zombraômcre Bank für Täst", "食品（图）：首日【快讯】", "股价涨54.3%📈", "用户破🏃‍♀️", "👩‍💻", "❤️",
    "10℃ ™ ½ ²", "", " ", "STÄRKE À LA", "µ介子", "مرحبا‌بك",
]
ODD = {
    "Ｋｅｎｄ Ｂａｎｋ": "Kend Bank", "Café Nëw": "Café Nëw", "a b c d": "a b c d", "E​R-56⁠­x﻿": "ER-56x", "机器⼈⻋": "机器人车", "proﬁt": "profit",
    "ℎello Ⅷ": "hello VIII", "ɡoogle": "google", "пaспорт": "паспорт", "ｶﾞｽ ｅ́": "ガス é", "\u1100\u1161\u11a8": "\uac01", "Ditha\u2060\u030aq": "Ditháq".replace("á", "å"), "Νр‑422X": "Hp-422X".replace("H", "N"), "Βх6288Ѕ型": "Bx6288S型", "fіles mоdel": "files model", "𝐀bc": "Abc", "股价‍涨": "股价涨", "Ѕ467裁员": "S467裁员",
}


@pytest.mark.parametrize("text", PLAIN)
def test_text_that_stays(text):
    assert fold(text) == (text, False)


@pytest.mark.parametrize("text", sorted(ODD))
def test_text_that_is_brought_to_one_form(text):
    assert fold(text) == (ODD[text], True) and fold(ODD[text])[1] is False


def test_mapping_is_conflict_free():
    assert len(build_mapping()) > 300


def test_transducer_takes_the_longest_key():
    from newsloom.llm.lookalikes import Transducer

    t = Transducer({"(": "[", "(c)": "©", "(c) ": "© by ", "x": ""})
    assert t.run("(c) (c)(b)x") == ("© by ©[b)", True) and t.run("plain") == ("plain", False)


def test_rules_that_conflict_are_refused(monkeypatch):
    from newsloom.llm import lookalikes

    monkeypatch.setitem(lookalikes.TO_LATIN, "а", "Ａ")
    with pytest.raises(ValueError):
        build_mapping()


def test_odd_rows(spark):
    long = "字" * 200_000 + "​"
    rows = [(i, t) for i, t in enumerate([*PLAIN, *ODD, None, long, "宣å¸ƒå¼•è¿›​"])]
    df = spark.createDataFrame(rows + rows[-3:], "id long, text string").withColumn("row_id", F.lit("x")).withColumn("_text", F.lit(1))
    n = len(PLAIN)
    assert {r.row_id for r in odd_rows(df, "id", "text").collect()} == {*range(n, n + len(ODD)), n + len(ODD) + 1}
    assert odd_rows(df.limit(0), "id", "text").count() == 0
    forms = {r.id: r.form for r in consistent(df, "text", "form").collect()}
    assert forms[n] == ODD[rows[n][1]] and forms[0] == PLAIN[0] and forms[n + len(ODD)] is None
    with pytest.raises(ValueError):
        consistent(df, "text", "text")


CLEAN = ["睿稷市气象台提醒，未来34小时风力加大，航班或有延误。", "Händler rechnen mit größeren Schwankungen, heißt es bei Toåndcirkam.", "é à la carte — für “alle”", "项目编号LR-9895e，流水单据尾号4593"]


def _cp(text, codec):
    return "".join(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in text.encode())


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("way", ["cp1252", "latin-1", "cp1251", "twice", "gbk as latin-1"])
def test_wrong_decodings_are_undone(text, way):
    if way == "gbk as latin-1":
        if "市" not in text and "目" not in text:
            pytest.skip("no Chinese")
        bad = text.encode("gbk").decode("latin-1")
    else:
        bad = _cp(_cp(text, "cp1252"), "cp1252") if way == "twice" else _cp(text, way)
    assert is_garbled(bad) and text in explanations(bad).values()
    assert not is_garbled(text)


def test_restored(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(300):
        text = f"{rng.choice(CLEAN)} Nr {i * 7919 % 1000}"
        bad = text
        if i % 5 == 0:
            bad = _cp(text, rng.choice(["cp1252", "latin-1"]))
            want[i, "title"] = text
        elif i % 17 == 0:
            bad = "�" * 9 + " lost"
            want[i, "title"] = ""
        elif i % 11 == 0:
            bad = text + " " + _cp("，净利润回落", "cp1252")
            want[i, "title"] = text + " ，净利润回落"
        rows.append((i, bad, rng.choice([None, "", "plain", text])))
    rows += [(900 + i, "营收同比，净利润回落", None) for i in range(3)]
    df = spark.createDataFrame(rows + rows[:20], "id long, title string, summary string").withColumn("row_id", F.lit(0)).withColumn("field", F.lit(0))
    got = {(r.row_id, r.field): r.restored for r in restored(df, "id", ["title", "summary"]).collect()}
    assert got == want
    assert restored(df.limit(0), "id", ["title"]).count() == 0


@pytest.mark.parametrize("codec", ["mac_roman", "cp437", "koi8_r", "own"])
def test_encodings_that_nobody_listed(spark, codec):
    rng = random.Random(codec)
    own = rng.sample([chr(c) for c in range(0x2500, 0x2580)], 128)  # no codec has these
    wrong = lambda t: "".join(chr(b) if b < 128 else own[b - 128] if codec == "own" else bytes([b]).decode(codec, "replace") for b in t.encode())
    words = ["Händler", "größer", "Café", "résumé", "niño", "Łódź", "東京", "营收", "Ελλάδα"]
    rows, want = [], {}
    for i in range(240):
        text = f"Report {i} of {rng.choice(words)} and {rng.choice(words)} in Kordenbrook"
        if "�" in (bad := wrong(text)):
            bad = text
        rows.append((2 * i, text, None))
        if i % 2 and bad != text:
            rows.append((2 * i + 1, bad, "x"))
            want[2 * i + 1, "title"] = text
    # no twin of these: what was learned restores them
    for i in range(1000, 1040):
        text = f"{rng.choice(words)} ohne Zwilling {i * 7}"
        if "�" not in (bad := wrong(text)):
            rows.append((i, bad, None))
            want[i, "title"] = text
    df = spark.createDataFrame(rows, "id long, title string, summary string")
    got = {(r.row_id, r.field): r.restored for r in restored(df, "id", ["title", "summary"]).collect()}
    wrongly = {k: (v, want.get(k)) for k, v in got.items() if want.get(k) != v}
    assert not wrongly and len(got) >= 0.95 * len(want) > 60


def test_words_beside_emoji_teach_nothing(spark):
    rows = []
    for i in range(60):
        text = f"Kordenbrook Bank {i} drops ferry KA-{i * 37}"
        rows += [(3 * i, text + "🔥", None), (3 * i + 1, text + "回应来了", None), (3 * i + 2, f"市方面回应了{i}起投诉，来年再议 KA-{i * 11}", None)]
    assert restored(spark.createDataFrame(rows, "id long, title string, summary string"), "id", ["title"]).count() == 0


def test_lost_characters_read_as_gbk(spark):
    df = spark.createDataFrame([(1, "淞菱虹集团与锟斤拷锟斤拷裁员2676人", None)], "id long, title string, summary string")
    assert [tuple(r) for r in restored(df, "id", ["title"]).collect()] == [(1, "title", "")]


def _titles(rng, n):
    words = ["霖羲蓓智造", "三季度撤回传感器", "弘荻市方面跌破", "Wortkurkos Bank drops", "ferry in Mosbromzond", "loss of", "首日售出", "回应"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            t = list(rng.choice(out)[1] or "x")
            for _ in range(rng.randrange(6)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(2)] = rng.choice("某ab1 ")
            t = "".join(t)
        else:
            t = rng.choice([None, "", "公告", " ".join(rng.sample(words, 4)) + str(rng.randrange(10**5))])
        out.append((i, t))
    return out


def _like(rows):
    from newsloom.llm.lookalikes import plain_key

    keys = {i: plain_key(t) for i, t in rows if t and not is_garbled(t)}
    keys = {i: k for i, k in keys.items() if len(k) >= 8}
    return {(a, b) for a in keys for b in keys if a < b and similarity(keys[a], keys[b]) >= 0.6}


def test_like_pairs_like_brute_force(spark):
    rng = random.Random(8)
    rows = _titles(rng, 500)
    # a group of copies, some in other letters
    rows += [(1000 + i, "Wortkurkos Bank drops KA-5021Pro ferry" if i % 3 else "Ｗortkurkos BANK drops KA‑5021Pro ferry") for i in range(60)]
    df = spark.createDataFrame([("a", *r) for r in rows + rows[:9]], "tbl string, id long, title string").withColumn("key", F.lit("x"))
    got = {(r.id_a, r.id_b) for r in like_pairs(plain_keys(df), len(rows)).collect()}
    want = _like(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 1700
    assert like_pairs(plain_keys(df.limit(0)), 0).count() == 0


def test_last_characters_make_no_false_copies(spark):
    rng = random.Random(5)
    rows = []
    for i in range(0, 900, 3):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(9, 30)))
        # the last character changed, a copy, and a near miss
        rows += [(i, base), (i + 1, base[:-1] + rng.choice("0123456789")), (i + 2, base if i % 2 else base[: len(base) // 2] + "0123456789")]
    df = spark.createDataFrame([("a", *r) for r in rows], "tbl string, id long, title string")
    got = [(r.id_a, r.id_b) for r in like_pairs(plain_keys(df), len(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) <= _like(rows) and len(_like(rows) - set(got)) <= 0.01 * len(got)


def test_more_grams_than_two_bytes_count():
    import numpy as np

    from newsloom.llm import like_titles

    rng = random.Random(4)
    a = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(70_000))
    keys = [a, a[:60_000] + a[1:9_000], a[20_000:]]
    g = grams_of(keys)
    low, high = odd_sketch(g)
    e = np.zeros(3, like_titles._ENTRY)
    e["odd"], e["n"] = low ^ high, np.minimum(g.counts, like_titles.WIDE)
    ids = np.array([3, 8, 9])
    assert [x.tolist() for x in like_titles._unpack(like_titles._pack(ids, e, high, g.counts))] == [ids.tolist(), e.tolist(), high.tolist(), g.counts.tolist()]


def test_sketches():
    import numpy as np

    rng = random.Random(1)
    keys = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(8, 90))) for _ in range(200)]
    g = grams_of(keys)
    low, high = odd_sketch(g)
    sets = [{k[i : i + 3] for i in range(len(k) - 2)} for k in keys]
    assert g.counts.tolist() == [len(s) for s in sets]
    for a, b in zip(range(0, 100), range(100, 200)):
        away = len(sets[a] ^ sets[b])
        assert np.bitwise_count(low[a] ^ low[b]) + np.bitwise_count(high[a] ^ high[b]) <= away
        assert np.bitwise_count(low[a] ^ high[a] ^ low[b] ^ high[b]) <= away
    assert minhash(g, 6).shape == (6, 200)
    r, b = banding(10_000)
    assert 1 - (1 - 0.66**r) ** b >= 0.995 and banding(10**9)[0] > r


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://www.a.example/x/?id=1&ref=2", "HTTP://A.example:80/x?id=1#top", True), ("https://a.example/x?aid=1&docid=2", "https://a.example/x?docid=2&utm=z&aid=1", True),
        ("https://a.example/x?id=1", "https://a.example/x?id=2", False), ("https://a.example/x", "https://a.example/X", False), ("https://a.example:8080/x", "https://a.example/x", False),
        ("https://a.example:443/", "https://a.example", True), ("https://b.example/x", "https://a.example/x", False),
    ],
)
def test_addresses(spark, a, b, same):
    x, y = (r.k for r in spark.createDataFrame([(1, a), (2, b)], "i int, u string").select("i", address_key(F.col("u")).alias("k")).orderBy("i").collect())
    assert (x == y) is same


def test_no_addresses(spark):
    df = spark.createDataFrame([(None,), ("",), ("#",), ("/x/y",), ("www.a.example",)], "u string")
    assert df.filter(address_key(F.col("u")).isNotNull()).count() == 0


def _sequential(rows):
    from newsloom.llm.lookalikes import plain_key

    kept, out = [], set()
    for i, t, u in sorted({r[0]: r for r in rows if r[0] is not None}.values()):
        key = plain_key(t) if t and not is_garbled(t) else ""
        hit = [j for j, k, v in kept if (u and u == v) or (len(key) >= 8 and len(k) >= 8 and similarity(key, k) >= 0.6)]
        if hit:
            out.add((min(hit), i))
        else:
            kept.append((i, key, u))
    return out


@pytest.mark.parametrize("cuts", [[], [120, 260]])
def test_history_like_one_by_one(spark, cuts):
    rng = random.Random(12)
    rows = [(i, t, rng.choice([None, "", *(f"https://a.example/{k}" for k in range(150))]) if rng.random() < 0.7 else "https://a.example/hot") for i, t in _titles(rng, 400)]
    schema, found = "id long, title string, url string", set()
    history = History(spark, f"{shared_dir(spark)}/test-history-{len(cuts)}-{random.random()}")
    for lo, hi in zip([0, *cuts], [*cuts, 400]):
        part = [r for r in rows if lo <= r[0] < hi]
        batch = spark.createDataFrame(part + part[:5] + [(None, "x", "y")], schema).withColumn("a", F.lit(1)).withColumn("t", F.lit(1))
        found |= {(r.first_id, r.entry_id) for r in history.accept(batch).collect()}
    want = _sequential(rows)
    assert len(found ^ want) <= 0.01 * len(want) and len(want) > 100


def test_empty_batch(spark):
    history = History(spark, f"{shared_dir(spark)}/empty-{random.random()}")
    assert history.accept(spark.createDataFrame([], "id long, title string, url string")).count() == 0
