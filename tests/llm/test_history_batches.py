"""Problem 3: a history that outlives its session, its segments and buckets, and the query batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import history, queries
from newsloom.llm.history import History
from newsloom.tables import shared_dir, table

SCHEMA = "id long, title string, url string"


def test_history_of_an_earlier_session(spark):
    path = f"{shared_dir(spark)}/reopened-{random.random()}"
    first = [(1, "Wortkurkos Bank drops ferry KA-5021", "https://a.example/1"), (2, None, "https://a.example/2")]
    assert History(spark, path).accept(spark.createDataFrame(first, SCHEMA)).count() == 0
    again = [(3, "Wortkurkos Bank drops ferry KA-5022", None), (4, None, "https://a.example/2"), (5, "something else entirely", None)]
    assert {tuple(r) for r in History(spark, path).accept(spark.createDataFrame(again, SCHEMA)).collect()} == {(1, 3), (2, 4)}
    # smaller ids than the history's, and ids that it holds
    late = [(0, "Wortkurkos Bank drops ferry KA-5021", None), (5, "something else entirely", None), (2, None, "https://a.example/2")]
    assert {tuple(r) for r in History(spark, path).accept(spark.createDataFrame(late, SCHEMA)).collect()} == {(1, 0)}


def test_history_without_titles(spark):
    path = f"{shared_dir(spark)}/untitled-{random.random()}"
    for i in (1, 2):
        found = History(spark, path).accept(spark.createDataFrame([(i, None, "https://a.example/1")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(1, 2)]


def test_two_sessions_can_not_commit_one_version(spark):
    path = f"{shared_dir(spark)}/twice-{random.random()}"
    one, two = History(spark, path), History(spark, path)
    row = spark.createDataFrame([(1, "a title of some length", None)], SCHEMA)
    one.accept(row)
    with pytest.raises(RuntimeError):
        two.accept(row)
    assert sum(s["rows"] for s in History(spark, path).segments) == 1


def _rows(spark, data):
    return table(spark, data, "feed_entries").select(F.col("entry_id").alias("id"), "title", "url", "batch_no")


@pytest.mark.parametrize("looked_up", [0, 10**6])
def test_reopened_between_batches_like_one_batch(spark, data, monkeypatch, looked_up):
    monkeypatch.setattr(history, "MERGE", 2)
    entries, path, found = _rows(spark, data), f"{shared_dir(spark)}/many-{random.random()}", set()
    for n in range(0, 30, 8):
        batch = entries.filter(f"batch_no BETWEEN {n} AND {n + 7}")
        # small buckets: segments have several, and a batch opens those it needs
        found |= {tuple(r) for r in History(spark, path, bucket=20, looked_up=looked_up).accept(batch).collect()}
    whole = History(spark, f"{shared_dir(spark)}/whole-{random.random()}").accept(entries, keep=False)
    assert found == {tuple(r) for r in whole.collect()} and found
    held = History(spark, path).segments
    assert max(s["level"] for s in held) >= 1 and max(s["buckets"] for s in held) > 3 and len(held) < 6
    part = History(spark, path)._part
    assert part("blocks", held, {s["buckets"]: [0] for s in held}).count() < part("blocks", held).count() / 2


def test_p3_found_walks_the_batches(spark, data, monkeypatch):
    sizes, plain = [], History.accept
    monkeypatch.setattr(History, "accept", lambda self, batch, keep=True: sizes.append(len(self.segments)) or plain(self, batch, keep))
    got = sorted(tuple(r) for r in queries.p3_found(spark, data).collect())
    assert sizes == [*range(30 // queries.P3_STEP)]
    whole = plain(History(spark, f"{shared_dir(spark)}/whole-{random.random()}"), _rows(spark, data), keep=False)
    assert got == sorted(tuple(r) for r in whole.collect()) and got


def test_blocks_rest_packed(spark):
    """The cost of a batch at scale: rows of blocks are as many as buckets, not as many as blocks."""
    rows = [(i, f"{random.Random(i).getrandbits(90):x} report", f"https://a.example/{i}") for i in range(600)]
    held = History(spark, f"{shared_dir(spark)}/packed-{random.random()}", bucket=100)
    held.accept(spark.createDataFrame(rows, SCHEMA))
    assert sum(s["rows"] for s in held.segments) == 600
    assert held._part("blocks", held.segments).count() <= sum(s["buckets"] for s in held.segments)


def test_rejected_entries_are_not_found_by_their_blocks(spark):
    held, title = History(spark, f"{shared_dir(spark)}/rejected-{random.random()}"), "Wortkurkos Bank drops ferry KA-5021"
    cases = lambda rows: {tuple(r) for r in held.accept(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert cases([(1, "a story of another kind", "https://a.example/1")]) == set()
    # the title's smallest id repeats an address, so a later one is accepted
    assert cases([(5, title, "https://a.example/1"), (6, title, None)]) == {(1, 5)}
    assert cases([(7, title + "Pro", None), (5, None, "https://a.example/1"), (6, title, None)]) == {(6, 7), (1, 5)}
    assert cases([(8, title, "https://b.example/1"), (9, None, "https://b.example/1")]) == {(6, 8)}


def test_meetings_are_those_of_brute_force():
    np = pytest.importorskip("numpy")
    r = np.random.default_rng(1)

    def blocks(n, first):
        c = [r.integers(0, 40, n).astype("uint32") << 26, first + r.permutation(n), r.integers(0, 2**62, n).astype("uint64") & r.integers(0, 2**62, n).astype("uint64"), r.integers(0, 2**62, n).astype("uint64"), r.integers(20, 60, n)]
        order = np.argsort(c[0], kind="stable")
        c = [x[order] for x in c]
        c[3][c[4] <= history.LONG] = 0
        return c

    def fits(x, y):
        most = (x[4] + y[4]) / 4 + 1e-9
        bits = (x[2] ^ y[2]).bit_count() if min(x[4], y[4]) <= history.LONG else max((x[2] ^ y[2]).bit_count(), (x[2] ^ x[3] ^ y[2] ^ y[3]).bit_count() + (x[3] ^ y[3]).bit_count())
        return x[0] == y[0] and bits <= most and min(x[4], y[4]) >= 0.6 * max(x[4], y[4])

    new, old = blocks(200, 1000), blocks(300, 0)
    again = history._joined([b for _, b in history._split(new, 8)][::-1])
    assert all((sorted(a.tolist()) == sorted(b.tolist())) for a, b in zip(again, new)) and [*map(tuple, zip(*(c.tolist() for c in again)))] == [*map(tuple, zip(*(c.tolist() for c in new)))]
    n, o = ([tuple(map(int, x)) for x in zip(*c)] for c in (new, old))
    truth = {(x[1], y[1], True) for x in n for y in o if fits(x, y)} | {(x[1], y[1], False) for x in n for y in n if x[1] > y[1] and fits(x, y)}
    got = [(int(a), int(b), bool(h)) for m in history.meetings(new, old) for a, b, h, _ in zip(*m)]
    assert len(got) == len(set(got)) and set(got) == truth and truth
