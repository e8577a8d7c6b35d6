import json

from pyspark.sql import functions as F

from newsloom.sources import state


def test_watchlist(spark, tmp_path):
    default = spark.createDataFrame([("d",)], "id string")
    good, bad, empty = tmp_path / "g.json", tmp_path / "b.json", tmp_path / "e.json"
    good.write_text(json.dumps([{"id": "x", "symbol": "s", "extra": 1}, {"name": "no id"}]))
    bad.write_text("{not json")
    empty.write_text("[]")
    assert [r.id for r in state.watchlist(spark, str(good), default).collect()] == ["x"]
    for path in (bad, empty, tmp_path / "missing.json"):
        assert [r.id for r in state.watchlist(spark, str(path), default).collect()] == ["d"]


def test_previous(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"generated_at": "t", "items": [{"id": "a", "price": 1.5, "history": [{"time": "t", "price": 1.5}]}, {"id": "b"}], "errors": []}))
    rows = {r.id: r for r in state.previous_items(spark, str(path)).collect()}
    assert len(rows["a"].history) == 1 and rows["b"].history == []
    assert state.previous_items(spark, str(tmp_path / "none.json")).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("20260519080000", None, None, 11.0, 10.0), ("08:00", 2.0, None, 11.0, 0.0), ("20261399000000", None, 3.0, None, 10.0), (" ", None, None, 1.0, None)], "t string, c double, p double, v double, b double")
    c, p = state.derived_change(F.col("c"), F.col("p"), F.col("v"), F.col("b"))
    got = [tuple(r) for r in df.select(state.observation_time(F.col("t"), F.lit("now")), c, p).collect()]
    assert got == [("2026-05-19 08:00:00", 1.0, 10.0), ("08:00", 2.0, None), ("20261399000000", None, 3.0), ("now", None, None)]
    urls = spark.createDataFrame([("https://a.example/x/", "../y"), (None, "z"), ("https://a.example/", "https://b.example")], "b string, l string")
    assert [r.u for r in urls.select(state.absolute_url(F.col("b"), F.col("l")).alias("u")).collect()] == ["https://a.example/y", None, "https://b.example"]
