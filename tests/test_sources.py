import json
import sqlite3
from datetime import date

from pyspark.sql import functions as F

from newsloom.sources.feeds import delimited, recent, rss_entries
from newsloom.sources.sinks import ascii_references, json_payload, markdown_digest, rss_feed
from newsloom.sources.sqlite import SqliteDataSource, is_database


def test_sqlite(spark, tmp_path):
    for day, rows in (("2026-01-01", [(1, "a", 3), (2, None, None)]), ("2026-01-02", [(3, "中文", 1)])):
        con = sqlite3.connect(tmp_path / f"{day}.db")
        con.execute("CREATE TABLE news_items (id INTEGER, title TEXT, rank INTEGER)")
        con.executemany("INSERT INTO news_items VALUES (?, ?, ?)", rows)
        con.commit()
        con.close()
    (tmp_path / "bad.db").write_bytes(b"not a database")
    sqlite3.connect(tmp_path / "empty.db").execute("CREATE TABLE other (x)").connection.commit()
    assert is_database(str(tmp_path / "2026-01-01.db")) and not is_database(str(tmp_path / "bad.db")) and not is_database("/nowhere")
    spark.dataSource.register(SqliteDataSource)
    df = spark.read.format("sqlite").option("path", f"{tmp_path}/*.db").option("table", "news_items").schema("id long, title string, rank int, url string, _file string").load()
    assert {tuple(r) for r in df.collect()} == {(1, "a", 3, None, "2026-01-01"), (2, None, None, None, "2026-01-01"), (3, "中文", 1, None, "2026-01-02")}
    none = spark.read.format("sqlite").option("path", f"{tmp_path}/x*.db").option("table", "news_items").schema("id long").load()
    assert none.count() == 0


def test_rss_round_trip(spark):
    rows = [("g", 1, "A & B", "u1", "s", "sum", "2026-01-02 03:04:05"), ("g", 2, "中文 标题", "u2", "s", None, "2026-01-02 03:04:05")]
    df = spark.createDataFrame(rows, "g string, pos int, t string, l string, s string, d string, w string").withColumn("w", F.col("w").cast("timestamp_ntz"))
    feed = rss_feed(df, "g", "pos", "News", ("t", "l", "s", "d", "w"))
    back = rss_entries(feed.select("g", ascii_references(F.col("xml")).alias("x"), "xml"), "g", "xml").orderBy("pos").collect()
    assert [(r.title, r.link, r.published, r.description) for r in back] == [("A & B", "u1", "Fri, 02 Jan 2026 03:04:05 +0000", "sum"), ("中文 标题", "u2", "Fri, 02 Jan 2026 03:04:05 +0000", "中文 标题")]
    assert rss_entries(spark.createDataFrame([(1, "no xml"), (2, None)], "i int, x string"), "i", "x").count() == 0
    assert feed.select(ascii_references(F.col("xml")).alias("x")).first().x.isascii()


def test_recent(spark):
    df = spark.createDataFrame([("x/20260519/a",), ("x/20260515/a",), ("x/a",)], "u string")
    assert [r.date for r in recent(df, "u", F.lit("2026-05-20").cast("date")).collect()] == [date(2026, 5, 19)]


def test_delimited(spark):
    df = spark.createDataFrame([('v_x="1~name~~3.5~nan";',), ("1~n",), (None,)], "p string")
    got = [r.s for r in df.select(delimited(F.col("p"), "~", {"name": 1, "code": 2, "price": 3, "odd": 4}, {"price", "odd"}, 5).alias("s")).collect()]
    assert tuple(got[0]) == ("name", None, 3.5, None) and got[1] is None and got[2] is None


def test_json_and_markdown(spark):
    df = spark.createDataFrame([("d", i, f"t[{i}]", None if i == 2 else f"u{i}") for i in range(1, 4)], "d string, pos int, t string, u string")
    assert json.loads(json_payload(df, "pos", ["t", "u"]).filter("pos = 2").first().json) == {"t": "t[2]", "u": None}
    text = markdown_digest(df, "d", "pos", "t", "u", must=2).first().text
    assert text == "## Must read\n1. [t\\[1\\]](u1)\n2. [t\\[2\\]]()\n\n## More\n3. [t\\[3\\]](u3)\n"
