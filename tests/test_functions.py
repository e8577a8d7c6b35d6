import pytest
from pyspark.sql import functions as F

from newsloom.functions import score as S
from newsloom.functions import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for i, v in enumerate(values)))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("weight", "trust", "rank", "count", "want"),
    [(17, 84, 1, 6, 60.519435), (10, 58, 10, 100, 43.157881), (14, 76, None, 1, 33.065736 - 8)],
)
def test_item_score(spark, weight, trust, rank, count, want):
    df = spark.createDataFrame([("t", weight, count, rank, trust)], "t string, w int, c int, r int, q int")
    got = df.select(S.item_score(F.col("t"), F.col("w"), F.col("c"), F.col("r"), F.col("q")).alias("x")).first().x
    assert got == pytest.approx(want, abs=1e-6)


def test_digest_score(spark):
    df = spark.createDataFrame([(15, 6, 1)], "w int, c int, r int")
    assert df.select(S.digest_item_score(F.col("w"), F.col("c"), F.col("r")).alias("x")).first().x == pytest.approx(61.397855, abs=1e-6)


def test_text(spark):
    c = F.col("c0")
    assert one(spark, T.clean_text(c), "<b>A&amp;B</b> 　 x ") == "A&B x"
    assert one(spark, T.clean_text(c), None) == ""
    assert one(spark, T.title_key(c), "【突发】Hello, World! 最新") == "突发helloworld"
    assert one(spark, T.term_hits(c, ["AI", "芯片"]), "He said OpenAI") == ["AI"]
    assert one(spark, T.shortened(c, 5), "ab  cd ef") == "ab cd..."
    assert one(spark, T.looks_mojibake(c), "Ã¤Ã¶ä¸") and not one(spark, T.looks_mojibake(c), None)
    assert one(spark, T.html_escape(c), "<a&'\">") == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(spark, T.html_unescape(c), "&eacute;&#x4e2d;&amp;amp;") == "é中&amp;"


@pytest.mark.parametrize(("url", "want"), [("x/20260519/y", "2026-05-19"), ("x/20261399/y", None), ("x/2026/05/19/", None), (None, None)])
def test_url_date(spark, url, want):
    got = one(spark, T.url_date(F.col("c0")), url)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("clock", "want"), [("08-30", "08:30"), ("08:30", "08:30"), ("25:99", "00:00"), ("", "00:00"), ("8:30", "00:00"), (None, "00:00")])
def test_crawl_time(spark, clock, want):
    got = one(spark, T.crawl_time(F.lit("2026-05-19").cast("date"), F.col("c0")), clock)
    assert got.strftime("%H:%M") == want


@pytest.mark.parametrize(("v", "want"), [(None, None), ("x", None), ("0", None), ("-1", None), ("3", 3), ("12.0", None)])
def test_positive(spark, v, want):
    assert one(spark, T.positive(F.col("c0")), v) == want


def test_classes(spark):
    c = F.col("c0")
    assert one(spark, S.domains(c), "央行下调利率") == ["policy", "finance"] and one(spark, S.domains(c), "早安") == ["general"]
    assert one(spark, S.primary_category(c), "世界杯决赛") == "sports" and one(spark, S.primary_category(c), None) == "general"
    assert one(spark, S.topic(c), "黄金大涨") == "gold-trend" and one(spark, S.topic(c), "关税") is None
    assert one(spark, S.bucket(c), "美国芯片") == "term:美国" and one(spark, S.bucket(c), "早安") == "domain:general"
