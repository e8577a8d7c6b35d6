import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def same_rows(spark_rows, duck_rows):
    """Rows of two pandas frames, order and column order aside."""
    import pandas as pd

    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return repr(list(v))
        if pd.isna(v):
            return None
        if isinstance(v, (bool, str)):
            return v
        return str(pd.Timestamp(v)) if hasattr(v, "year") else float(v)

    def rows(df):
        return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)

    assert sorted(spark_rows.columns) == sorted(duck_rows.columns)
    return rows(spark_rows) == rows(duck_rows)


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con
