"""Access to the project's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ITEM_TABLES = ("platforms", "rss_feeds", "news_items", "scored_items", "trend_events", "feed_entries", "cluster_members", "documents")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of the data directory; the schema comes from the files' footers."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for written intermediate tables.

    The cluster names it in spark.checkpoint.dir. Only a session on one machine (master local[...]) may leave that unset and
    gets a temporary folder; any other raises ValueError.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not conf:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        conf = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(conf)
    return conf.rstrip("/")


def files(spark: SparkSession, path: str):  # type: ignore[no-untyped-def]
    """(file system, path) of the JVM for a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = files(spark, path)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows by way of a written table in the shared folder: computed once, and readable if executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
