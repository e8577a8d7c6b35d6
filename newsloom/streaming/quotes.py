"""Histories as a stream: per key a bounded list of points, repeats suppressed, held in the state store.

The state of a key is its last points, at most `history.POINTS`, so its size has a bound whatever the stream's length.
Input of a micro-batch comes unordered and is sorted by time within the key. A point that is older than the key's last
one is placed by its time; if it is older than all of a full history, it is gone, as in the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.history import POINTS
from newsloom.tables import shared_dir


def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The key's history after a micro-batch."""
    times, values = (list(x) for x in state.get) if state.exists else ([], [])
    old = list(zip(times, values))
    for f in frames:
        f = f[f["value"].notna()]
        old += list(zip(f["us"].tolist(), f["value"].tolist()))
    old.sort()
    points = [p for i, p in enumerate(old) if i == 0 or p != old[i - 1]][-POINTS:]
    state.update(([t for t, _ in points], [v for _, v in points]))
    yield pd.DataFrame({"user_id": [key[0]] * len(points), "us": [t for t, _ in points], "value": [v for _, v in points], "pos": range(1, len(points) + 1)}).astype({"user_id": "int64", "us": "int64", "value": "float64", "pos": "int32"})


def history_stream(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """user_id, time, value, pos after the files at a path have streamed through: the last state of each key."""
    folder = folder or f"{shared_dir(spark)}/quotes-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if path.endswith("/") else path.rsplit("/", 1)[0], pathGlobFilter=path.rsplit("/", 1)[1])
    rows = stream.selectExpr("user_id", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS us", "value")
    out = rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, us long, value double, pos int", "times array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)

    def keep(df: DataFrame, batch: int) -> None:
        df.selectExpr("user_id", "us", "value", "pos", f"{batch}L AS batch").write.mode("append").parquet(f"{folder}/out")

    query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    last = written.groupBy("user_id").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return written.join(last, ["user_id", "batch"]).selectExpr("user_id", "timestampadd(MICROSECOND, us, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS time", "value", "pos")
