"""Round-robin merge of ordered sources with duplicates removed across them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(entries: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """pos, source, item_id, key of (source, item_id, key): in rounds over the sources each gives its next entry whose key
    is new, until `limit`.

    An entry that comes out has at most `limit` different keys before it in its own source, so only the first `limit`
    entries with distinct keys of a source can matter; these are cut out in parallel, and sources * limit rows, a bound
    that doesn't grow with the data, reach the one fold. Sources outside `order` follow it by name. Null and empty keys
    never come out.
    """
    rows = entries.filter("key IS NOT NULL AND key <> ''")
    once = rows.groupBy("source", "key").agg(F.min("item_id").alias("item_id"))
    first = once.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("item_id"))).filter(F.col("_k") <= limit)
    rank = {s: i for i, s in enumerate(order)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[str, list[tuple]] = {}
        for b in batches:
            for s, i, k in zip(*(c.to_pylist() for c in b.columns)):
                queues.setdefault(s, []).append((i, k))
        names = sorted(queues, key=lambda s: (rank.get(s, len(rank)), s))
        feeds = {s: iter(sorted(queues[s])) for s in names}
        seen: set[str] = set()
        out: list[tuple] = []
        while feeds and len(out) < limit:
            for s in [s for s in names if s in feeds]:
                for i, k in feeds[s]:
                    if k not in seen:
                        seen.add(k)
                        out.append((len(out) + 1, s, i, k))
                        break
                else:
                    del feeds[s]
                if len(out) >= limit:
                    break
        cols = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.string()))], ["pos", "source", "item_id", "key"])

    return first.select("source", "item_id", "key").repartition(1).mapInArrow(fold, "pos int, source string, item_id long, key string")
