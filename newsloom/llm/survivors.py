"""One surviving record of every group of duplicates, field by field (problem 2).

Skyline selection: a member is dominated if another is at least as good in completeness (one flag per field and the
length of the summary), trust and recency. Completeness is a vector, so the best owner of a field is never dominated:
whoever dominated it would own the field as well and win by the same policy. The undominated members are the first
layer, the undominated of the rest the second, and so on. Each field goes to the member that a lexicographic policy
ranks first among those of the first layer that has a usable value; fields still open are filled from the next layers.

At scale: layers of a union lie within the union of layers, so they are computed where the rows are, Arrow batch by
batch and merged per task, and a group of any size sends a few dozen members per task, not its rows. One exchange by
group; the merged layers of a group are folded as a stream, with the group's current layers as the only state. Values
never travel: only flags, lengths, trust, times and ids do.

Defined results: a group counts if it has two distinct member ids; null group or member ids don't count; a null trust is
0, a null time the earliest and makes published_at unusable; repeated rows change nothing; rows of one id with different
values are members like others; an empty table gives no rows; columns of other names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "url", "summary", "published_at")
LAYERS = 2
#: Members that a task holds before it passes them on.
HELD = 50_000
_KEPT = r"[^\p{L}\p{Nd}]"
_HTTP = r"(?i)^https?://([^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/?#@:\s\[\]]*[\p{L}\p{Nd}][^/?#@:\s\[\]]*)(:\d*)?([/?#].*)?$"
_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"
_COLUMNS = ("cluster", "member", "title", "url", "summary", "published", "trust", "fetched")
_SCHEMA = ", ".join(f"{c} long" for c in (*_COLUMNS, "low", "high"))


def measured(members: DataFrame) -> DataFrame:
    """cluster, member and how good each field is (0: unusable; the summary: its length), trust and time of fetching."""

    def usable(ok):  # type: ignore[no-untyped-def]
        return F.coalesce(ok, F.lit(False)).cast("long")

    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    fetched = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(fetched_at AS TIMESTAMP_NTZ))")
    stamp = trim(F.col("published_at"))
    zoned = F.when(stamp.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$") & stamp.rlike(r":\d{2}"), stamp).otherwise(F.concat(stamp, F.lit("Z")))
    instant = F.unix_micros(zoned.try_cast("timestamp"))
    return members.select(
        F.col("cluster_id").cast("long").alias("cluster"),
        F.col("member_id").cast("long").alias("member"),
        usable(F.length(F.regexp_replace("title", _KEPT, "")) >= 5).alias("title"),
        usable(trim(F.col("url")).rlike(_HTTP)).alias("url"),
        F.when(F.length(F.regexp_replace("summary", _KEPT, "")) >= 10, F.length(trim(F.col("summary")))).otherwise(0).cast("long").alias("summary"),
        usable(stamp.rlike(_ISO) & (instant >= 946_684_800_000_000) & (instant <= fetched)).alias("published"),
        F.coalesce(F.col("trust").cast("long"), F.lit(0)).alias("trust"),
        F.coalesce(fetched, F.lit(-(2**62))).alias("fetched"),
    ).filter("cluster IS NOT NULL AND member IS NOT NULL")


def layers(rows: np.ndarray, depth: int) -> np.ndarray:
    """The layer (1 to depth, 0 beyond) of each row of an array with the columns of _COLUMNS, sorted by cluster.

    Rows that are equal throughout count once: all but one get 0.
    """
    recency = np.zeros(len(rows), "int64")
    order = np.lexsort((-rows[:, 1], rows[:, 7]))
    steps = np.any(rows[order][1:, [1, 7]] != rows[order][:-1, [1, 7]], axis=1)
    recency[order[1:]] = np.cumsum(steps)
    dims = np.column_stack([rows[:, 6], recency, rows[:, 4], rows[:, 2], rows[:, 3], rows[:, 5]])
    cluster = rows[:, 0]
    order = np.lexsort((*(-dims[:, k] for k in range(5, -1, -1)), cluster))
    new = np.ones(len(order), bool)
    new[1:] = np.any(dims[order][1:] != dims[order][:-1], axis=1) | (cluster[order][1:] != cluster[order][:-1])
    out, left = np.zeros(len(rows), "int64"), order[new]
    for layer in range(1, depth + 1):
        alive, later = left, []
        # the first of each cluster in lexicographic order is undominated; it removes what it dominates
        while len(alive):
            starts = np.ones(len(alive), bool)
            starts[1:] = cluster[alive][1:] != cluster[alive][:-1]
            leader = alive[starts][np.cumsum(starts) - 1]
            out[alive[starts]] = layer
            beaten = np.all(dims[alive] <= dims[leader], axis=1)
            later.append(alive[beaten & ~starts])
            alive = alive[~beaten]
        left = np.concatenate(later) if later else left[:0]
        left = left[np.lexsort((*(-dims[left, k] for k in range(5, -1, -1)), cluster[left]))]
        if not len(left):
            break
    return out


def _array(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, b.num_columns), "int64")


def _reduced(rows: np.ndarray, depth: int) -> np.ndarray:
    """The layers' rows, and in the last two columns the smallest and greatest member id of the cluster."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
    sizes = np.diff(np.append(starts, len(rows)))
    rows[:, 8] = np.repeat(np.minimum.reduceat(rows[:, 8], starts), sizes)
    rows[:, 9] = np.repeat(np.maximum.reduceat(rows[:, 9], starts), sizes)
    return rows[layers(rows, depth) > 0]


def _batch(rows: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], list(names))


def _partial(depth: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = (*_COLUMNS, "low", "high"), np.zeros((0, 10), "int64")
        for b in batches:
            if b.num_rows:
                rows = _array(b)
                held = np.concatenate([held, _reduced(np.column_stack([rows, rows[:, 1], rows[:, 1]]), depth)])
                if len(held) > HELD:
                    held = _reduced(held, depth)
                if len(held) > HELD // 2:
                    yield _batch(held, names)
                    held = held[:0]
        if len(held):
            yield _batch(_reduced(held, depth), names)

    return run


def _chosen(rows: np.ndarray, depth: int) -> np.ndarray:
    """cluster, and the member that gives each field, of complete clusters sorted by cluster."""
    rows = _reduced(rows, depth)
    layer = layers(rows, depth)
    cluster = rows[:, 0]
    starts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    out = np.zeros((len(starts), 5), "int64")
    out[:, 0] = cluster[starts]
    trust, fetched, member = -rows[:, 6], -rows[:, 7], rows[:, 1]
    policies = [(rows[:, 2], (member, fetched, trust)), (rows[:, 3], (member, fetched, trust)), (rows[:, 4], (member, fetched, trust, -rows[:, 4])), (rows[:, 5], (member, trust, fetched))]
    for f, (usable, policy) in enumerate(policies):
        at = np.flatnonzero(usable > 0)
        at = at[np.lexsort((*(k[at] for k in policy), layer[at], cluster[at]))]
        first = np.concatenate([[True], cluster[at][1:] != cluster[at][:-1]]) if len(at) else np.zeros(0, bool)
        out[np.searchsorted(out[:, 0], cluster[at[first]]), f + 1] = member[at[first]]
    return out[rows[starts, 8] != rows[starts, 9]]


def survivors(members: DataFrame, depth: int = LAYERS) -> DataFrame:
    """cluster_id, and title_member, url_member, summary_member, published_member: who gives each field, 0 for nobody."""
    names = ("cluster_id", "title_member", "url_member", "summary_member", "published_member")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 10), "int64")
        for b in batches:
            if b.num_rows:
                held = np.concatenate([held, _array(b)])
                whole = held[:, 0] != held[-1, 0]  # the last cluster may go on
                if whole.any():
                    yield _batch(_chosen(held[whole], depth), names)
                held = _reduced(held[~whole], depth)
        if len(held):
            yield _batch(_chosen(held, depth), names)

    partial = measured(members).mapInArrow(_partial(depth), _SCHEMA)
    return partial.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(fold, ", ".join(f"{n} long" for n in names))


def records(members: DataFrame, depth: int = LAYERS) -> DataFrame:
    """cluster_id, title, url, summary, published_at: the record built from the members that `survivors` names."""
    who = survivors(members, depth).select("cluster_id", F.expr("stack(4, 'title', title_member, 'url', url_member, 'summary', summary_member, 'published_at', published_member) AS (field, member_id)"))
    # rows of one id may differ; of those the greatest value is taken
    values = members.select(F.col("cluster_id").cast("long"), F.col("member_id").cast("long"), *FIELDS)
    out = who.join(values, ["cluster_id", "member_id"], "left").groupBy("cluster_id")
    return out.agg(*(F.max(F.when(F.col("field") == f, F.col(f))).alias(f) for f in FIELDS))
