"""Near-duplicate short texts over a whole table (problem 7).

Like titles share at least `threshold` of the grams that either has. Candidates come from bands of MinHash values. Each
band's entry carries an odd sketch, a parity bitmap of the title's grams: the XOR population count of two sketches never
exceeds the difference of the two sets, so a candidate whose count is over what the threshold allows is dropped where it
arises, without loss and before anything is joined. What remains is verified on the texts.

Copies come first: titles with equal keys are one class, found by a hash of 96 bits of the whole key, pre-aggregated, so
that a class of any size sends one row per task. Only the smallest id of a class is compared with others.

Layout at scale: the keys are exchanged once, by id, which removes redelivered rows; the same exchange serves the
classes, the signatures and both sides of the verification. Band entries travel packed, some 15 bytes each, in one block
per batch, band and key range; a shard is a band's key range, as many as keep a shard's entries near SHARD_BYTES, and its
entries are sorted and compared as arrays.

Defined results: null, empty and garbled titles and those with fewer than `min_chars` letters or digits are never
compared; a title of any length is read whole; ids with several different titles keep the smallest; a title pairs with
its copies under other ids; an empty table gives no rows. Input columns of other names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.charsets import is_garbled
from newsloom.llm.grams import band_keys, grams_of, minhash, odd_sketch, similarity
from newsloom.llm.lookalikes import plain_key
from newsloom.tables import written

THRESHOLD, MIN_CHARS = 0.6, 8
#: Bands are so many that a pair this little over the threshold is missed with this probability.
MARGIN, MISS = 0.06, 0.005
#: Pairs compared at once in a shard.
CHUNK = 2_000_000
#: Packed entries of a shard, on average.
SHARD_BYTES = 8_000_000


def banding(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Rows per band and number of bands for n titles: more rows for larger tables, so that the pairs that meet by
    chance stay in proportion to n, and as many bands as keep recall where it is."""
    rows = 3 + max(0, ceil(log(max(n, 1) / 3e6, 100)))
    return rows, ceil(log(MISS) / log(1 - (threshold + MARGIN) ** rows))


def plain_keys(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """tbl, id, key of (tbl, id, title): titles in plain form, lower case, letters and digits only, one row per id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                key = plain_key(t)
                out.append(key if len(key) >= min_chars and not is_garbled(t) else None)
            k = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), k], ["tbl", "id", "key"]).filter(k.is_valid())

    rows = df.select("tbl", F.col("id").cast("long").alias("id"), "title").filter(f"id IS NOT NULL AND length(title) >= {min_chars}")
    keyed = rows.mapInArrow(keys, "tbl string, id long, key string").filter("tbl IS NOT NULL AND id IS NOT NULL")
    return keyed.groupBy("tbl", "id").agg(F.min("key").alias("key"))


def classes(keyed: DataFrame) -> DataFrame:
    """tbl, rep, member: every id with the key of a smaller one, and the smallest id of that key."""
    hashed = keyed.select("tbl", "id", F.xxhash64("key").alias("h"), F.hash("key").alias("h2"))
    groups = hashed.groupBy("tbl", "h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    return hashed.join(groups, ["tbl", "h", "h2"]).filter("id <> rep").select("tbl", "rep", F.col("id").alias("member"))


_ENTRY = np.dtype([("key", "<u4"), ("odd", "<u8"), ("n", "<u2")])
#: Titles with more grams than this carry the sketch of 128 bits, for 64 fill up; those with WIDE or more their count in
#: eight bytes.
LONG, WIDE = 36, 65535


def _pack(ids: np.ndarray, entries: np.ndarray, high: np.ndarray, counts: np.ndarray) -> bytes:
    """Entries in order of ids; ids as differences, byte plane by byte plane, for they compress; the sketches' second
    halves of long titles; counts that two bytes can't hold."""
    steps = np.diff(ids, prepend=ids[:1]).astype("<u8")
    wide = counts[entries["n"] == WIDE].astype("<u8")
    return b"".join([np.array([len(ids), ids[0]], "<i8").tobytes(), steps.view("u1").reshape(-1, 8).T.tobytes(), entries.tobytes(), wide.tobytes(), high[entries["n"] > LONG].tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, entries, second halves, counts."""
    n, first = np.frombuffer(blob, "<i8", 2)
    steps = np.frombuffer(blob, "u1", 8 * n, 16).reshape(8, n).T.copy().view("<u8").ravel()
    entries = np.frombuffer(blob, _ENTRY, n, 16 + 8 * n)
    counts, wide = entries["n"].astype("int64"), entries["n"] == WIDE
    at = 16 + (8 + _ENTRY.itemsize) * n
    counts[wide] = np.frombuffer(blob, "<u8", int(wide.sum()), at)
    high = np.zeros(n, "<u8")
    high[entries["n"] > LONG] = np.frombuffer(blob, "<u8", -1, at + 8 * int(wide.sum()))
    return first + np.cumsum(steps).astype("int64"), entries, high, counts


def band_entries(keyed: DataFrame, rows: int, bands: int, ranges: int) -> DataFrame:
    """shard, tbl, blob: the packed entries of each batch, band and key range."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tbl = np.array(b.column(0).to_pylist(), object)
            for t in np.unique(tbl):
                at = np.flatnonzero(tbl == t)
                ids = b.column(1).to_numpy()[at]
                at, ids = at[order := np.argsort(ids)], ids[order]
                g = grams_of(b.column(2).take(pa.array(at)).to_pylist())
                keys = band_keys(minhash(g, rows * bands), rows)
                rest = np.zeros(len(ids), _ENTRY)
                low, high = odd_sketch(g)
                rest["odd"], rest["n"] = low ^ high, np.minimum(g.counts, WIDE)
                shards, blobs = [], []
                for band, k in enumerate(keys):
                    rest["key"] = k
                    part = (k.astype("uint64") * np.uint64(ranges)) >> np.uint64(32)
                    for r in range(ranges):
                        if (own := part == r).any():
                            shards.append(band * ranges + r)
                            blobs.append(_pack(ids[own], rest[own], high[own], g.counts[own]))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([t] * len(shards)), pa.array(blobs, pa.binary())], ["shard", "tbl", "blob"])

    return keyed.mapInArrow(entries, "shard int, tbl string, blob binary")


def candidates(blobs: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller id, larger id) of the pairs of a shard that the sketches let pass."""
    parts = [_unpack(b) for b in blobs]
    ids, e, high, n = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.argsort(e["key"], kind="stable")
    ids, key, odd, n, high = ids[order], e["key"][order], e["odd"][order], n[order], high[order]
    left, step = np.arange(len(ids)), 1
    while len(left := left[left + step < len(ids)]) and len(left := left[key[left + step] == key[left]]):
        for lo in range(0, len(left), CHUNK):
            a = left[lo : lo + CHUNK]
            b = a + step
            both = n[a] + n[b]
            # similarity t of sets means that they differ in at most (1 - t) / (1 + t) of their sizes' sum
            most = both * ((1 - threshold) / (1 + threshold)) + 1e-9
            fits = (np.bitwise_count(odd[a] ^ odd[b]) <= most) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
            if (at := np.flatnonzero(fits & (n[a] > LONG) & (n[b] > LONG))).size:
                x, y = a[at], b[at]
                one = odd[x] ^ high[x] ^ odd[y] ^ high[y]  # the first halves' difference
                fits[at] = np.bitwise_count(one) + np.bitwise_count(high[x] ^ high[y]) <= most[at]
            if fits.any():
                x, y = ids[a[fits]], ids[b[fits]]
                yield np.minimum(x, y), np.maximum(x, y)
        step += 1


def like_links(reps: DataFrame, texts: DataFrame, n: int, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """tbl, a, b: verified links, a smaller than b, of (tbl, id, key) with different keys, each once.

    texts: rows of the same columns that hold those of reps; n: titles of the largest table, which the bands are laid out
    for; total: of all.
    """
    rows, bands = banding(n, threshold)
    ranges = max(1, ceil(total * (_ENTRY.itemsize + 3) / SHARD_BYTES))
    packed = band_entries(reps, rows, bands, ranges).repartitionById(bands * ranges, F.col("shard"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[bytes]] = {}  # a task has one shard
        for b in batches:
            for t, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own.setdefault(t, []).append(blob)
        for t in list(own):
            for a, b in candidates(own.pop(t), threshold):
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(a)), pa.array(a), pa.array(b)], ["tbl", "a", "b"])

    met = packed.mapInArrow(meet, "tbl string, a long, b long")
    # an exchange by a serves the removal of repeated pairs and the join
    pairs = met.repartition("tbl", "a").distinct()
    left = texts.select("tbl", F.col("id").alias("a"), F.col("key").alias("key_a"))
    right = texts.select("tbl", F.col("id").alias("b"), F.col("key").alias("key_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similarity(x, y) >= threshold for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield b.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(left, ["tbl", "a"]).join(right, ["tbl", "b"]).select("tbl", "a", "b", "key_a", "key_b")
    return joined.mapInArrow(verify, "tbl string, a long, b long")


def like_pairs(keyed: DataFrame, n: int, total: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """tbl, id_a, id_b: all pairs of ids with like titles, once, id_a smaller; the links of classes spread over their members."""
    copies = written(classes(keyed), "copies")
    # an outer join stays above the removal of redelivered rows, whose exchange the verification reads as well
    reps = keyed.join(copies.select("tbl", F.col("member").alias("id"), "rep"), ["tbl", "id"], "left").filter("rep IS NULL").drop("rep")
    across = written(like_links(reps, keyed, n, n if total is None else total, threshold), "like-links")

    def spread(df: DataFrame, col: str) -> DataFrame:
        """Each row also for the copies of the class in `col`."""
        more = copies.select("tbl", F.col("rep").alias(col), F.col("member").alias("_m"))
        return df.join(more, ["tbl", col]).withColumn(col, F.col("_m")).drop("_m").select(df.columns).unionByName(df)

    # members of one class: those that follow it in the order of ids pair with it
    inside = copies.select("tbl", F.col("rep").alias("a"), F.col("member").alias("b"))
    among = copies.alias("x").join(copies.alias("y"), (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.member") < F.col("y.member")))
    among = among.select("x.tbl", F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    out = spread(spread(across, "a"), "b").unionByName(inside).unionByName(among)
    return out.select("tbl", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
