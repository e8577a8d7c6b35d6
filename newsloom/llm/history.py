"""New batches against everything accepted before (problem 3).

A title's fingerprint is a row of bits in blocks: block i holds the MinHash values of band i, and a parity bitmap of the
title's grams stands beside them; the address and the id are blocks of their own. The history keeps a table of blocks, in which a new
fingerprint finds every stored one that agrees with it in a block by exact look-up. What is found is verified by bit
difference (the bitmaps' Hamming distance never exceeds the difference of the gram sets) and then on the text. Blocks of
one MinHash band are used because one-bit fingerprints of 64 bits can't find titles as unlike as 0.6 in so few look-ups.
What the history holds is never fingerprinted again.

Storage: the history is a folder of segments, one per batch, merged MERGE at a time into larger ones, so that an entry is
rewritten as often as the logarithm of the number of batches. A segment's blocks are spread by word, and its texts by
what they are looked up by, over as many buckets (a power of two) as keep a bucket near BUCKET entries; a batch opens only
the buckets that its words (its found ids) fall into. Blocks travel and rest packed, some 15 bytes each, as arrays in the
order of their words; a batch's blocks are exchanged by ranges of words, meet there with the history's, and are stored by
the same pass. So a segment has the blocks of all entries of its batch, but texts of the accepted ones only, and nothing
is found by a block without a text. A batch is committed by one file, a new version of the list of segments, so a broken
session leaves nothing that a later one could see, and two sessions can't both commit the same version.

Within a batch, copies (equal titles) are one class and only its smallest id is fingerprinted; links come from the same
blocks. Then entries are taken in the order of their ids, in rounds instead of one by one: an entry that no undecided
smaller one could anticipate is accepted, and what shares its address or has a like title is a case. The rounds are as
many as the longest chain of entries that wait for each other.

At scale: a shard of words is compared as arrays; counted tables of a batch are broadcast if they are few (LOOKED_UP
rows), else exchanged. An address or a class of copies of any size is decided by its smallest
id, so a hot group needs one pre-aggregated minimum per round and no pairs; entries that share nothing are accepted
without a round.

Defined results: rows of one id are one entry (its smallest values by field); ids are null for no entry; null, empty and
relative addresses are no addresses; null, short and garbled titles are like none; what the history holds came before
the batch, whatever its ids; an id that the history holds is that entry, delivered again: no case, and not appended; an
empty batch or history gives no cases; columns of other names are never read.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.charsets import is_garbled
from newsloom.llm.grams import band_keys, grams_of, minhash, mix, odd_sketch, similarity
from newsloom.llm.like_titles import CHUNK, LONG, MIN_CHARS, THRESHOLD, banding
from newsloom.llm.lookalikes import plain_key
from newsloom.tables import files

#: Parameters of an address that tell stories apart.
KEPT_PARAMETERS = ("id", "aid", "docid")
#: Titles that the number of blocks is laid out for; a history keeps its layout.
LAYOUT = 3_000_000
#: Segments of a level that are merged, entries of a bucket at most on average, rows that may be broadcast.
MERGE, BUCKET, LOOKED_UP = 8, 10_000, 500_000
#: The blocks of the address and of the id itself.
ADDRESS, OWN = -1, -2
_BLOCKS, _TEXTS = "blob binary", "block int, ref long, id long, text string"
#: The form of the segments; folders of another form are refused.
FORM = 2
_PAIRS = "id long, first_id long, old boolean, block int"
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE = "\n\r\x85\u2028\u2029"
#: The end of a text, or of its last line.
_END = f"(?=(?:\\r\\n|[{_LINE}])?\\Z)"
_EDGES, _FRAGMENT, _SLASHES = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+\\Z"), re.compile(f"#[^{_LINE}]*{_END}"), re.compile(f"/+{_END}")
_ADDRESS = re.compile(f"([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?@]*@)?([^/?:]+)(?::([0-9]*))?([^?]*)(?:\\?([^{_LINE}]*))?{_END}")


def address_of(url: str | None) -> str | None:
    """What two addresses have in common if they are the same; None where there is none.

    Scheme, letter case and leading www. of the host, default port, trailing slash, fragment, order of parameters and
    parameters but KEPT_PARAMETERS don't count.
    """
    if url is None or not (m := _ADDRESS.match(_FRAGMENT.sub("", _EDGES.sub("", url)))):
        return None
    scheme, host, port, path, rest = m.groups("")
    if not (host := host.lower().removeprefix("www.")):
        return None
    port = "" if not port or (scheme.lower(), port) in (("http", "80"), ("https", "443")) else f":{port}"
    kept = sorted({p for p in re.split("[&;]", rest) if p.partition("=")[0] in KEPT_PARAMETERS}) if rest else ()
    return f"{host}{port}{_SLASHES.sub('', path)}?{'&'.join(kept)}"


def address_key(url: Column) -> Column:
    """`address_of` as a column function."""
    return F.udf(lambda u: address_of(u), "string")(url)


def prepared(batch: DataFrame) -> DataFrame:
    """id, address, key: one row per entry of (id, title, url), with the title in its plain form."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                key = plain_key(t) if t is not None and len(t) >= MIN_CHARS else ""
                out.append(key if len(key) >= MIN_CHARS and not is_garbled(t) else None)
            address = pa.array([address_of(u) for u in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), address, pa.array(out, pa.string())], ["id", "address", "key"])

    rows = batch.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), "title")
    return rows.mapInArrow(keys, "id long, address string, key string").groupBy("id").agg(F.min("address").alias("address"), F.min("key").alias("key"))


_HEAD = 4


def _pack(word: np.ndarray, ids: np.ndarray, odd: np.ndarray, high: np.ndarray, n: np.ndarray) -> bytes:
    """Blocks in the order of their words; differences of words, ids and counts byte plane by byte plane, for they
    compress; the bitmaps' second halves of long titles only."""
    planes = lambda x: x.view("u1").reshape(-1, x.itemsize).T.tobytes()
    head = np.array([len(ids), ids.min(), word[0], word[-1]], "<i8")
    steps = np.diff(word, prepend=word[:1]).astype("<u4")
    return b"".join([head.tobytes(), planes(steps), planes((ids - head[1]).astype("<u8")), planes(n.astype("<u4")), odd.astype("<u8").tobytes(), high[n > LONG].astype("<u8").tobytes()])


def _unpack(blob: bytes) -> list[np.ndarray]:
    """word, id, odd, high, n (odd: the bitmap of 64 bits, the XOR of the halves); high is 0 for titles that aren't long."""
    size, first, word, _ = np.frombuffer(blob, "<i8", _HEAD)
    at = 8 * _HEAD

    def column(kind: str, planes: bool = True) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        x = np.frombuffer(blob, "u1", width * size, at)
        at += width * size
        return (x.reshape(width, size).T.copy() if planes else x).view(kind).ravel()

    words, ids, n = np.uint32(word) + np.cumsum(column("<u4"), dtype="uint32"), column("<u8").astype("int64") + first, column("<u4")
    odd, high = column("<u8", False), np.zeros(size, "<u8")
    high[n > LONG] = np.frombuffer(blob, "<u8", -1, at)
    return [words, ids, odd, high, n.astype("int64")]


def _part_of(word: np.ndarray, parts: int) -> np.ndarray:
    """The range of words, of `parts` equal ones, that a word falls into."""
    return ((word.astype("uint64") * np.uint64(parts)) >> np.uint64(32)).astype("int64")


def _split(columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of blocks in the order of their words."""
    part = _part_of(columns[0], parts)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield int(part[lo]), _pack(*(c[lo:hi] for c in columns))


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The blocks of several blobs in the order of their words."""
    columns = [np.concatenate(c) for c in zip(*map(_unpack, blobs))]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _parts_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "blob"])


def fingerprints(entries: DataFrame, parts: int) -> DataFrame:
    """part, blob: the packed blocks of titles and addresses (of the smallest id with each) and of all ids, by ranges of words."""
    rows, bands = banding(LAYOUT)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            zeros = np.zeros(len(ids), "uint64")
            found = [((mix(ids.view("uint64")) >> np.uint64(32)).astype("uint32"), ids, ids.view("uint64"), zeros, zeros.astype("int64"))]
            if has := [(i, blake2b(a.encode("utf-8", "surrogatepass"), digest_size=12).digest()) for i, a in zip(ids.tolist(), b.column(1).to_pylist()) if a is not None]:
                hashed = np.frombuffer(b"".join(h for _, h in has), np.dtype([("word", "<u4"), ("odd", "<u8")]))
                found.append((hashed["word"], np.array([i for i, _ in has], "int64"), hashed["odd"], zeros[: len(has)], zeros[: len(has)].astype("int64")))
            if (titled := b.column(2).is_valid().to_numpy(zero_copy_only=False)).any():
                g = grams_of(b.column(2).filter(pa.array(titled)).to_pylist())
                words, (low, high) = band_keys(minhash(g, rows * bands), rows), odd_sketch(g)
                found.append((words.ravel(), *(np.tile(c, bands) for c in (ids[titled], low ^ high, high, g.counts))))
            columns = [np.concatenate(c) for c in zip(*found)]
            order = np.argsort(columns[0], kind="stable")
            yield _parts_batch([*_split([c[order] for c in columns], parts)])

    first = entries.select("id", F.when(F.col("id") == F.col("u"), F.col("address")).alias("address"), F.when(F.col("id") == F.col("t"), F.col("key")).alias("key"))
    return first.mapInArrow(blocks, "part int, blob binary")


def parted(blobs: DataFrame, parts: int) -> DataFrame:
    """part, blob: stored blobs by ranges of words; those that lie within a range pass as they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                ends = _part_of(np.frombuffer(blob, "<i8", 2, 16), parts)
                yield _parts_batch([(int(ends[0]), blob)] if ends[0] == ends[1] else [*_split(_unpack(blob), parts)])

    return blobs.mapInArrow(split, "part int, blob binary")


def meetings(new: list[np.ndarray], old: list[np.ndarray] | None) -> Iterator[tuple[np.ndarray, ...]]:
    """id, first_id, old, block of the blocks of a batch that agree in their word, and that the bitmaps let pass, with a
    smaller id's of the batch or with one of the history."""
    word, ids, odd, high, n = [np.concatenate(c) for c in zip(new, old)] if old else new
    held = np.arange(len(ids)) >= len(new[0])
    order = np.lexsort((held, word))  # the batch's come first, so each pair begins with one of them
    word, ids, odd, high, n, held = (c[order] for c in (word, ids, odd, high, n, held))
    left, step = np.flatnonzero(~held), 1
    while len(left := left[left + step < len(ids)]) and len(left := left[word[left + step] == word[left]]):
        for lo in range(0, len(left), CHUNK):
            a = left[lo : lo + CHUNK]
            b = a + step
            # similarity t of sets means that they differ in at most (1 - t) / (1 + t) of their sizes' sum
            most = (n[a] + n[b]) * ((1 - THRESHOLD) / (1 + THRESHOLD)) + 1e-9
            fits = (np.minimum(n[a], n[b]) >= THRESHOLD * np.maximum(n[a], n[b]) - 1e-9) & (np.bitwise_count(odd[a] ^ odd[b]) <= most)
            if (at := np.flatnonzero(fits & (n[a] > LONG) & (n[b] > LONG))).size:
                x, y = a[at], b[at]
                one = odd[x] ^ high[x] ^ odd[y] ^ high[y]  # the first halves' difference
                fits[at] = np.bitwise_count(one) + np.bitwise_count(high[x] ^ high[y]) <= most[at]
            a, b = a[fits], b[fits]
            block = np.where(n[a] > 0, 0, np.where(odd[a] == ids[a].view("uint64"), OWN, ADDRESS))
            yield np.where(held[b], ids[a], np.maximum(ids[a], ids[b])), np.where(held[b], ids[b], np.minimum(ids[a], ids[b])), held[b], block
        step += 1


def classed(entries: DataFrame) -> DataFrame:
    """Entries with t and u, the smallest ids with their title and with their address, and whether others have these."""
    out = entries
    for column, first, more in (("key", "t", "tc"), ("address", "u", "uc")):
        known = entries.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("id").alias(first), (F.count("*") > 1).alias(more))
        out = out.join(known, column, "left")
    return out.select("id", "address", "key", "t", "tc", "u", "uc")


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class _Work:
    """Written tables of one batch, deleted when it is done."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.rows = spark, path, 0

    def __call__(self, df: DataFrame, name: str, which: str = "true") -> DataFrame:
        """The rows by way of a written table; `rows` says how many of them `which` holds for."""
        path, seen = f"{self.path}/{name}-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count_if(F.expr(which)).alias("n")).write.parquet(path)
        self.rows = seen.get["n"]
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self) -> None:
        fs, where = files(self.spark, self.path)
        fs.delete(where, True)
        # else the batch's shuffle files stay until the driver happens to collect its garbage
        gc.collect()
        self.spark._jvm.System.gc()


def resolved(nodes: DataFrame, near: DataFrame, work: _Work) -> tuple[DataFrame, DataFrame]:
    """(accepted (id, u, t), cases (id, first_id)) of nodes (id, u, t: address and title, null where nothing else of the
    batch shares or resembles them), in the order of ids; near: (t, t2) of like titles, both ways."""
    accepted, rest = [], nodes
    both = lambda df: near.join(df, "t2").select("t", "i").unionByName(df.select(F.col("t2").alias("t"), "i"))
    while True:
        by_u = rest.filter("u IS NOT NULL").groupBy("u").agg(F.min("id").alias("_u"))
        by_t = both(rest.filter("t IS NOT NULL").groupBy(F.col("t").alias("t2")).agg(F.min("id").alias("i"))).groupBy("t").agg(F.min("i").alias("_t"))
        first = F.least(F.col("id"), F.coalesce("_u", "id"), F.coalesce("_t", "id"))
        now = work(rest.join(by_u, "u", "left").join(by_t, "t", "left").select("id", "u", "t", (F.col("id") == first).alias("_ok")), "round")
        if not work.rows:
            break
        taken = now.filter("_ok").select("id", "u", "t")
        accepted.append(taken)
        gone_u = taken.filter("u IS NOT NULL").select("u")
        gone_t = both(taken.filter("t IS NOT NULL").select(F.col("t").alias("t2"), F.col("id").alias("i"))).select("t")
        rest = now.filter("NOT _ok").select("id", "u", "t").join(gone_u, "u", "left_anti").join(gone_t, "t", "left_anti").select("id", "u", "t")
    kept = reduce(DataFrame.unionByName, accepted)
    # at most one entry of an address, and one of a class, is accepted
    cases = nodes.join(kept.select("id"), "id", "left_anti")
    by_u = cases.join(kept.filter("u IS NOT NULL").select("u", F.col("id").alias("i")), "u").select("id", "i")
    by_t = cases.join(both(kept.filter("t IS NOT NULL").select(F.col("t").alias("t2"), F.col("id").alias("i"))), "t").select("id", "i")
    return kept, by_u.unionByName(by_t).filter("i < id").groupBy("id").agg(F.min("i").alias("first_id"))


class History:
    """Accepted entries and their blocks in a folder; one opened on an existing folder goes on from it."""

    def __init__(self, spark: SparkSession, path: str, bucket: int = BUCKET, looked_up: int = LOOKED_UP) -> None:
        self.spark, self.path, self.bucket, self.looked_up = spark, path.rstrip("/"), bucket, looked_up
        versions = [0]
        fs, where = files(spark, f"{self.path}/versions")
        if fs.exists(where):
            versions += [int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()]
        self.version = max(versions)
        #: Segments: name, level, number of entries, buckets.
        self.segments: list[dict] = json.loads(self._read(self.version)) if self.version else []
        if any(s.get("form") != FORM for s in self.segments):
            raise ValueError(f"{self.path} holds segments of another form")

    def _read(self, version: int) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).collect())

    def _commit(self, segments: list[dict]) -> None:
        """A new version, visible at once and whole; raises if another session has committed it."""
        fs, to = files(self.spark, f"{self.path}/versions/{self.version + 1}")
        _, draft = files(self.spark, f"{self.path}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(segments).encode())
        out.close()
        fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(draft, to):
            raise RuntimeError("another session has committed to this history")
        self.version, self.segments = self.version + 1, segments

    def _part(self, kind: str, segments: list[dict], touched: dict[int, list[int]] | None = None) -> DataFrame:
        """Rows of a kind of table (blocks, texts) of segments, of the touched buckets (by a segment's number of buckets)."""
        paths = []
        for s in segments:
            whole, opened = f"{self.path}/{s['name']}/kind={kind}", (touched or {}).get(s["buckets"])
            paths += [whole] if opened is None else [f"{whole}/bucket={k}" for k in opened]
        paths = [p for p in paths if (at := files(self.spark, p))[0].exists(at[1])]
        schema = {"blocks": _BLOCKS, "texts": _TEXTS, "pairs": _PAIRS}[kind]
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, rows: DataFrame, column: str) -> dict[int, list[int]]:
        """The buckets of texts that looked-up values fall into, for each number of buckets that segments have."""
        sizes = sorted({s["buckets"] for s in self.segments if s["buckets"] > 1})
        if not sizes:
            return {}
        seen = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _bucket(n, column).alias("k")) for n in sizes))).alias("b")).select("b.*").distinct()
        out: dict[int, list[int]] = {n: [] for n in sizes}
        for r in seen.collect():
            out[r["n"]].append(r["k"])
        return out

    def _ranges(self, entries: DataFrame, n: int) -> dict[int, list[int]]:
        """The buckets of blocks that the words of n entries fall into; nothing if these are so many that all are touched."""
        sizes = {s["buckets"] for s in self.segments}
        if not sizes or n > max(sizes):
            return {}
        top = max(sizes)
        seen = [r[0] for r in fingerprints(entries, top).select("part").distinct().collect()]
        return {k: sorted({p * k // top for p in seen}) for k in sizes}

    def _buckets(self, n: int) -> int:
        return 1 << max(0, -(-n // self.bucket) - 1).bit_length()

    def _write(self, blobs: DataFrame, name: str, buckets: int, pairs: bool) -> None:
        """The blocks of a segment: part, old, blob by part; with `pairs`, also those of the new ones' meetings, without storing
        the old ones again."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: dict[int, tuple[list[bytes], list[bytes]]] = {}  # a task has one part
            for b in batches:
                for p, old, blob in zip(*(b.column(c).to_pylist() for c in range(3))):
                    got.setdefault(p, ([], []))[old].append(blob)
            schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("first_id", pa.int64()), ("old", pa.bool_()), ("block", pa.int32())])
            rows = lambda kind, p, columns: pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[1]), pa.string()), pa.array([p] * len(columns[1]), pa.int32()), *(pa.array(c, t.type) for c, t in zip(columns, list(schema)[2:]))], schema=schema)
            for p in list(got):
                new, old = got.pop(p)
                if new:
                    columns = _joined(new)
                    yield rows("blocks", p, [[_pack(*columns)], *([None],) * 4])
                    if pairs:
                        for x in meetings(columns, _joined(old) if old else None):
                            if len(x[0]):
                                yield rows("pairs", 0, [[None] * len(x[0]), *x])

        out = blobs.repartitionById(buckets, F.col("part")).mapInArrow(meet, f"kind string, bucket int, {_BLOCKS}, {_PAIRS}")
        out.write.partitionBy("kind", "bucket").parquet(f"{self.path}/{name}")

    def _write_texts(self, rows: DataFrame, name: str, buckets: int) -> None:
        spread = rows.withColumn("bucket", _bucket(buckets, "ref")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block", "ref")
        spread.write.partitionBy("bucket").parquet(f"{self.path}/{name}/kind=texts")

    def _dropped(self, name: str) -> None:
        fs, where = files(self.spark, f"{self.path}/{name}")
        fs.delete(where, True)

    def _merged(self, segments: list[dict]) -> tuple[list[dict], list[dict]]:
        """(segments, replaced): while MERGE segments are of one level, they become one of the next."""
        gone: list[dict] = []
        while full := next((own for v in sorted({s["level"] for s in segments}) if len(own := [s for s in segments if s["level"] == v]) >= MERGE), None):
            n = sum(s["rows"] for s in full)
            one = {"name": f"segment-{uuid.uuid4().hex}", "level": full[0]["level"] + 1, "rows": n, "buckets": self._buckets(n), "form": FORM}
            self._write(parted(self._part("blocks", full), one["buckets"]).select("part", F.lit(False).alias("old"), "blob"), one["name"], one["buckets"], False)
            self._write_texts(self._part("texts", full), one["name"], one["buckets"])
            segments = [*(s for s in segments if s not in full), one]
            gone += full
        return segments, gone

    def _small(self, df: DataFrame, n: int) -> DataFrame:
        """A table of n rows, broadcast if these are few."""
        return F.broadcast(df) if n <= self.looked_up else df

    def _links(self, entries: DataFrame, n: int, segment: dict, work: _Work) -> DataFrame:
        """id, first_id, old, block: what agrees in the address or the id or has a like title, by look-up, bit difference and
        text; first_id is of the history (old), or a smaller one of the batch's titles. Writes the blocks of the segment."""
        buckets = segment["buckets"]
        blobs = fingerprints(entries, buckets).select("part", F.lit(False).alias("old"), "blob")
        if self.segments:
            held = self._part("blocks", self.segments, self._ranges(entries, n))
            blobs = blobs.unionByName(parted(held, buckets).select("part", F.lit(True).alias("old"), "blob"))
        self._write(blobs, segment["name"], buckets, True)
        near = work(self._part("pairs", [segment], {buckets: [0]}).distinct(), "agree")
        if not work.rows:
            return near
        text = lambda block: F.when(block == ADDRESS, F.col("address")).when(block == 0, F.col("key"))
        pairs = self._small(self._small(near, work.rows).join(entries.select("id", "address", "key"), "id").select("id", "first_id", "old", "block", text(F.col("block")).alias("q")), work.rows)
        known = entries.filter("id = t").select(F.lit(0).alias("block"), F.col("id").alias("ref"), "id", F.col("key").alias("text"), F.lit(False).alias("old"))
        if self.segments:
            held = self._part("texts", self.segments, self._touched(near.filter("old"), "first_id"))
            known = known.unionByName(held.withColumn("old", F.lit(True)))
        met = known.select("block", F.col("ref").alias("first_id"), "old", F.col("id").alias("i"), F.col("text").alias("p")).join(pairs, ["block", "first_id", "old"])
        met = met.select("id", F.col("i").alias("first_id"), "old", "block", "p", "q")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = [k == OWN or (p == q if k == ADDRESS else similarity(p, q) >= THRESHOLD) for k, p, q in zip(*(b.column(c).to_pylist() for c in (3, 4, 5)))]
                yield b.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

        return work(met.mapInArrow(verify, "id long, first_id long, old boolean, block int"), "links")

    def accept(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """first_id, entry_id: the cases of a batch of (id, title, url). The others join the history if `keep`."""
        work = _Work(self.spark, f"{self.path}/work-{uuid.uuid4().hex}")
        entries = work(classed(work(prepared(batch), "entries")), "classed")
        segment = {"name": f"segment-{uuid.uuid4().hex}", "level": 0, "rows": 0, "buckets": self._buckets(work.rows), "form": FORM}
        links = self._links(entries, work.rows, segment, work)
        n = work.rows
        # what is known of a title, an address and an id by their smallest ids
        old = lambda block: links.filter(F.col("old") & (F.col("block") == block)).select("id", "first_id")
        within = links.filter("NOT old").select(F.col("first_id").alias("t"), F.col("id").alias("t2"))
        near = within.unionByName(within.select(F.col("t2").alias("t"), F.col("t").alias("t2")))
        title = old(0).select(F.col("id").alias("t"), F.col("first_id").alias("_t"), F.lit(False).alias("_l")).unionByName(near.select("t", F.lit(None).cast("long").alias("_t"), F.lit(True).alias("_l")))
        title = title.groupBy("t").agg(F.min("_t").alias("_t"), F.max("_l").alias("_l"))
        address = old(ADDRESS).groupBy(F.col("id").alias("u")).agg(F.min("first_id").alias("_u"))
        own = old(OWN).select("id", F.lit(True).alias("held")).distinct()
        marked = entries.join(self._small(title, n), "t", "left").join(self._small(address, n), "u", "left").join(self._small(own, n), "id", "left")
        marked = marked.select("id", "t", "u", F.coalesce("held", F.lit(False)).alias("held"), F.least("_t", "_u").alias("first_id"), F.when(F.col("uc"), F.col("u")).alias("mu"), F.when(F.col("tc") | F.col("_l"), F.col("t")).alias("mt"))
        marked = marked.withColumn("open", F.expr("NOT held AND first_id IS NULL AND (mu IS NOT NULL OR mt IS NOT NULL)"))
        marked = work(marked, "marked", "open")
        if work.rows:
            nodes = marked.filter("open").select("id", F.col("mu").alias("u"), F.col("mt").alias("t"))
            cases = resolved(nodes, near, work)[1]
            marked = marked.join(cases.withColumnRenamed("first_id", "_f"), "id", "left").withColumn("first_id", F.coalesce("first_id", "_f"))
        marked = work(marked.select("id", "t", "u", "held", "first_id"), "decided", "NOT held AND first_id IS NULL")
        cases, fresh = marked.filter("NOT held AND first_id IS NOT NULL"), work.rows
        path = f"{self.path}/decided-{uuid.uuid4().hex}"
        cases.select("first_id", F.col("id").alias("entry_id")).write.parquet(path)
        self._dropped(f"{segment['name']}/kind=pairs")
        if keep and fresh:
            texts = marked.filter("NOT held AND first_id IS NULL").select("id").join(entries, "id")
            kinds = ((0, "t", "key"), (ADDRESS, "u", "address"), (OWN, "id", None))
            kinds = F.array(*(F.struct(F.lit(k).alias("block"), F.col(r).alias("ref"), (F.col(x) if x else F.lit(None).cast("string")).alias("text")) for k, r, x in kinds))
            texts = texts.select("id", F.explode(kinds).alias("k")).select("k.block", "k.ref", "id", "k.text").filter("ref IS NOT NULL")
            segment["rows"] = fresh
            self._write_texts(texts, segment["name"], segment["buckets"])
            segments, gone = self._merged([*self.segments, segment])
            self._commit(segments)
            for s in gone:
                self._dropped(s["name"])
        else:
            self._dropped(segment["name"])
        work.done()
        return self.spark.read.schema("first_id long, entry_id long").parquet(path)
