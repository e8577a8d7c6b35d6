"""Finding text that was decoded with a wrong encoding, and restoring it (problem 6).

Garbled records are joined with clean near-twins on text stripped of non-ASCII characters. Two texts with the same ASCII
characters are aligned run by run, the ASCII runs being the anchors. Two kinds of transformations are learned from what
stands between the same anchors:

- Pairs of encodings (`charsets.CHAINS`): each aligned run that a pair turns into a run of a clean twin is a vote for it.
  Twins share the whole skeleton, or only the kinds of a run's two anchors. Pairs with SUPPORT votes are learned.
- Tables of bytes, for encodings that nobody listed: where a run has as many characters as another between the same
  anchors has bytes of UTF-8, each character votes for the byte at its place. A character's byte is learned if it has
  SUPPORT votes and is SURE of them, and if the character stands nearly only in such places (MET); a table that codecs of
  the standard library agree with is completed by what these have in common.

The learned transformations are applied to all records, whether they have twins or not.

At scale: votes are counted by joins of hashes (a run's, or a place's in the runs between the same anchors), after both
sides are aggregated, so no pairs of texts arise, and nothing that a third of all rows share costs more than another.
Only votes reach the driver: a row per pair of encodings, and at most 256 rows per character that is learned.

Defined results: null, empty and ASCII texts are never garbled; accents, Cyrillic, Greek and Chinese text as such aren't
either; a text garbled in part counts, its other parts stay; text with lost characters gives '' instead of the original;
a transformation that no twins bear out isn't applied; repeated rows give one row; texts of any length are read whole;
columns of other names are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.charsets import CHAINS, REPLACED_AS_GBK, REPLACEMENT, completed, explanations, is_lost, undone_by
from newsloom.tables import written

#: Length from which a skeleton tells a text from others; votes that a transformation takes, and the share of a
#: character's votes that its byte takes.
SKELETON, SUPPORT, SURE = 8, 2, 0.8
#: Share of a character's places that must face bytes: an ordinary character stands elsewhere as well.
MET = 0.5
_ASCII_RUN = regex.compile(r"[\x21-\x7e]+")
_SHAPES = regex.compile(r"[0-9]+|[A-Za-z]+")


def suspects(texts: DataFrame) -> DataFrame:
    """row_id, field, text, garbled: whether a text is lost or a pair of encodings explains it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = pa.array([is_lost(t) or bool(explanations(t)) for t in b.column(2).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, bad], [*b.schema.names, "garbled"])

    kind = texts.schema["row_id"].dataType.simpleString()
    return texts.mapInArrow(find, f"row_id {kind}, field string, text string, garbled boolean")


def _shape(ascii_run: str) -> str:
    """The kind of an anchor: digits as 0, letters as a."""
    return _SHAPES.sub(lambda m: "0" if m[0][0].isdigit() else "a", ascii_run)


def runs(text: str) -> set[str]:
    """The runs between ASCII runs, each with the kinds of its anchors, and with its place in the text's skeleton."""
    ends = [m.span() for m in _ASCII_RUN.finditer(text)]
    words = [text[a:b] for a, b in ends]
    kinds, skeleton = ["", *map(_shape, words), ""], "\n".join(words)
    out, at = set(), 0
    for k, (a, b) in enumerate([*ends, (len(text), len(text))]):
        if not (run := text[at:a].strip()).isascii():
            out.add(f"{kinds[k][-1:]}{run}{kinds[k + 1][:1]}")
            if len(skeleton) >= SKELETON:
                out.add(f"{skeleton}\n{k}\n{run}")
        at = b
    return out


def _undone(text: str) -> list[tuple[str, str]]:
    own = runs(text)
    return [(name, r) for name, back in explanations(text).items() for r in runs(back) - own]


def _exploded(texts: DataFrame, names: list[str], of, once: bool = False) -> DataFrame:  # type: ignore[no-untyped-def]
    """String rows of each text; once: repeated rows of a batch may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(dict.fromkeys(r for t in b.column(0).to_pylist() for r in of(t)) if once else (r for t in b.column(0).to_pylist() for r in of(t)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)

    return texts.select("text").mapInArrow(run, ", ".join(f"{c} string" for c in names))


def votes(garbled: DataFrame, clean: DataFrame) -> DataFrame:
    """chain, votes: runs that a pair of encodings turns into runs of clean texts between the same anchors."""
    ours = _exploded(garbled, ["chain", "run"], _undone).select("chain", F.xxhash64("run").alias("h"))
    theirs = _exploded(clean, ["run"], lambda t: [(r,) for r in runs(t)], once=True).select(F.xxhash64("run").alias("h")).distinct()
    return ours.groupBy("chain", "h").agg(F.count("*").alias("n")).join(theirs, "h", "left_semi").groupBy("chain").agg(F.sum("n").alias("votes"))


def learned(garbled: DataFrame, clean: DataFrame) -> list[str]:
    """The pairs of encodings to apply, best borne out first."""
    order = {name: i for i, name in enumerate(CHAINS)}
    rows = [r for r in votes(garbled, clean).collect() if r["votes"] >= SUPPORT]
    return [r["chain"] for r in sorted(rows, key=lambda r: (-r["votes"], order[r["chain"]]))]


def byte_votes(texts: DataFrame) -> DataFrame:
    """code, byte, n, r, met: how often a character stands where a run between the same anchors has a byte of UTF-8, one of the
    runs that it stands in, and the share of its places, in texts that share their skeletons, that have such bytes at all."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, codes, sides, whole = [], [], [], [], []
            for t in b.column(0).to_pylist():
                words = _ASCII_RUN.findall(t)
                skeleton = "\n".join(words)
                if len(skeleton) < SKELETON:
                    continue
                for k, run in enumerate(_ASCII_RUN.split(t)):
                    run = run.strip()
                    if not run or any(c < "\x80" for c in run):
                        continue
                    raw = run.encode("utf-8", "surrogatepass")
                    for side, values in ((0, list(map(ord, run))), (1, raw)):
                        keys += [f"{skeleton}\n{k}\n{len(values)}"] * len(values)
                        places += range(len(values))
                        codes += values
                        sides += [side] * len(values)
                        whole += [run] * len(values)
            columns = [pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(codes, pa.int32()), pa.array(sides, pa.int32()), pa.array(whole, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "code", "side", "run"])

    # only skeletons that several different texts have can align
    skeleton = F.regexp_replace(F.regexp_replace("text", r"[^\x21-\x7e]+", "\n"), r"^\n|\n$", "")
    keyed = texts.select("text").distinct().withColumn("_h", F.when(F.length(skeleton) >= SKELETON, F.xxhash64(skeleton))).filter("_h IS NOT NULL")
    shared = keyed.groupBy("_h").agg(F.count("*").alias("_c")).filter("_c > 1").select("_h")
    seen = keyed.join(shared, "_h", "left_semi").select("text").mapInArrow(places, "key string, place int, code int, side int, run string")
    seen = seen.select(F.xxhash64("key", "place").alias("h"), "code", "side", F.xxhash64("run").alias("r")).groupBy("h", "code", "side").agg(F.count("*").alias("n"), F.min("r").alias("r"))
    ours, theirs = seen.filter("side = 0").select("h", "code", "n", "r"), seen.filter("side = 1").select("h", F.col("code").alias("byte"), F.col("n").alias("m"))
    met = ours.join(theirs.select("h", F.lit(1).alias("_t")).distinct(), "h", "left").groupBy("code").agg((F.sum(F.when(F.col("_t") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("met"))
    return ours.join(theirs, "h").groupBy("code", "byte").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.min("r").alias("r")).join(met, "code")


def learned_table(texts: DataFrame) -> dict[int, int]:
    """Characters to bytes, learned from twins; completed by the codec that has them."""
    best = byte_votes(texts).groupBy("code").agg(F.max_by("byte", F.struct("n", "byte")).alias("byte"), F.max("n").alias("n"), F.sum("n").alias("all"), F.min("r").alias("r"), F.max("met").alias("met"))
    rows = best.filter((F.col("n") >= SUPPORT) & (F.col("n") >= SURE * F.col("all")) & (F.col("met") >= MET)).collect()
    table = {r["code"]: r["byte"] for r in rows}
    # one phrase that often stands where others have an emoji is no encoding
    if len({r["r"] for r in rows}) <= SUPPORT:
        return {}
    # a table of UTF-8 has bytes that begin a character and bytes that go on
    if not any(b >= 0xC2 for b in table.values()) or not any(b < 0xC0 for b in table.values()):
        return {}
    return completed(table)


def restore(text: str, chains: list[str], table: tuple[tuple[int, int], ...] = ()) -> str | None:
    """The original of a garbled text, '' if characters are lost, None if no transformation applies."""
    if REPLACEMENT in text or REPLACED_AS_GBK in text:
        return ""
    for name in chains:
        if (back := CHAINS[name](text)) != text:
            return "" if is_lost(back) else back
    if table and (back := undone_by(table, text)) != text:
        return "" if is_lost(back) else back
    return "" if is_lost(text) else None


def restored(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """row_id, field, restored: every garbled value of the fields with its original, '' where that is lost."""
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    texts = df.select(F.col(id_col).alias("row_id"), F.expr(f"stack({len(fields)}, {stack}) AS (field, text)")).filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    marked = written(suspects(texts).dropDuplicates(["row_id", "field", "text"]), "garbled")
    garbled, others = marked.filter("garbled"), marked.filter("NOT garbled")
    chains = learned(garbled, others)
    table = tuple(learned_table(others).items())

    @F.pandas_udf("string")
    def undo(column):  # type: ignore[no-untyped-def]
        return column.map(lambda t: restore(t, chains, table))

    found = garbled.select("row_id", "field", undo("text").alias("restored"))
    if table:
        found = found.unionByName(others.select("row_id", "field", undo("text").alias("restored")))
    return found.filter("restored IS NOT NULL").dropDuplicates()
