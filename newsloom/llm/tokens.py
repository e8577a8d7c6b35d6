"""Token ids of every text of a table by a public tokenizer (problem 8).

The tokenizer's file is a parameter that every executor reads; nothing of it is in the repository. Texts are encoded in
Arrow batches by `bpe.Bpe`, with no exchange: one scan of two columns. A worker keeps the pieces it has met, up to a
number of them, so that common words are merged once.

Defined results: null and empty texts have no ids; blank texts and strings of special tokens are ordinary text; a text
of any length is encoded whole; repeated rows stay, each with its ids; of other columns only the named ones are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import encoder

VOCABULARY = os.path.join(os.environ.get("NEWSLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Characters of text that are encoded at once.
CHARS = 4_000_000


def _encoded(column: pa.Array, vocabulary: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, ids, offsets) of slices of a column of texts."""
    texts, at = column.to_pylist(), 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
            chars += len(texts[to] or "")
            to += 1
        yield at, to, *encoder(vocabulary).encode(texts[at:to])
        at = to


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The id column and ids, a list of integers, of each row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, ids, ends in _encoded(b.column(1), vocabulary):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], [id_col, "ids"])

    rows = df.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInArrow(encode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The id column and n, the number of tokens, of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, ends in _encoded(b.column(1), vocabulary):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(ends))], [id_col, "n"])

    rows = df.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInArrow(count, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n long")
