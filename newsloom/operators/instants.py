"""Timestamps of mixed formats, precisions and zones as one UTC instant (problem 5).

Shapes: every value gets a character-class mask; each distinct mask is mapped to a parser once per worker and all its
values are read at once (`newsloom.functions.instants`). Wall times are converted by zone transition tables
(`newsloom.functions.zones`). Nothing is parsed row by row, and nothing but the rows' own columns enters the plan: the
sources' zones come by a join whose strategy Spark picks by the dimension's measured size.

Defined results: null, blank, relative, impossible and unknown forms give no row; digits of other alphabets count as
unknown; a null or unknown source or zone means the default zone, month first; a clock time needs a date column;
repeated rows give one row; input columns of any other name, or of the names used here, pass unharmed as they are never
selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.instants import compile_mask, parse_shape

DEFAULT_ZONE = "Asia/Shanghai"
NO_DAY = np.iinfo("int32").min


def to_utc_us(values: pa.Array, day: np.ndarray | None, zones: np.ndarray, day_first: np.ndarray, default_zone: str = DEFAULT_ZONE) -> pa.Array:
    """Microseconds since 1970 of a batch of values; null where a value denotes no instant."""
    trimmed = pc.utf8_trim_whitespace(values)
    masks = pc.replace_substring_regex(pc.replace_substring_regex(trimmed, "[0-9]", "0"), "[A-Za-z]", "a").dictionary_encode()
    code = masks.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out, good = np.zeros(len(values), "int64"), np.zeros(len(values), bool)
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(masks.dictionary) + 1))
    for k, mask in enumerate(masks.dictionary.to_pylist()):
        if mask and (shape := compile_mask(mask)):
            at = order[bounds[k] : bounds[k + 1]]
            own = trimmed.take(pa.array(at)).to_numpy(zero_copy_only=False)
            out[at], good[at] = parse_shape(shape, own, None if day is None else day[at], zones[at], day_first[at], default_zone)
    return pa.array(out, mask=~good)


def utc_instants(
    df: DataFrame, id_col: str, fields: list[str], sources: DataFrame, source_col: str, date_col: str | None = None, default_zone: str = DEFAULT_ZONE
) -> DataFrame:
    """row_id, field, utc_us: one row for each distinct instant of each value.

    sources: id, tz, day_first of the known sources. One exchange, by row id, removes redelivered rows; the fields of a
    row travel together.
    """
    dims = sources.select(F.col("id").alias("_source"), F.col("tz").alias("_tz"), F.col("day_first").alias("_first")).dropDuplicates(["_source"])
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        (F.unix_date(F.col(date_col).cast("date")) if date_col else F.lit(None).cast("int")).alias("_day"),
        *(F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)),
    ).filter(F.coalesce(*(F.col(f"_f{i}") for i in range(len(fields)))).isNotNull())
    rows = rows.join(dims, "_source", "left").select("_id", "_day", "_tz", "_first", *(f"_f{i}" for i in range(len(fields))))
    n, dated = len(fields), date_col is not None

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            day = b.column(1).fill_null(NO_DAY).to_numpy(zero_copy_only=False).astype("int64") if dated else None
            zones = b.column(2).to_numpy(zero_copy_only=False)
            first = b.column(3).fill_null(False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), *(to_utc_us(b.column(4 + i), day, zones, first, default_zone) for i in range(n))], ["_id", *(f"_u{i}" for i in range(n))])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    packed = rows.mapInArrow(convert, f"_id {kind}, " + ", ".join(f"_u{i} long" for i in range(n)))
    packed = packed.filter(F.coalesce(*(F.col(f"_u{i}") for i in range(n))).isNotNull()).repartition("_id")
    stacked = packed.select(F.col("_id").alias("row_id"), F.expr("stack({}, {}) AS (field, utc_us)".format(n, ", ".join(f"'{f}', _u{i}" for i, f in enumerate(fields)))))
    return stacked.filter("utc_us IS NOT NULL").dropDuplicates(["row_id", "field", "utc_us"])
