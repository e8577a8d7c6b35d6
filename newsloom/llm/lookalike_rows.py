"""Rows whose text is written with look-alike or invisible characters (problem 4).

A pattern on the JVM passes only rows that have a character outside ASCII, unified ideographs and Chinese signs on to the
transducer (`lookalikes.fold`), which runs in Arrow batches. No exchange but the one that removes redelivered rows, over
the cases alone.

Defined results: null, empty and ordinary texts are no cases; a text of any length is read whole; garbled text is no case
and stays as it is; repeated rows give one row; ids may repeat with different texts, one case suffices; other columns
are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.charsets import is_garbled
from newsloom.llm.lookalikes import fold

#: A character that the transducer may change.
ODD = r"[^ -~\x{4e00}-\x{9fff}，。、；：！？（）【】《》“”｜·…—]"


def odd_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, form: rows whose text has stand-in or invisible characters, and its consistent form."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(ODD))

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms: list[str | None] = []
            for t in b.column(1).to_pylist():
                form, case = fold(t)
                forms.append(form if case and not is_garbled(t) else None)
            out = pa.array(forms, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["row_id", "form"]).filter(out.is_valid())

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(cases, f"row_id {kind}, form string").dropDuplicates(["row_id"])


def consistent(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """The rows with a further column: the text in its consistent form (null for null, garbled text unchanged).

    The column must not exist yet; ordinary texts never leave the JVM's side of the batch unchanged.
    """
    if out_col in df.columns:
        raise ValueError(f"column {out_col} exists")

    @F.pandas_udf("string")
    def form(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: t if t is None or is_garbled(t) else fold(t)[0])

    odd = F.col(text_col).rlike(ODD)
    return df.withColumn(out_col, F.when(odd, form(F.when(odd, F.col(text_col)))).otherwise(F.col(text_col)))
