"""SQLite files as a Spark source: one file is one partition of the input and is read by one task.

    spark.dataSource.register(SqliteDataSource)
    spark.read.format("sqlite").option("path", "/data/news/*.db").option("table", "news_items").schema(...).load()

The column `_file` (if the schema has it) gets the file's stem, which names the date of a snapshot. A file that is
missing, empty or no SQLite database, or that lacks the table, gives no rows; columns that a file lacks are null. Files
are opened read-only. Column names of the schema are quoted, the table's name must be an identifier.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterator
from datetime import date

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DateType, StructType

#: Fixed value: the first bytes of a SQLite file.
MAGIC = b"SQLite format 3\x00"


def is_database(path: str) -> bool:
    """Whether a file begins as a SQLite database does."""
    try:
        with open(path, "rb") as f:
            return f.read(len(MAGIC)) == MAGIC
    except OSError:
        return False


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str) -> None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
            raise ValueError(f"not a table name: {table}")
        self.schema, self.path, self.table = schema, path, table

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(self.path))] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path  # type: ignore[attr-defined]
        if not is_database(path):
            return
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            has = {r[1] for r in con.execute(f"PRAGMA table_info({self.table})")}
            if not has:
                return
            stem = os.path.splitext(os.path.basename(path))[0]
            names = [f.name for f in self.schema]
            columns = ", ".join('"' + n.replace('"', '""') + '"' if n in has else "NULL" for n in names)
            for row in con.execute(f"SELECT {columns} FROM {self.table}"):
                out = [stem if n == "_file" else v for n, v in zip(names, row)]
                yield tuple(date.fromisoformat(v) if isinstance(f.dataType, DateType) and isinstance(v, str) else v for f, v in zip(self.schema, out))
        except sqlite3.DatabaseError:
            return  # a damaged file gives what was read
        finally:
            con.close()


class SqliteDataSource(DataSource):
    """Options: path (a glob pattern), table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.options["table"])
