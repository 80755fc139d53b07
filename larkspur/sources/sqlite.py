"""Tables of database files of the embedded engine, as a Spark data source (format ``dbfile``).

Rows are read in ranges of the row id, one task each.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..types import spark_type


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class DbFile(DataSource):
    """Options: path, table, partitions (default 1)."""

    @classmethod
    def name(cls) -> str:
        return "dbfile"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no such table: {self.options['table']}")
        return StructType([StructField(c[1], spark_type(c[2])) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.n, self.schema = options["path"], options["table"], int(options.get("partitions", "1")), schema

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.n)
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        makes = [{LongType: int, DoubleType: float, StringType: str, BinaryType: bytes}.get(type(f.dataType), str) for f in self.schema.fields]
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(None if v is None else make(v) for v, make in zip(row, makes, strict=True))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbFile)
