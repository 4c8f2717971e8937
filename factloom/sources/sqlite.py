"""Tables of a SQLite file as a Spark source, read in ranges of row numbers.

The file lies where driver and executors can open it by the same path, and isn't written meanwhile.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 100_000  # of a partition
#: The stored tables and their columns.
HISTORY = {
    "research_history": "id string, query string, status string, strategy string, report string, error string, created_at string, updated_at string, completed_at string",
    "research_logs": "id long, research_id string, level string, message string, progress long, created_at string",
    "sources": "id long, research_id string, title string, url string, snippet string, engine string, created_at string",
}


def _open(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class Rows(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.kinds = schema.names, [f.dataType.typeName() for f in schema]
        self.path, self.table, self.rows = options["path"].removeprefix("file:"), options["table"], int(options.get("rows", ROWS))

    def partitions(self) -> list[Range]:
        with _open(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if low is None else [Range(at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if k == "long" else pa.string() for k in self.kinds]
        if partition is None or partition.value is None:
            return
        columns = ", ".join(f'"{n}"' for n in self.names)
        with _open(self.path) as con:
            found = con.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', partition.value)
            while rows := found.fetchmany(5_000):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], self.names)


class SqliteTable(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("table", ...).load(path)``; columns are texts and whole numbers."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> Rows:
        return Rows(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    """One of the stored tables of a history."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").schema(HISTORY[table]).option("table", table).option("rows", str(rows)).load(path)
