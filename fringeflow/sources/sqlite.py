"""SQLite tables. read() takes database files from any store that Spark reads, one task a file, held in its memory.

The Python data source `spark.read.format("sqlitetable").option("path", p).option("table", t).load()` reads one file by
ranges of row ids, a task each; that file has to be on a path that all executors see.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read(spark: SparkSession, paths: str | list[str], table: str, schema: str, batch: int = 50_000) -> DataFrame:
    """The columns of the schema of a table of each database file."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["content"]:
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(bytes(raw))
                    found = db.execute(f"SELECT {', '.join(map(_quoted, columns))} FROM {_quoted(table)}")
                    while rows := found.fetchmany(batch):
                        yield pd.DataFrame(rows, columns=columns)
                finally:
                    db.close()

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, schema)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], slices: int):
        self.path, self.table, self.columns, self.slices = path, table, columns, slices

    def partitions(self):
        with _open(self.path) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        step = max(1, -(-(hi - lo + 1) // self.slices))
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        names = ", ".join(map(_quoted, self.columns))
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))


class SqliteTable(DataSource):
    @classmethod
    def name(cls):
        return "sqlitetable"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        return [(c[1], next((k for part, k in KINDS.items() if part in c[2].upper()), "string")) for c in found]

    def schema(self):
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema], int(self.options.get("slices", "8")))
