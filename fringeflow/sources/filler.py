"""Fillers: a reader of some foreign format, cut into parts, as a table.

A format is a class with `schema` (a DDL string), `parts(options)` and `rows(part, options)`. filled() reads the parts on
the executors, one task a part; register_format() makes it a data source of the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Format(Protocol):
    schema: str

    def parts(self, options: dict) -> list[Any]: ...

    def rows(self, part: Any, options: dict) -> Iterator[tuple]: ...


class _Part(InputPartition):
    def __init__(self, value: Any):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, form: Format, options: dict):
        self.form, self.options = form, options

    def partitions(self):
        return [_Part(p) for p in self.form.parts(self.options)]

    def read(self, partition):
        yield from self.form.rows(partition.value, self.options)


def register_format(spark: SparkSession, name: str, form: Format) -> None:
    """After this `spark.read.format(name)` reads it."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return form.schema

        def reader(self, schema):
            return _Reader(form, dict(self.options))

    spark.dataSource.register(Source)


def filled(spark: SparkSession, form: Format, options: dict, batch: int = 10_000) -> DataFrame:
    """The rows of all parts, in batches of bounded size."""
    names = [c.strip().split()[0] for c in form.schema.split(",")]
    parts = form.parts(options)
    ids = spark.range(0, len(parts), 1, max(1, len(parts)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                held: list[tuple] = []
                for row in form.rows(parts[i], options):
                    held.append(row)
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return ids.mapInPandas(run, form.schema)
