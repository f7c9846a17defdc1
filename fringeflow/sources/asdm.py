"""Archive tables kept as XML, one file a table and one `row` element a row: reader, registry, summary and writer."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: tables that a summary reads, and the columns that name their rows
REGISTRY = {
    "Main": ("time", "scanNumber"), "Antenna": ("antennaId",), "ExecBlock": ("execBlockId",), "Field": ("fieldId",), "Scan": ("scanNumber",), "SpectralWindow": ("spectralWindowId",), "Station": ("stationId",), "Subscan": ("scanNumber", "subscanNumber"),
}


def read(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the archive folder. Without a schema the column types are told from the data."""
    if name not in REGISTRY:
        raise ValueError(f"{name!r} is no archive table")
    reader = spark.read.format("xml").option("rowTag", "row")
    return (reader.schema(schema) if schema else reader).load(f"{path}/{name}.xml")


def write(df: DataFrame, path: str, name: str, order: list[str] | None = None) -> None:
    """Writes a table as XML, sorted by some columns; its files hold runs of that order."""
    if name not in REGISTRY:
        raise ValueError(f"{name!r} is no archive table")
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").format("xml").option("rowTag", "row").option("rootTag", f"{name}Table").save(f"{path}/{name}.xml")


def summary(main: DataFrame, time_col: str, keys: list[str]) -> DataFrame:
    """Rows, first and last time of each block or scan."""
    return main.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(time_col).alias("start"), F.max(time_col).alias("stop"))


def document(name: str, rows: Iterator[dict]) -> str:
    """A small table as one XML document."""
    body = "".join("<row>" + "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in r.items() if v is not None) + "</row>" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><{name}Table>{body}</{name}Table>'
