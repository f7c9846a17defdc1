"""How the engine's concepts sit on the driver's tables, in Spark and as SQL fragments for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# events: a row is a sample; user_id the antenna, k the second one, event_type the spectral window
VIS = """(SELECT event_id AS row_id, epoch_us(ts) AS tick, epoch_us(ts) / 1000000.0::DOUBLE AS t, user_id AS ant, event_type AS spw, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def vis(spark: SparkSession, d: str) -> DataFrame:
    tick = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("row_id"), tick.alias("tick"), (tick / F.lit(1e6)).alias("t"), F.col("user_id").alias("ant"), F.col("event_type").alias("spw"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


# embeddings: a row is a spectrum
SPECTRA = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


LONG = f"(SELECT vec_id, label, unnest(range(len(v))) AS chan, unnest(v) AS value FROM {SPECTRA})"


def long(spark: SparkSession, d: str) -> DataFrame:
    return spectra(spark, d).select("vec_id", "label", F.posexplode("v").alias("chan", "value"))


# lineitem: fact rows with weight, flag and dimensions
FACT = "(SELECT l_orderkey AS scan, l_partkey AS part, l_suppkey AS ant, l_linenumber AS spw, l_extendedprice AS value, l_quantity AS weight, l_returnflag = 'R' AS flag, epoch(l_shipdate) AS t FROM lineitem)"


def fact(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP_NTZ)) AS DOUBLE)")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scan"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("ant"), F.col("l_linenumber").alias("spw"),
        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight"), (F.col("l_returnflag") == "R").alias("flag"), t.alias("t"),
    )


# an image cube: mean value per cell
CUBE = f"(SELECT CAST(part % 64 AS INTEGER) AS x, CAST(ant % 64 AS INTEGER) AS y, spw AS chan, avg(value) AS value, bool_or(NOT flag) AS mask FROM {FACT} GROUP BY 1, 2, 3)"


def cube(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    return f.groupBy((F.col("part") % 64).cast("int").alias("x"), (F.col("ant") % 64).cast("int").alias("y"), F.col("spw").alias("chan")).agg(F.avg("value").alias("value"), F.max(~F.col("flag")).alias("mask"))


CATALOG = "(SELECT p_partkey AS line_id, p_retailprice AS frequency, p_brand AS species, p_type AS chemname, p_size AS el, p_name AS qns FROM part)"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("line_id"), F.col("p_retailprice").alias("frequency"), F.col("p_brand").alias("species"), F.col("p_type").alias("chemname"), F.col("p_size").alias("el"), F.col("p_name").alias("qns")
    )
