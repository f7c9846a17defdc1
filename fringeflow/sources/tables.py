"""Tables on storage: text tables, versions, partitions, concatenation, line lists, history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_text_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = " ", comment: str = "#", first: int | None = None, last: int | None = None) -> DataFrame:
    """A delimited text table; with first and last only those data lines (from 0, both included), which needs a schema."""
    if first is not None or last is not None:
        lines = numbered_lines(spark, path, comment)
        lines = lines.where((F.col("n") >= (first or 0) + int(header)) & (F.col("n") <= (last if last is not None else 2**62) + int(header)))
        return lines.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")
    reader = spark.read.option("header", header).option("sep", sep).option("comment", comment)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def numbered_lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(n, value): the lines of text files, but comments, numbered from 0 in the order of files and of lines.

    Splits are counted apart; the running sum over them is a table of one row a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"))
    lines = lines.where(~F.startswith("value", F.lit(comment))).withColumn("_i", F.monotonically_increasing_id())
    splits = lines.groupBy("_f", "_o").agg(F.min("_i").alias("_lo"), F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_f", "_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_f", "_o", (before - F.col("_lo")).alias("_shift"))
    return lines.join(F.broadcast(splits), ["_f", "_o"]).select((F.col("_i") + F.col("_shift")).alias("n"), "value")


def read_line_list(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """Colon-separated spectral-line exports as a catalogue table."""
    names = ["species", "recommended", "chemname", "frequency", "qns", "intensity", "smu2", "loga", "el", "eu", "linelist"]
    raw = spark.read.option("sep", ":").option("header", header).csv(paths).toDF(*names)
    numbers = {"frequency": "double", "intensity": "float", "smu2": "float", "loga": "float", "el": "float", "eu": "float"}
    return raw.select(*((F.lower("recommended").isin("yes", "true", "t", "1").alias(c)) if c == "recommended" else F.col(c).cast(numbers[c]).alias(c) if c in numbers else F.trim(c).alias(c) for c in names))


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_partitions(df: DataFrame, path: str, axis: list[str], files: int | None = None) -> None:
    """One folder a value of the axis, so a selection on it reads only its folders."""
    (df.repartition(files, *axis) if files else df.repartition(*axis)).sortWithinPartitions(*axis).write.mode("overwrite").partitionBy(*axis).parquet(path)


def list_partitions(df: DataFrame, part: str, scan: str, spw: str, chan: Column) -> DataFrame:
    return df.groupBy(part, scan).agg(F.sort_array(F.collect_set(spw)).alias("spws"), F.max(chan).alias("nchan"), F.count("*").alias("nrows"))


def concatenate(sets: list[tuple[DataFrame, DataFrame]], key: str, dim_id: str, value: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Joins (facts, dimension) sets; dimension rows whose values lie within the tolerance become one and the facts' keys follow.

    Values are chained in sorted order: a new entry begins where the step exceeds the tolerance.
    """
    dims = reduce(lambda a, b: a.unionByName(b), (d.select(F.lit(i).alias("_set"), F.col(dim_id).alias("_old"), F.col(value).alias(value)) for i, (_, d) in enumerate(sets)))
    w = Window.orderBy(value, "_set", "_old")  # dimension tables are short: a row a spectral window or field
    new = (F.col(value) - F.lag(value).over(w) > tolerance).cast("int")
    dims = dims.withColumn(dim_id, F.sum(F.coalesce(new, F.lit(0))).over(w))
    facts = []
    for i, (f, _) in enumerate(sets):
        m = dims.where(F.col("_set") == i).select(F.col("_old").alias(key), F.col(dim_id).alias("_new"))
        facts.append(f.join(m, key).withColumn(key, F.col("_new")).drop("_new"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts), dims.groupBy(dim_id).agg(F.min(value).alias(value))


def drop(spark: SparkSession, pattern: str) -> list[str]:
    """Deletes paths that match a glob; returns them."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(p) or []]
    for f in found:
        fs.delete(f, True)
    return sorted(f.toString() for f in found)


def with_history(history: DataFrame | None, spark: SparkSession, task: str, parameters: dict) -> DataFrame:
    rows = spark.createDataFrame([(task, k, repr(v)) for k, v in sorted(parameters.items())], "task string, parameter string, value string")
    rows = rows.withColumn("at", F.current_timestamp())
    return rows if history is None else history.unionByName(rows)


def parse_scans(text: str) -> dict[str, list[int]]:
    """`block0:1,3~5;block1:*` as block -> scans; an empty list stands for all."""
    out: dict[str, list[int]] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        block, _, scans = part.rpartition(":")
        ids: list[int] = []
        for s in filter(None, scans.split(",")):
            if s.strip() == "*":
                continue
            lo, _, hi = s.partition("~")
            ids += range(int(lo), int(hi or lo) + 1)
        out[block] = sorted({*out.get(block, []), *ids})
    return out


# --- lookups, versions and listings ---------------------------------------------------------------------------------
def lookup(facts: DataFrame, dimension: DataFrame, key: str, id_col: str, columns: list[str]) -> DataFrame:
    """Columns of the dimension row that a fact row's key names; null where there is none. Spark broadcasts a dimension
    that is measured to be short."""
    d = dimension.select(F.col(id_col).alias("_id"), *columns)
    return facts.join(d, F.col(key) == F.col("_id"), "left").drop("_id")


def subset(df: DataFrame, selected: Column, order: list[str], column: str, name: str = "data") -> DataFrame:
    """Selected rows in chunk order with one data column."""
    return in_chunks(df.where(selected), order).select(*order, F.col(column).alias(name))


def in_chunks(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Chunk order: rows of one chunk (all order columns but the last) in one partition, each partition sorted."""
    keys = order[:-1] or order
    return (df.repartition(parts, *keys) if parts else df.repartition(*keys)).sortWithinPartitions(*order)


def in_time_order(df: DataFrame, time_col: str, *more: str) -> DataFrame:
    return df.orderBy(time_col, *more)


class Versioned:
    """A table whose changes are new versions: `path/v0`, `path/v1`, ... Readers of older versions are not disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise ValueError(f"no version at {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        known = self.versions()
        n = known[-1] + 1 if known else 0
        df.write.parquet(f"{self.path}/v{n}")
        return n

    def write_back(self, changes: DataFrame, key: str, columns: list[str]) -> int:
        """A new version in which rows of the changes have their values of some columns."""
        new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias("_" + c) for c in columns), F.lit(True).alias("_changed"))
        j = self.read().join(new, F.col(key) == F.col("_key"), "left")
        return self.write(j.select(*(F.when(F.col("_changed"), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in self.read().columns)))


def set_intents(rows: DataFrame, states: DataFrame, selected: Column, intent: str, how: str = "append") -> tuple[DataFrame, DataFrame]:
    """Rows (.., state_id) and states (state_id, obs_mode) in which the selected rows have an intent, added to theirs or in
    its place. States that change for some rows only are new ones, numbered after the last; one row a changed state."""
    mode = F.concat_ws(",", F.when(F.col("obs_mode") != "", F.col("obs_mode")), F.lit(intent)) if how == "append" else F.lit(intent)
    used = rows.where(selected).select("state_id").distinct()
    top = states.agg(F.max("state_id").alias("_top"))  # one row
    changed = states.join(used, "state_id").withColumn("obs_mode", mode)
    new = changed.crossJoin(F.broadcast(top)).withColumn("_new", F.col("_top") + F.row_number().over(Window.orderBy("state_id")))  # states are few
    out = rows.join(F.broadcast(new.select(F.col("state_id").alias("_old"), "_new")), F.col("state_id") == F.col("_old"), "left")
    out = out.withColumn("state_id", F.when(selected & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("state_id")).cast("long")).select(*rows.columns)
    return out, states.unionByName(new.select(F.col("_new").cast(states.schema["state_id"].dataType).alias("state_id"), "obs_mode"))


def shapes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of each length of an array column."""
    return df.groupBy(*keys, F.size(column).alias("nchan")).agg(F.count("*").alias("rows"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two sets has, each as often as it has it more."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).union(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def not_finite(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """NaN values and rows of each group."""
    return df.groupBy(*keys).agg(F.sum(F.isnan(value).cast("long")).alias("nans"), F.count("*").alias("n"))


def positions(df: DataFrame, time_col: str, keys: list[str], columns: list[str], at: DataFrame, width: float | None = None) -> DataFrame:
    """Columns of a table of places in time (an ephemeris, a pointing table) at the times of another, linear between its
    rows. width deals the rows of a key by blocks of time, as in asof()."""
    from ..operators.calibrate import asof

    return asof(at, df, keys, time_col, columns, "linear", width)
