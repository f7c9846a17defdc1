"""Session helpers: one place that knows how a session is built and where shared scratch tables go."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "fringeflow") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FRINGEFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local session (tests) gets one of its own; on a
    cluster that is an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fringeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder inside the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Removes all scratch tables and token stores of this application. For when nothing reads their results any more."""
    delete(spark, scratch_root(spark))


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Batches to Python of at most this size, for jobs started inside: less memory on both sides where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder to cut lineage, and removed once nothing reads them.

    They are plain Parquet tables, so a lost executor takes nothing with it. What is not dropped goes with sweep().
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # goes with the frame itself
        return out

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of steps whose results have been saved and whose plans are gone."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that save() gave back; frames of other kinds are left alone."""
        for df in frames:
            path = getattr(df, "scratch_path", None) if df is not None else None
            if isinstance(path, str):
                delete(self.spark, path)
                del df.scratch_path
