"""What queries on the fixed tables cannot show: errors, streams, sessions, solvers on odd input, blocks of time."""

import logging
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from fringeflow import session
from fringeflow.functions import columns
from fringeflow.operators import average, calibrate, extend, fit, flag, image, search, select, spectral, stats, uvgrid
from fringeflow.plans import sqlshim
from fringeflow.sources import asdm, filler, headers, sqlite, tables
from fringeflow.streaming import windows


def test_blocks_of_time_change_nothing(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 0.37).alias("t"), "id")
    right = spark.createDataFrame([(0, 5.0, 1.0), (0, 50.0, 2.0), (0, 50.5, 4.0), (1, 80.0, 7.0)], "k long, t double, v double")
    for how in ("previous", "next", "nearest", "linear"):
        want = sorted(map(str, calibrate.asof(left, right, ["k"], "t", ["v"], how).collect()))
        for width in (1.0, 7.0, 1000.0):
            assert sorted(map(str, calibrate.asof(left, right, ["k"], "t", ["v"], how, width).collect())) == want
    spans = spark.createDataFrame([(i, 10.0 * i, 10.0 * i + 4) for i in range(1, 8)], "span long, lo double, hi double")
    want = sorted(calibrate.assign_interval(left.select("id", "t"), spans, "t", width=1e9).collect())
    assert sorted(calibrate.assign_interval(left.select("id", "t"), spans, "t", width=3.0).collect()) == want
    assert {r.span for r in want} == set(range(1, 8))


def test_groups_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 5.0), (1, 7.0)], "k int, t double")
    assert sorted(r.bin for r in average.with_time_bin(df, "t", ["k"], 2.0).collect()) == [0, 0, 2]
    assert sum(r.quack for r in flag.quack(df, "t", ["k"], 1.0).collect()) == 2


def test_errors(spark):
    for call in (
        lambda: select.antennas("3&&&&7"), lambda: select.parse_channels("5~3", 10), lambda: select.parse_stokes("IZ"), lambda: headers.mode("x"), lambda: columns.min_match("s", ("sum", "stddev")),
        lambda: spectral.smoothing_kernel("cone", 3), lambda: flag.value_of("ABS(XX)ABS(YY)"), lambda: fit.parse_estimates("1, 2"), lambda: fit.parse_baselines("0, spline, 1, 3, 2"), lambda: asdm.read(None, "", "Nothing"),
        lambda: calibrate.generated(None, "amp", [1, 2], [1], [1.0, 2.0, 3.0]), lambda: columns.to_frame(None, None, "J2000", "B1900"), lambda: image.beam_kernel((2, 2, 0), (3, 3, 0), 2),
        lambda: uvgrid.Deconvolver(None, None, "magic"), lambda: average.weighted_column("MODEL", None, None, None),
    ):
        with pytest.raises(ValueError):
            call()


def test_errors_with_tables(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, value double")
    for call in (
        lambda: select.row_fields(df, ["b"]), lambda: calibrate.apply_tables(df, [], "a", "a", mode="x"), lambda: search.astronomical(df, "stars"), lambda: image.rebin(df, {"stokes": 2, "x": 2}, {}, [], "value"),
        lambda: stats.in_pixel_range(df, "value", (0, 1), (0, 1)), lambda: average.channel_rows(df, [], "a", "a", [(0, 5, 1, 1)], "value"), lambda: average.vector_or_scalar(df, [], "a", "a", "both"),
        lambda: select.ids_of(df, "a", "value", "nobody"), lambda: stats.fit_statistics(df, [], "a", "value", "value", "a", 3), lambda: tables.Versioned(spark, session.scratch_root(spark) + "/none").read(),
        lambda: image.subimage(df, ["a", "value"], F.lit(True), df.select("a", F.lit(True).alias("good"))), lambda: sqlshim.query(df, "SELEC a FROM t"), lambda: calibrate.predict(df, spark.range(2000).selectExpr("1D flux", "id l", "id m"), []),
    ):
        with pytest.raises(ValueError):
            call()


def test_scratch_tables(spark):
    s = session.Scratch(spark, "test")
    a = s.save(spark.range(5))
    b = s.save(spark.range(7))
    s.drop(a, None, spark.range(3))
    s.drop(a)
    assert b.count() == 7
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(f"{s.root}/0").count()
    with session.arrow_batches(spark, "1m"):
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "1m"


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_idle_batches(spark, tmp_path):
    rows = [("a", 9000 + t, 1.0) for t in (0, 10, 20, 500, 510)] + [("b", 9005, 2.0), ("a", 14000, 9.0)]
    df = spark.createDataFrame(rows, "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.idle_batches(source, "ts", ["k"], "v", "60 seconds", "1 second").writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r["first"], r["last"], r.n, r.total) for r in spark.table("idle").collect())
    assert got[:2] == [("a", 9000.0, 9020.0, 3, 3.0), ("a", 9500.0, 9510.0, 2, 2.0)] and set(got[2:]) <= {("b", 9005.0, 9005.0, 1, 2.0)}


def test_database_by_ranges(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"x{i}", i / 2) for i in range(50)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    spark.dataSource.register(sqlite.SqliteTable)
    source = spark.read.format("sqlitetable").option("path", str(tmp_path / "a.db")).option("slices", "4")
    assert sorted(map(tuple, source.option("table", "t").load().collect())) == [(i, f"x{i}", i / 2) for i in range(50)]
    assert source.option("table", "empty").load().count() == 0


def test_fillers_and_sinks(spark):
    class Twos:
        schema = "p int, x double"

        def parts(self, options):
            return [1, 2, 3]

        def rows(self, part, options):
            yield from ((part, float(k)) for k in range(2 * part))

    assert filler.filled(spark, Twos(), {}, batch=2).groupBy("p").count().count() == 3
    sink = extend.TableSink(most=2)
    log = logging.getLogger("test.sink")
    log.addHandler(sink)
    for i in range(3):
        log.warning("message %d", i)
    assert [r.message for r in sink.rows(spark).orderBy("time").collect()] == ["message 1", "message 2"]

    @extend.task
    def add(a, b=2):
        return a + b

    assert add(1) == 3 and add.last_default == {"b": 2}
    with pytest.raises(TypeError):
        add()


def test_polynomials_of_any_order(spark):
    free = [(0, 9), (20, 39)]
    v = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: 2 + 0.5 * i - 0.03 * i * i + 0.001 * i * i * i + F.when(i.between(10, 19), F.col("id") + 1.0).otherwise(0.0)).alias("v"))
    got = v.select("id", spectral.subtract_polynomial(F.col("v"), 40, free, 3).alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx([r.id + 1.0 if 10 <= i < 20 else 0.0 for i in range(40)], abs=1e-9)
    with pytest.raises(ValueError):
        spectral.subtract_polynomial(F.col("v"), 40, [(0, 2)], 3)
    none = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(spectral.subtract_line(F.col("v"), F.array(F.lit(False), F.lit(False)), 1).alias("v")).first()
    assert none.v is None


def test_regular_and_searched_grids_agree(spark):
    df = spark.range(4).select("id", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.sin(i + F.col("id"))).alias("v"))
    freq = F.transform("v", lambda _, i: 3.0 + 0.1 * i)
    a, b = (spectral.regrid(df, ["id"], freq, 2.9, 0.07, 50, "v", regular=x).orderBy("id").collect() for x in (True, False))
    for x, y in zip(a, b):
        assert [p is None for p in x.v] == [p is None for p in y.v]
        assert [p for p in x.v if p is not None] == pytest.approx([p for p in y.v if p is not None], abs=1e-9)


def test_solver_of_a_flagged_antenna(spark):
    rows = [(0, i, j, 1.0, 0.0, 0.0 if 3 in (i, j) else 1.0) for i in range(5) for j in range(i + 1, 5)]
    vis = spark.createDataFrame(rows, "k int, a int, b int, re double, im double, weight double")
    got = {r.ant: r for r in calibrate.solve_gains(vis, ["k"], "a", "b").collect()}
    assert got[3].g_flag and not got[0].g_flag and got[0].g_re == pytest.approx(1, abs=1e-6)


def test_common_numbers():
    assert uvgrid.spheroidal(0.0) == pytest.approx(1) and uvgrid.spheroidal(1.0) == 0 and uvgrid.spheroidal(0.5) > uvgrid.spheroidal(0.9)
    assert stats.normal_quantile(0.75) == pytest.approx(1 / columns.XMADM)
    assert image.common_beam([(3.0, 2.0, 0.2)]) == (3.0, 2.0, 0.2)
    assert math.isclose(sum(spectral.smoothing_kernel("boxcar", 4)), 1) and len(spectral.smoothing_kernel("boxcar", 4)) == 5
