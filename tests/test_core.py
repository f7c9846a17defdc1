import math

import pytest
from pyspark.sql import functions as F

from fringeflow.functions import columns as C
from fringeflow.functions import units
from fringeflow.operators import average, calibrate, fit, flag, image, select, spectral, stats, uvgrid
from fringeflow.sources import fits, tables
from fringeflow.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*x):
    return F.array(*map(F.lit, map(float, x)))


def test_hanning_goldens(spark):
    six = arr(1, 2, 5, 10, 17, 26)
    assert one(spark, spectral.hanning(six)) == [1.5, 2.5, 5.5, 10.5, 17.5, 21.5]
    assert one(spark, spectral.hanning_decimated(six)) == [2.5, 10.5]
    assert one(spark, spectral.hanning_decimated(six, "mean")) == [4.0, 14.0]
    assert one(spark, spectral.hanning_decimated(arr(1, 2, 5, 10, 17), "mean")) == [4.0, 12.0]
    assert one(spark, spectral.boxcar(six, 3)) == pytest.approx([8 / 3, 17 / 3, 32 / 3, 53 / 3])
    assert one(spark, spectral.decimate(six, 4)) == [1.0, 17.0]


def test_channel_grammar():
    assert select.parse_channels("0~5,5~10;20", 64) == [(0, 10), (20, 20)]
    assert select.parse_channels("<3,>=62", 64) == [(0, 2), (62, 63)]
    assert select.parse_channels("", 8) == [(0, 7)]
    for bad in ("9~3", "70", "a"):
        with pytest.raises(ValueError):
            select.parse_channels(bad, 64)
    assert select.parse_stokes("IQUV") == ["I", "Q", "U", "V"]
    assert select.parse_stokes("XXYY") == ["XX", "YY"]
    assert select.seconds("2024/01/02/06:00:00") == 1704175200.0


def test_units():
    assert units.factor("kg", "g") * 5 == 5000
    assert units.parse("5kg") == (5.0, "kg")
    assert units.factor("km/h", "m/s") == pytest.approx(1 / 3.6)
    assert units.compare("3km/s", "2m/h") and not units.compare("3km", "2s")
    for bad in ("5 kilograms", "x"):
        with pytest.raises(ValueError):
            units.parse(bad)


def test_columns(spark):
    assert one(spark, C.weight_of_sigma(F.lit(2.0))) == 0.25
    assert one(spark, C.weight_of_sigma(F.lit(0.0))) == 0
    assert one(spark, C.sigma_of_weight(F.lit(0.0))) == -1
    assert one(spark, C.frequency(C.velocity(F.lit(1.3e9), 1.42e9, "opt"), 1.42e9, "opt")) == pytest.approx(1.3e9)
    assert one(spark, C.dms(F.lit(-math.pi / 6))) == "-30.00.00.0"
    assert one(spark, C.hms(F.lit(math.pi / 2))) == "06:00:00.00"
    assert C.min_match("med", stats.AGGREGATES) == "median"
    assert stats.normal_quantile(0.75) == pytest.approx(1 / C.XMADM)
    lon, lat = C.shift_direction(F.lit(1.0), F.lit(0.5), F.lit(0.1), F.lit(0.7))
    assert one(spark, C.separation(F.lit(1.0), F.lit(0.5), lon, lat)) == pytest.approx(0.1)


def test_flag_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, False)], "row_id int, flag boolean")
    v = flag.Versions(spark, f"file://{tmp_path}/v")
    v.save(df, "a")
    v.save(df, "a")
    assert len(v.names()) == 2 and "a" in v.names()
    now = df.withColumn("flag", F.col("row_id") == 2)
    got = {h: sorted(r.row_id for r in v.restore(now, "a", h).where("flag").collect()) for h in ("or", "and", "replace")}
    assert got == {"or": [1, 2], "and": [], "replace": [1]}


def test_library():
    rows = calibrate.parse_library("caltable='g.cal' calwt=True field='0' tinterp='linear' spwmap=[0,0,1]\n# no\ncaltable='b.cal' calwt=False finterp='nearest'")
    assert rows == [{"caltable": "g.cal", "calwt": True, "field": "0", "tinterp": "linear", "spwmap": [0, 0, 1]}, {"caltable": "b.cal", "calwt": False, "finterp": "nearest"}]
    with pytest.raises(ValueError):
        calibrate.parse_library("field='0'")


def test_smooth_time_window_is_left_open(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in (0, 5, 10)], "k int, tick long, v double")
    got = {r.tick: r.smoothed for r in average.smooth_time(df, ["k"], "tick", "v", 10).collect()}
    assert got == {0: 2.5, 5: 7.5, 10: 10.0}


def test_gains_are_recovered(spark):
    g = [1.0 + 0.2j, 0.8 - 0.1j, 1.2 + 0.3j, 0.9 + 0.0j]
    rows = [(0, a, b, (g[a] * g[b].conjugate()).real, (g[a] * g[b].conjugate()).imag, 1.0) for a in range(4) for b in range(a + 1, 4)]
    vis = spark.createDataFrame(rows, "i int, a int, b int, re double, im double, weight double")
    sol = {r.ant: complex(r.g_re, r.g_im) for r in calibrate.solve_gains(vis, ["i"], "a", "b", 0, 500).collect()}
    turn = abs(g[0]) / g[0]
    assert all(abs(sol[k] - g[k] * turn) < 1e-4 for k in range(4))


def test_gaussian_fit(spark):
    rows = [(0, i, 3 * math.exp(-4 * math.log(2) * ((i - 20.5) / 6) ** 2) + 1) for i in range(50)]
    r = fit.gaussian_fit(spark.createDataFrame(rows, "k int, x int, y double"), ["k"], "x", "y").first()
    assert (r.height, r.centre, r.fwhm, r.offset) == pytest.approx((3, 20.5, 6, 1), abs=1e-4) and r.converged
    assert fit.deconvolve_beam(5, 4, 0.3, 3, 3, 0) == pytest.approx((4, math.sqrt(7), 0.3))
    assert fit.deconvolve_beam(2, 2, 0, 3, 3, 0) is None


def test_rebin_shapes(spark):
    cube = spark.range(8000).selectExpr("cast(id % 20 as int) x", "cast(id div 20 % 20 as int) y", "cast(id div 400 as int) z", "1.0D value")
    f, n = {"x": 3, "y": 3, "z": 3}, {"x": 20, "y": 20, "z": 20}
    assert image.rebin(cube, f, n, [], "value").count() == 6**3
    assert image.rebin(cube, f, n, [], "value", crop_edges=False).count() == 7**3
    with pytest.raises(ValueError):
        image.rebin(cube, {"x": 1}, n, [], "value")


def test_dirty_image_peaks_at_source(spark):
    import numpy as np

    x0 = 3
    cells = [(u, v, math.cos(2 * math.pi * u * x0 / 16), math.sin(2 * math.pi * u * x0 / 16), 1.0) for u in range(-7, 8) for v in range(-7, 8)]
    d = uvgrid.dirty_image(spark.createDataFrame(cells, "iu int, iv int, re double, im double, weight double"), 16)
    assert np.unravel_index(np.argmax(d), d.shape) == (8 + x0, 8)
    comps, res = uvgrid.hogbom(d, np.roll(d, -x0, 0), 0.2, 50)
    assert comps[0][:2] == (8 + x0, 8) and np.abs(res).max() < np.abs(d).max()


def test_fits_round_trip(spark, tmp_path):
    p = tmp_path / "i.fits"
    p.write_bytes(fits.encode_image([float(i) for i in range(24)], [4, 3, 2], {"OBJECT": "X"}))
    spark.dataSource.register(fits.FitsImage)
    rows = spark.read.format("fitsimage").load(str(p)).collect()
    assert len(rows) == 24 and all(r.value == r.x + 4 * r.y + 12 * r.chan for r in rows)


def test_concatenate(spark):
    a = (spark.createDataFrame([(0, 1.0), (1, 2.0)], "spw int, v double"), spark.createDataFrame([(0, 100.0), (1, 200.0)], "id int, freq double"))
    b = (spark.createDataFrame([(0, 3.0)], "spw int, v double"), spark.createDataFrame([(0, 200.4)], "id int, freq double"))
    facts, dims = tables.concatenate([a, b], "spw", "id", "freq", 1.0)
    assert sorted((r.v, r.spw) for r in facts.collect()) == [(1.0, 0), (2.0, 1), (3.0, 1)] and dims.count() == 2
    assert tables.parse_scans("a:1,3~5;b:*") == {"a": [1, 3, 4, 5], "b": []}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i * 700, "a" if i % 3 else "b", float(i)) for i in range(60)], "s long, spw string, value double").select(F.timestamp_seconds("s").alias("ts"), "spw", "value")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for n, f in enumerate((lambda d: windows.tumbling(d, "ts", "1 hour", "1 day", ["spw"], "value"), lambda d: windows.sliding(d, "ts", "2 hours", "1 hour", "1 day", ["spw"], "value"))):
        q = f(source).writeStream.format("memory").queryName(f"t{n}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(spark.table(f"t{n}").collect()) == sorted(f(df).collect())
    assert windows.sessions(df, "ts", "10 minutes", "1 day", ["spw"], "value").count() == 60
