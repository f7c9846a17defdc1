"""Queries on images, the uv plane, deconvolution and column functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import units
from ..operators import fit, image, uvgrid
from .base import CUBE, FACT, cube, fact
from .registry import add, rounded
from .statistics import CVIS, cvis

_SHAPE = {"x": 64, "y": 64, "chan": 8}
_FLUX = "chan, count(*) AS npix, round(sum(value), 2) AS flux"


def _in(test) -> object:
    return lambda s, d: rounded(cube(s, d).where(test()).groupBy("chan").agg(F.count("*").alias("npix"), F.sum("value").alias("flux")), digits=2)


# --- regions, expressions, masks ------------------------------------------------------------------------------------
add("region_boxes_and_channels", _in(lambda: image.compose(_SHAPE, "3,4,20,30, 40,40,50,60", "1~3;5", "", "")), f"SELECT {_FLUX} FROM {CUBE} WHERE ((x BETWEEN 3 AND 20 AND y BETWEEN 4 AND 30) OR (x BETWEEN 40 AND 50 AND y BETWEEN 40 AND 60)) AND (chan BETWEEN 1 AND 3 OR chan = 5) GROUP BY chan")
add("region_lines_and_channels", _in(lambda: image.compose(_SHAPE, "", "<4", "", "circle [[30, 30], 15]\n-box [[28, 28], [32, 32]]")), f"SELECT {_FLUX} FROM {CUBE} WHERE pow(x - 30, 2) + pow(y - 30, 2) <= 225 AND NOT (x BETWEEN 28 AND 32 AND y BETWEEN 28 AND 32) AND chan < 4 GROUP BY chan")
add("region_stokes", lambda s, d: cube(s, d).withColumn("stokes", F.element_at(F.array(*map(F.lit, "IQUVIQU")), F.col("chan"))).where(image.compose(_SHAPE | {"stokes": 4}, stokes_spec="IU")).groupBy("stokes").agg(F.count("*").alias("n")), f"SELECT ['I', 'Q', 'U', 'V', 'I', 'Q', 'U'][chan] AS stokes, count(*) AS n FROM {CUBE} WHERE chan IN (1, 3, 5, 7) GROUP BY 1")
add("region_stokes_first", lambda s, d: cube(s, d).withColumn("stokes", F.element_at(F.array(*map(F.lit, "IQUVIQU")), F.col("chan"))).where(image.compose(_SHAPE | {"stokes": 4}, control="first")).groupBy("stokes").agg(F.count("*").alias("n")), f"SELECT 'I' AS stokes, count(*) AS n FROM {CUBE} WHERE chan IN (1, 5)")
add("region_wide_line", _in(lambda: image.parse_regions("line [[10, 20], [50, 20]], linewidth=7", F.col("x"), F.col("y"))), f"SELECT {_FLUX} FROM {CUBE} WHERE sqrt(pow(x - greatest(least(x, 50), 10), 2) + pow(y - 20, 2)) <= 3.5 GROUP BY chan")
add("region_polyline", _in(lambda: image.polyline(F.col("x"), F.col("y"), [(10, 10), (10, 50), (40, 50)], 4.0)), f"SELECT {_FLUX} FROM {CUBE} WHERE sqrt(pow(x - 10, 2) + pow(y - greatest(least(y, 50), 10), 2)) <= 2 OR sqrt(pow(x - greatest(least(x, 40), 10), 2) + pow(y - 50, 2)) <= 2 GROUP BY chan")
add("image_calc", lambda s, d: rounded(image.calc({"a": cube(s, d), "b": cube(s, d).where("mask")}, ["x", "y", "chan"], "sqrt(a) * 2 - b / 1000 + chan")), f"SELECT x, y, chan, round(sqrt(value) * 2 - value / 1000 + chan, 6) AS value FROM {CUBE} WHERE mask")
add("image_mask_expression", lambda s, d: rounded(image.mask_image(image.with_mask(cube(s, d), "value > 40000 AND x < 40")).groupBy("chan").agg(F.sum("value").alias("good"))), f"SELECT chan, sum((value > 40000 AND x < 40)::INT)::DOUBLE AS good FROM {CUBE} GROUP BY chan")
add("image_subimage_stretch", lambda s, d: rounded(image.subimage(cube(s, d), ["x", "y", "chan"], image.box(F.col("x"), F.col("y"), 10, 12, 30, 32), s.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.expr("int(id div 64)").alias("y"), (F.col("id") % 3 == 0).alias("good")), stretch=True).drop("mask"), digits=4),
    f"WITH q AS (SELECT * FROM {CUBE} WHERE x BETWEEN 10 AND 30 AND y BETWEEN 12 AND 32 AND (y * 64 + x) % 3 = 0) SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y, chan - min(chan) OVER () AS chan, round(value, 4) AS value FROM q")
add("image_subimage_dropdeg", lambda s, d: rounded(image.subimage(cube(s, d).drop("mask"), ["x", "y", "chan"], (F.col("y") == 5) & (F.col("chan") == 3), drop_degenerate=True, keep_axes=("chan",)), digits=4), f"SELECT x - min(x) OVER () AS x, 0 AS chan, round(value, 4) AS value FROM {CUBE} WHERE y = 5 AND chan = 3")

# --- geometry ---------------------------------------------------------------------------------------------------------
_CELL = f"WITH c AS (SELECT x, y, chan, value FROM {CUBE}), t AS (SELECT {{keys}}), n AS (SELECT t.*, CAST(floor(sx) AS INTEGER) AS fx, CAST(floor(sy) AS INTEGER) AS fy FROM t), e AS (SELECT n.*, fx + i AS ax, fy + j AS ay, CASE i WHEN 1 THEN sx - fx ELSE 1 - (sx - fx) END * CASE j WHEN 1 THEN sy - fy ELSE 1 - (sy - fy) END AS w FROM n, range(2) a(i), range(2) b(j)) SELECT e.chan, CAST(e.x AS INTEGER) AS x, CAST(e.y AS INTEGER) AS y, round(sum(w * c.value), 4) AS value FROM e JOIN c ON c.chan = e.chan AND c.x = ax AND c.y = ay WHERE w > 0 GROUP BY 1, 2, 3 HAVING sum(w) > 0.999999"
add("image_regrid", lambda s, d: rounded(image.regrid(cube(s, d), ["chan"], 30, 25, 2.25, 3.5, 1.5, 2.0), digits=4), _CELL.replace("{keys}", "k.chan, gx AS x, gy AS y, 2.25::DOUBLE + gx * 1.5 AS sx, 3.5::DOUBLE + gy * 2.0 AS sy FROM (SELECT DISTINCT chan FROM c) k, range(30) a(gx), range(25) b(gy)"))
add("image_rotate", lambda s, d: rounded(image.rotate(cube(s, d), ["chan"], 0.3, 30.0, 28.0), digits=4),
    _CELL.replace("{keys}", "c.chan, c.x, c.y, 30 + (c.x - 30) * cos(0.3) + (c.y - 28) * sin(0.3) AS sx, 28 + (c.y - 28) * cos(0.3) - (c.x - 30) * sin(0.3) AS sy FROM c"))
add("image_pad", lambda s, d: rounded(image.embed(cube(s, d).where("chan = 1"), ["chan"], 2, 64, 64, -5.0).groupBy("chan").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("x").alias("lo"), F.max("y").alias("hi")), digits=2),
    f"SELECT chan, count(*) + 68 * 68 - 64 * 64 AS n, round(sum(value) - 5.0 * (68 * 68 - 64 * 64), 2)::DOUBLE AS total, 0 AS lo, 67 AS hi FROM {CUBE} WHERE chan = 1 GROUP BY chan")


def _interpolated(s: SparkSession, d: str) -> DataFrame:
    grid = s.range(25).select((F.col("id") % 5 * 8).cast("int").alias("x"), F.expr("int(id div 5) * 8").alias("y"), F.lit(1).alias("chan")).withColumn("statistic", F.col("x") * 2.0 + F.col("y") * 3.0)
    return rounded(image.interpolated_statistic(grid, ["chan"], 8, 33, 33))


add("statistic_interpolated", _interpolated, "SELECT 1 AS chan, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, i * 2.0::DOUBLE + j * 3.0 AS value FROM range(33) a(i), range(33) b(j)")
add("image_fft", lambda s, d: rounded(image.transform_planes(cube(s, d), ["chan"], 64, 64).where("y = 33 AND x IN (30, 32, 35)").select("chan", "x", (F.col("re") / 1e3).alias("re"), (F.col("im") / 1e3).alias("im")), digits=4),
    f"SELECT chan, CAST(32 + u AS INTEGER) AS x, round(sum(value * cos(2 * pi() * (u * (x - 32) + (y - 32)) / 64)) / 1e3, 4) AS re, round(-sum(value * sin(2 * pi() * (u * (x - 32) + (y - 32)) / 64)) / 1e3, 4) AS im FROM {CUBE}, (VALUES (-2), (0), (3)) t(u) GROUP BY 1, 2")
add("common_beam", lambda s, d: s.createDataFrame([image.common_beam([(4.0, 3.0, 0.1), (6.0, 5.0, 0.4), (3.0, 3.0, 0.0)]), image.common_beam([(6.0, 1.0, 0.0), (5.0, 2.0, 1.5)])], "major double, minor double, pa double"), "SELECT * FROM (VALUES (6.0::DOUBLE, 5.0::DOUBLE, 0.4::DOUBLE), (6.0, 6.0, 0.0)) t(major, minor, pa)")


def _to_beam(s: SparkSession, d: str) -> DataFrame:
    """A Gaussian of one beam smoothed to a larger one keeps its sum and has the larger one's width."""
    g = s.range(41 * 41).select((F.col("id") % 41).cast("int").alias("x"), F.expr("int(id div 41)").alias("y"), F.lit(1).alias("k"))
    g = g.withColumn("value", C.gaussian2d(F.col("x"), F.col("y"), 1.0, 20, 20, 4.0, 4.0, 0.0))
    out = image.smooth(g, image.beam_kernel((6.0, 6.0, 0.0), (4.0, 4.0, 0.0), 9), ["k"]).where("x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 40")
    return rounded(fit.fit_gaussians_2d(out, ["k"]).select("k", "x", "y", "major", "minor"), digits=2)


add("smooth_to_beam", _to_beam, "SELECT 1 AS k, 20.0::DOUBLE AS x, 20.0::DOUBLE AS y, 6.0::DOUBLE AS major, 6.0::DOUBLE AS minor")


def _gaussians(s: SparkSession) -> DataFrame:
    d = s.range(5 * 48 * 48).select(F.expr("id div 2304").alias("k"), (F.col("id") % 48).cast("int").alias("x"), F.expr("int(id div 48) % 48").alias("y"))
    value = F.lit(0.0)
    for k in range(5):
        value = F.when(F.col("k") == k, C.gaussian2d(F.col("x"), F.col("y"), 10.0 + k, 20 + 0.3 * k, 24 - 0.2 * k, 9.0, 5.0, 0.4 + 0.1 * k)).otherwise(value)
    return d.withColumn("value", value)


add("image_gaussian_fit", lambda s, d: rounded(fit.fit_gaussians_2d(_gaussians(s), ["k"]).select("k", "peak", "x", "y", "major", "minor", "pa", "flux", "converged"), digits=3),
    "SELECT k, 10.0::DOUBLE + k AS peak, round(20 + 0.3 * k, 3)::DOUBLE AS x, round(24 - 0.2 * k, 3)::DOUBLE AS y, 9.0::DOUBLE AS major, 5.0::DOUBLE AS minor, round(0.4 + 0.1 * k, 3)::DOUBLE AS pa, round((10 + k) * pi() / (4 * ln(2)) * 45, 3) AS flux, true AS converged FROM range(5) r(k)")

# --- uv plane ---------------------------------------------------------------------------------------------------------
_TRI = f"SELECT CAST(cu + i AS BIGINT) AS iu, CAST(cv + j AS BIGINT) AS iv, spw, re, im, weight, greatest(0, 1 - abs(cu + i - u4)) * greatest(0, 1 - abs(cv + j - v4)) AS k FROM (SELECT *, u / 4 AS u4, v / 4 AS v4, round(u / 4) AS cu, round(v / 4) AS cv FROM {CVIS} WHERE scan < 400), range(-1, 2) a(i), range(-1, 2) b(j)"
add("grid_convolved", lambda s, d: rounded(uvgrid.grid_convolved(cvis(s, d).where("scan < 400"), F.col("u"), F.col("v"), 4.0, ["spw"], F.col("re"), F.col("im"), F.col("weight"), "triangle", 1), digits=9),
    f"SELECT iu, iv, spw, round(sum(re * k * weight), 9) + 0.0 AS re, round(sum(im * k * weight), 9) + 0.0 AS im, round(sum(k * weight), 9) AS weight FROM ({_TRI}) WHERE k > 0 GROUP BY iu, iv, spw")


def _degridded(s: SparkSession, d: str) -> DataFrame:
    """A plane through the cells is read back at any place by a triangle."""
    grid = s.range(40 * 40).select((F.col("id") % 40 - 20).alias("iu"), F.expr("id div 40 - 20").alias("iv")).withColumn("re", F.col("iu") * 2.0 + F.col("iv")).withColumn("im", F.lit(1.0))
    rows = cvis(s, d).where("scan < 100").select(F.concat_ws(":", "scan", "spw", "part", "ant").alias("row"), "u", "v").distinct()
    return rounded(uvgrid.degrid(rows, "row", F.col("u"), F.col("v"), 4.0, grid, "triangle", 1))


add("degrid", _degridded, f"SELECT DISTINCT concat_ws(':', scan, spw, part, ant) AS row, round(u / 4 * 2 + v / 4, 6) + 0.0 AS re, 1.0::DOUBLE AS im FROM {CVIS} WHERE scan < 100")
add("gridding_kernels", lambda s, d: s.createDataFrame([(k, len(v), round(v[0], 6), round(v[50], 6), round(v[-1], 6)) for k in ("box", "triangle", "gaussian") for v in [uvgrid.kernel(k, 1, 100)]], "kind string, n long, first double, half double, last double"),
    "SELECT * FROM (VALUES ('box', 101::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE), ('triangle', 101, 1.0, 0.5, 0.0), ('gaussian', 101, 1.0, round(exp(-0.25), 6), round(exp(-1), 6))) t(kind, n, first, half, last)")
add("w_term", lambda s, d: rounded((lambda p: cvis(s, d).select("scan", "spw", p[0].alias("re"), p[1].alias("im")))(uvgrid.w_term(F.lit(0.01), F.lit(0.02), F.col("v") * 100))),
    f"SELECT scan, spw, round(cos(p), 6) AS re, round(sin(p), 6) + 0.0 AS im FROM (SELECT scan, spw, -2 * pi() * v * 100 * (sqrt(1 - 0.0001 - 0.0004) - 1) AS p FROM {CVIS})")
add("weights_tapered", lambda s, d: rounded(cvis(s, d).select("scan", "spw", uvgrid.filtered_weights(F.col("weight"), F.col("u"), F.col("v"), 20.0, 10.0, 0.5).alias("w"))),
    f"SELECT scan, spw, round(weight * exp(-ln(2) * (pow((v * cos(0.5) + u * sin(0.5)) / 20, 2) + pow((u * cos(0.5) - v * sin(0.5)) / 10, 2))), 6) AS w FROM {CVIS}")
add("dirty_image_direct", lambda s, d: rounded(uvgrid.direct_image(cvis(s, d).where("scan < 60"), ["spw"], 6, 0.01), digits=4),
    f"SELECT spw, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, round(sum(weight * (re * cos(p) - im * sin(p))) / sum(weight), 4) AS value FROM (SELECT *, 2 * pi() * (u * (i - 3) * 0.01 + v * (j - 3) * 0.01) AS p FROM {CVIS}, range(6) a(i), range(6) b(j) WHERE scan < 60) GROUP BY 1, 2, 3")


def _dirty_fft(s: SparkSession, d: str) -> DataFrame:
    """The dirty image of gridded cells, at a few pixels."""
    g = uvgrid.dirty_image(uvgrid.grid(cvis(s, d).where("scan < 300"), F.col("u"), F.col("v"), 4.0, [], F.col("re"), F.col("im"), F.col("weight")), 32)
    return s.createDataFrame([(x, y, round(float(g[x, y]), 6)) for x in (14, 16, 19) for y in (16, 17)], "x long, y long, value double")


_CELLS = f"SELECT floor(u / 4) AS a, floor(v / 4) AS b, sum(re * weight) AS re, sum(im * weight) AS im FROM {CVIS} WHERE scan < 300 GROUP BY 1, 2"
add("dirty_image_fft", _dirty_fft,
    f"WITH c AS ({_CELLS}), g AS (SELECT a, b, sum(re) AS re, sum(im) AS im FROM (SELECT * FROM c UNION ALL SELECT -a, -b, re, -im FROM c) GROUP BY 1, 2), n AS (SELECT sum(sqrt(re * re + im * im)) AS n FROM g) SELECT x, y, round(sum(re * cos(q) + im * sin(q)) / any_value(n), 6) AS value FROM (SELECT *, 2 * pi() * (a * (x - 16) + b * (y - 16)) / 32 AS q FROM g, n, (VALUES (14::BIGINT), (16), (19)) t(x), (VALUES (16::BIGINT), (17)) u(y)) GROUP BY 1, 2")


def _beam(nx: int, ny: int):
    import numpy as np

    y, x = np.mgrid[:ny, :nx]
    return np.exp(-4 * np.log(2) * ((x - nx // 2) ** 2 + (y - ny // 2) ** 2) / 4.0**2)


def _cleaned(algorithm: str, **how):
    def run(s: SparkSession, d: str) -> DataFrame:
        g = s.range(3 * 40 * 40).select(F.expr("id div 1600").alias("k"), (F.col("id") % 40).cast("int").alias("x"), F.expr("int(id div 40) % 40").alias("y"))
        r2 = F.pow(F.col("x") - (12 + F.col("k") * 3), 2) + F.pow(F.col("y") - (22 - F.col("k")), 2)
        g = g.withColumn("value", (5.0 + F.col("k")) * F.exp(-4 * math.log(2) * r2 / 16))
        out = uvgrid.clean_planes(g, ["k"], 40, 40, _beam, 3.0, algorithm=algorithm, niter=400, threshold=1e-4, **how)
        top = F.max_by(F.struct("x", "y"), "restored")
        return rounded(out.groupBy("k").agg(F.sum("model").alias("flux"), top.alias("t"), F.max("restored").alias("peak"), (F.max(F.abs("residual")) < 0.02).alias("clean")).select("k", "flux", "t.x", "t.y", "peak", "clean"), digits=1)

    return run


for _name, _how in (("hogbom", {}), ("clark", {"cycle": 400}), ("multiscale", {"scales": [0.0, 3.0]})):
    add(f"clean_{_name}", _cleaned(_name, **_how), "SELECT k, 5.0::DOUBLE + k AS flux, CAST(12 + 3 * k AS INTEGER) AS x, CAST(22 - k AS INTEGER) AS y, 5.0::DOUBLE + k AS peak, true AS clean FROM range(3) r(k)")


def _entropy(s: SparkSession, d: str) -> DataFrame:
    import numpy as np

    beam = _beam(32, 32)
    truth = np.zeros((32, 32))
    truth[12, 20] = 4.0
    dirty = np.fft.ifft2(np.fft.fft2(truth) * np.fft.fft2(np.roll(beam, (-16, -16), (0, 1)))).real
    run = uvgrid.Deconvolver(dirty, beam, "mem", niter=2000).run()
    at = np.unravel_index(np.argmax(run.model), run.model.shape)
    pb = uvgrid.Deconvolver.corrected(run.dirty, np.where(beam > 0.5, 0.5, 0.1))
    return s.createDataFrame([(int(at[0]), int(at[1]), bool(run.model.min() >= 0), bool(abs(run.residual).max() < 0.1 * dirty.max()), bool(np.isnan(pb).sum() == (beam <= 0.5).sum()))], "y long, x long, positive boolean, fits boolean, cut boolean")


add("clean_entropy", _entropy, "SELECT 12::BIGINT AS y, 20::BIGINT AS x, true AS positive, true AS fits, true AS cut")
add("feather", lambda s, d: rounded(uvgrid.feather(_flat(s, 7.0), _flat(s, 2.0), ["k"], 16, 16, 5.0).groupBy("k").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")), digits=4), "SELECT k, 7.0::DOUBLE + k AS lo, 7.0::DOUBLE + k AS hi, 256::BIGINT AS n FROM range(3) r(k)")


def _flat(s: SparkSession, level: float) -> DataFrame:
    return s.range(3 * 256).select(F.expr("id div 256").alias("k"), (F.col("id") % 16).cast("int").alias("x"), F.expr("int(id div 16) % 16").alias("y")).withColumn("value", level + F.col("k"))


def _sidebands(s: SparkSession, d: str) -> DataFrame:
    """Lines of both sidebands, shifted in opposite directions by whole channels."""
    line = lambda i, c, h: h * F.exp(-4 * math.log(2) * F.pow((F.pmod(i - c + 64, F.lit(128)) - 64) / 6.0, 2))

    def seen(k: int):
        return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: line(i, 40 + k, 5.0 + F.col("id")) + line(i, 90 - k, 3.0))

    spectra = [seen(k) for k in (0, 7, 18)]
    v = s.range(4).select("id", F.array(*spectra).alias("v"))
    out = uvgrid.split_sidebands(v, ["id"], "v", [0.0, 7.0, 18.0], [0.0, -7.0, -18.0], both=True)
    near = lambda c, at: F.round(F.get(c, at) - F.get(c, 10), 3) + 0.0  # noqa: E731  (the constant is shared between the two)
    return out.select("id", near("signal", 40).alias("signal"), near("image", 90).alias("image"))


add("split_sidebands", _sidebands, "SELECT i AS id, 5.0::DOUBLE + i AS signal, 3.0::DOUBLE AS image FROM range(4) r(i)")

# --- column functions -------------------------------------------------------------------------------------------------

def _hands(s: SparkSession, d: str) -> tuple[DataFrame, list]:
    v = cvis(s, d)
    z = C.Complex(F.col("re"), F.col("im"))
    return v, [z, C.Complex(F.col("im"), F.col("u")), C.Complex(F.col("u"), F.col("v")), C.Complex(F.col("v"), F.col("re"))]


def _jones(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        v, hands = _hands(s, d)
        j = [C.Complex(F.lit(1.0), F.lit(0.5)), C.Complex(F.lit(0.2), F.lit(-0.1)), C.Complex(F.lit(-0.3), F.lit(0.0)), C.Complex(F.lit(0.9), F.lit(0.1))]
        out = C.jones_apply(kind, j[: {"general": 4, "diagonal": 2, "scalar": 1}[kind]], hands)
        return rounded(v.select("scan", "spw", *(c.alias(f"{n}{i}") for i, z in enumerate(out) for n, c in (("re", z.re), ("im", z.im)))), digits=7)

    return run


def _times(a: str, b: str, x: str, y: str) -> tuple[str, str]:
    return f"(({a}) * ({x}) - ({b}) * ({y}))", f"(({a}) * ({y}) + ({b}) * ({x}))"


def _jones_sql(kind: str) -> str:
    v = [("re", "im"), ("im", "u"), ("u", "v"), ("v", "re")]
    j = [("1.0", "0.5"), ("0.2", "-0.1"), ("-0.3", "0.0"), ("0.9", "0.1")]
    m = lambda p, q: _times(*j[p], *v[q])
    if kind == "scalar":
        out = [m(0, i) for i in range(4)]
    elif kind == "diagonal":
        out = [m(0, 0), m(0, 1), m(1, 2), m(1, 3)]
    else:
        plus = lambda a, b: (f"{a[0]} + {b[0]}", f"{a[1]} + {b[1]}")
        out = [plus(m(0, 0), m(1, 2)), plus(m(0, 1), m(1, 3)), plus(m(2, 0), m(3, 2)), plus(m(2, 1), m(3, 3))]
    return f"SELECT scan, spw, {', '.join(f'round({c}, 7) + 0.0 AS {n}{i}' for i, z in enumerate(out) for n, c in zip(('re', 'im'), z))} FROM {CVIS}"


for _kind in ("general", "diagonal", "scalar"):
    add(f"jones_{_kind}", _jones(_kind), _jones_sql(_kind))


def _stokes(s: SparkSession, d: str) -> DataFrame:
    v, h = _hands(s, d)
    return rounded(v.select("scan", "spw", *(c.alias(k) for k, c in C.stokes(h[0].re, h[1], h[2], h[3].re).items())), digits=7)


add("stokes_parameters", _stokes, f"SELECT scan, spw, round((re + v) / 2, 7) AS \"I\", round((re - v) / 2, 7) + 0.0 AS \"Q\", round((im + u) / 2, 7) + 0.0 AS \"U\", round((u - v) / 2, 7) + 0.0 AS \"V\" FROM {CVIS}")
add("total_polarization", lambda s, d: rounded(cvis(s, d).select("scan", "spw", C.total_polarization(F.col("re"), F.col("im"), F.col("u"), 30.0).alias("p"))), f"SELECT scan, spw, round(CASE WHEN re * re + im * im + u * u - 900 >= 0 THEN sqrt(re * re + im * im + u * u - 900) END, 6) AS p FROM {CVIS}")
add("complex_amp_phase", lambda s, d: rounded((lambda z: cvis(s, d).select("scan", "spw", z.amp().alias("amp"), z.phase().alias("phase"), (z / C.Complex(F.lit(2.0), F.lit(1.0))).re.alias("re")))(C.Complex(F.col("re"), F.col("im")) + C.Complex.polar(F.lit(2.0), F.lit(0.5)))),
    f"SELECT scan, spw, round(sqrt(a * a + b * b), 6) AS amp, round(atan2(b, a), 6) AS phase, round((a * 2 + b) / 5, 6) AS re FROM (SELECT scan, spw, re + 2 * cos(0.5) AS a, im + 2 * sin(0.5) AS b FROM {CVIS})")
_SKY = f"(SELECT scan, spw, radians(ant % 360) AS lon, radians(weight) AS lat FROM {FACT})"


def _sky(s: SparkSession, d: str) -> DataFrame:
    return fact(s, d).select("scan", "spw", F.radians(F.col("ant") % 360).alias("lon"), F.radians(F.col("weight")).alias("lat"))


def _projected(kind: str):
    return lambda s, d: rounded((lambda p: _sky(s, d).where("lon < 2").select("scan", "spw", p[0].alias("px"), p[1].alias("py")))(C.project(kind, F.col("lon"), F.col("lat"), 1.0, 0.5)))


_OR = f"WITH o AS (SELECT scan, spw, lon, lat, cos(lat) * sin(lon - 1) AS x, sin(lat) * cos(0.5) - cos(lat) * sin(0.5) * cos(lon - 1) AS y, sin(lat) * sin(0.5) + cos(lat) * cos(0.5) * cos(lon - 1) AS z FROM {_SKY} WHERE lon < 2)"
for _kind, _px, _py in (
    ("SIN", "x", "y"), ("TAN", "x / z", "y / z"), ("STG", "2 * x / (1 + z)", "2 * y / (1 + z)"), ("ARC", "x * atan2(sqrt(x * x + y * y), z) / sqrt(x * x + y * y)", "y * atan2(sqrt(x * x + y * y), z) / sqrt(x * x + y * y)"),
    ("SFL", "(lon - 1) * cos(lat)", "lat - 0.5"), ("CAR", "lon - 1", "lat - 0.5"),
):
    add(f"projection_{_kind.lower()}", _projected(_kind), f"{_OR} SELECT scan, spw, round({_px}, 6) + 0.0 AS px, round({_py}, 6) + 0.0 AS py FROM o")
add("direction_offsets", lambda s, d: rounded((lambda p: _sky(s, d).select("scan", "spw", p[0].alias("lon"), p[1].alias("lat"), C.position_angle(F.col("lon"), F.col("lat"), F.lit(1.0), F.lit(0.5)).alias("pa")))(C.shift_direction(F.col("lon"), F.col("lat"), F.lit(0.1), F.lit(0.7)))),
    f"SELECT scan, spw, round(lon + atan2(sin(0.1) * sin(0.7), cos(lat) * cos(0.1) - sin(lat) * sin(0.1) * cos(0.7)), 6) AS lon, round(asin(sin(lat) * cos(0.1) + cos(lat) * sin(0.1) * cos(0.7)), 6) AS lat, round(atan2(sin(1 - lon) * cos(0.5), cos(lat) * sin(0.5) - sin(lat) * cos(0.5) * cos(1 - lon)), 6) + 0.0 AS pa FROM {_SKY}")
add("direction_ecliptic", lambda s, d: rounded((lambda p: _sky(s, d).select("scan", "spw", p[0].alias("l"), p[1].alias("b")))(C.to_frame(F.col("lon"), F.col("lat"), "J2000", "ECLIPTIC"))),
    f"WITH e AS (SELECT scan, spw, lon, lat, radians(23.4392911) AS o FROM {_SKY}), q AS (SELECT scan, spw, atan2(sin(lon) * cos(o) * cos(lat) + sin(lat) * sin(o), cos(lat) * cos(lon)) AS l, asin(sin(lat) * cos(o) - cos(lat) * sin(o) * sin(lon)) AS b FROM e) SELECT scan, spw, round(l - floor(l / (2 * pi())) * 2 * pi(), 6) AS l, round(b, 6) AS b FROM q")


def _galactic(s: SparkSession, d: str) -> DataFrame:
    """There and back, and the distance of the galactic pole from its known place."""
    g = C.to_frame(F.col("lon"), F.col("lat"), "J2000", "GALACTIC")
    e = C.to_frame(*g, "GALACTIC", "J2000")
    pole = C.to_frame(F.lit(math.radians(192.85948)), F.lit(math.radians(27.12825)), "J2000", "GALACTIC")[1]
    return rounded(_sky(s, d).where("scan < 50 AND lon > 0").select("scan", "spw", "lon", "lat", e[0].alias("lon2"), e[1].alias("lat2"), F.round(F.degrees(pole), 2).alias("pole")), digits=4)


add("direction_galactic", _galactic, f"SELECT scan, spw, round(lon, 4) AS lon, round(lat, 4) AS lat, round(lon, 4) AS lon2, round(lat, 4) AS lat2, 90.0::DOUBLE AS pole FROM {_SKY} WHERE scan < 50 AND lon > 0")
add("azimuth_elevation", lambda s, d: rounded(_sky(s, d).select("scan", "spw", C.azimuth(F.col("lon"), F.col("lat"), 0.6).alias("az"), C.elevation(F.col("lon"), F.col("lat"), 0.6).alias("el"))),
    f"WITH q AS (SELECT scan, spw, atan2(-sin(lon) * cos(lat), sin(lat) * cos(0.6) - cos(lat) * cos(lon) * sin(0.6)) AS a, asin(sin(lat) * sin(0.6) + cos(lat) * cos(0.6) * cos(lon)) AS e FROM {_SKY}) SELECT scan, spw, round(a - floor(a / (2 * pi())) * 2 * pi(), 6) AS az, round(e, 6) AS el FROM q")
add("angle_texts", lambda s, d: _sky(s, d).select("scan", "spw", C.hms(F.col("lon")).alias("hms"), C.dms(-F.col("lat")).alias("dms")),
    f"WITH q AS (SELECT scan, spw, CAST(round(ant % 360 / 15.0 * 360000) AS BIGINT) % 8640000 AS h, CAST(round(weight * 36000) AS BIGINT) AS a FROM {FACT}) SELECT scan, spw, printf('%02d:%02d:%02d.%02d', h // 360000, h % 360000 // 6000, h % 6000 // 100, h % 100) AS hms, printf('-%02d.%02d.%02d.%d', a // 36000, a % 36000 // 600, a % 600 // 10, a % 10) AS dms FROM q")
add("functionals", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.gaussian1d(F.col("weight"), 3.0, 25.0, 12.0).alias("g"), C.lorentzian(F.col("weight"), 2.0, 20.0, 5.0).alias("l"), C.polynomial(F.col("weight"), [1.0, -0.5, 0.01]).alias("p"), C.power_log_polynomial(F.col("weight"), [2.0, -0.7, 0.1]).alias("plp"), C.log_transformed_polynomial(F.col("weight"), [0.5, -0.7, 0.1]).alias("ltp"), C.multiplet(F.col("weight"), 3.0, 25.0, 12.0, [(0.5, 4.0, 2.0)]).alias("m"), C.compiled("a * sin(x) + b", "weight", {"a": 2.0, "b": -1.0}).alias("c"))),
    f"SELECT scan, spw, round(3 * exp(-4 * ln(2) * pow((weight - 25) / 12, 2)), 6) AS g, round(2 / (1 + 4 * pow((weight - 20) / 5, 2)), 6) AS l, round(1 - 0.5 * weight + 0.01 * weight * weight, 6) AS p, round(2 * pow(weight, -0.7 + 0.1 * ln(weight)), 6) AS plp, round(0.5 - 0.7 * ln(weight) + 0.1 * pow(ln(weight), 2), 6) AS ltp, round(3 * exp(-4 * ln(2) * pow((weight - 25) / 12, 2)) + 1.5 * exp(-4 * ln(2) * pow((weight - 29) / 24, 2)), 6) AS m, round(2 * sin(weight) - 1, 6) AS c FROM {FACT}")
add("beam_models", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.primary_beam("poly", F.col("weight"), 50.0, [1.0, -0.9, 0.2]).alias("poly"), C.primary_beam("inverse_poly", F.col("weight"), 50.0, [1.0, 0.9, 0.2]).alias("inverse"), C.primary_beam("cos_poly", F.col("weight"), 50.0, [0.1, 0.9]).alias("cosine"), (F.abs(C.primary_beam("airy", F.lit(25.0), 50.0) - 0.5) < 1e-3).alias("half"))),
    f"SELECT scan, spw, round(1 - 0.9 * pow(weight / 50, 2) + 0.2 * pow(weight / 50, 4), 6) AS poly, round(1 / (1 + 0.9 * pow(weight / 50, 2) + 0.2 * pow(weight / 50, 4)), 6) AS inverse, round(pow(0.1 + 0.9 * cos(weight / 50), 2), 6) AS cosine, true AS half FROM {FACT}")
add("flux_and_peak", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.flux_from_peak(F.col("value"), F.lit(4.0), F.lit(3.0), F.lit(2.0), F.lit(2.0)).alias("flux"), C.peak_from_flux(F.col("value"), F.lit(4.0), F.lit(3.0), F.lit(2.0), F.lit(2.0)).alias("peak"))), f"SELECT scan, spw, round(value * 3, 6) AS flux, round(value / 3, 6) AS peak FROM {FACT}")
add("unit_conversion", lambda s, d: rounded(fact(s, d).select("scan", "spw", units.convert(F.col("weight"), "km/s", "m/s").alias("speed"), units.convert(F.col("weight"), "arcsec", "deg").alias("angle"), units.convert(F.col("weight"), "mJy", "Jy").alias("flux"))), f"SELECT scan, spw, round(weight * 1000, 6) AS speed, round(weight / 3600, 6) AS angle, round(weight / 1000, 6) AS flux FROM {FACT}")
add("constants", lambda s, d: s.range(1).select(C.constant("c").alias("c"), (C.constant("h") * 1e34).alias("h"), (C.constant("pc") / C.constant("au")).alias("pc_in_au")).transform(lambda x: rounded(x, digits=4)), "SELECT 299792458.0::DOUBLE AS c, 6.6261::DOUBLE AS h, 206264.8062::DOUBLE AS pc_in_au")
add("atmosphere", lambda s, d: rounded((lambda e, t: fact(s, d).select("scan", "spw", e.alias("vapour"), C.refractivity(F.lit(650.0), t, e).alias("n"), C.precipitable_water(e, t).alias("pwv"), C.transmission(F.lit(0.1), F.radians(F.col("weight") + 10)).alias("passed")))(C.water_vapour_pressure(260 + F.col("weight") / 2, F.lit(20.0)), 260 + F.col("weight") / 2), digits=5),
    f"WITH q AS (SELECT scan, spw, weight, 260 + weight / 2 AS t FROM {FACT}), e AS (SELECT *, 0.2 * 6.112 * exp(17.62 * (t - 273.15) / (243.12 + t - 273.15)) AS e FROM q) SELECT scan, spw, round(e, 5) AS vapour, round(77.6 * (650 - e) / t + 64.8 * e / t + 3.776e5 * e / (t * t), 5) AS n, round(e * 100 / (461.5 * t) * 2000, 5) AS pwv, round(exp(-0.1 / sin(radians(weight + 10))), 5) AS passed FROM e")
