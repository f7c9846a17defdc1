"""Queries on calibration and on fits. Solvers are given data of known solutions, which their twins state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import Complex
from ..operators import calibrate, fit, spectral
from .base import FACT, LONG, VIS, catalog, fact, spectra, vis
from .registry import add, rounded
from .statistics import CVIS, cvis

# --- columns of data, models ----------------------------------------------------------------------------------------
_MODELS = "(SELECT n_nationkey::BIGINT AS spw, 1.0::DOUBLE + n_nationkey AS flux, n_nationkey * 0.001::DOUBLE AS l, n_nationkey * -0.0005::DOUBLE AS m FROM nation WHERE n_nationkey BETWEEN 1 AND 5)"


def _models(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("double")
    return s.range(1, 6).select(F.col("id").cast("int").alias("spw"), (1.0 + k).alias("flux"), (k * 0.001).alias("l"), (k * -0.0005).alias("m"))


add("model_column", lambda s, d: rounded(calibrate.with_model(cvis(s, d), _models(s, d), ["spw"]).select("scan", "spw", "model_re", "model_im")),
    f"WITH q AS (SELECT scan, c.spw, flux, -2 * pi() * (u * l + v * m) AS p FROM {CVIS} c LEFT JOIN {_MODELS} m ON m.spw = c.spw) SELECT scan, spw, round(CASE WHEN flux IS NULL THEN 1 ELSE flux * cos(p) END, 6)::DOUBLE AS model_re, round(CASE WHEN flux IS NULL THEN 0 ELSE flux * sin(p) END, 6)::DOUBLE + 0.0 AS model_im FROM q")
add("predict_components", lambda s, d: rounded(calibrate.predict(cvis(s, d).where("scan < 300"), _models(s, d).drop("spw"), ["spw"]).select("scan", "spw", "model_re", "model_im")),
    f"SELECT scan, c.spw, round(sum(flux * cos(-2 * pi() * (u * l + v * m))), 6) AS model_re, round(sum(flux * sin(-2 * pi() * (u * l + v * m))), 6) AS model_im FROM {CVIS} c, {_MODELS} m WHERE scan < 300 GROUP BY c.scan, c.spw, c.part, c.ant, c.value, c.weight")
add("predict_incremental", lambda s, d: rounded(calibrate.predict(calibrate.clear(cvis(s, d).where("scan < 100"), add_model=True), _models(s, d).where("spw = 2").drop("spw"), [], incremental=True).select("scan", "spw", "model_re", "c_im")),
    f"SELECT scan, spw, round(1 + 3 * cos(-2 * pi() * (u * 0.002 + v * -0.001)), 6) AS model_re, round(im, 6) AS c_im FROM {CVIS} WHERE scan < 100")
add("clear_and_delete_model", lambda s, d: rounded(calibrate.delete_model(calibrate.clear(calibrate.with_model(cvis(s, d), _models(s, d), ["spw"]))).where("scan < 200").select("scan", "spw", "c_re", "c_im")), f"SELECT scan, spw, round(re, 6) AS c_re, round(im, 6) AS c_im FROM {CVIS} WHERE scan < 200")


def _with_model(s: SparkSession, d: str) -> DataFrame:
    return cvis(s, d).select("scan", "spw", F.col("re").alias("c_re"), F.col("im").alias("c_im"), (F.col("weight") / 10).alias("model_re"), F.lit(1.0).alias("model_im"))


add("uvsub", lambda s, d: rounded(calibrate.subtract_model(_with_model(s, d))), f"SELECT scan, spw, round(re - weight / 10, 6) AS c_re, round(im - 1, 6) AS c_im, round(weight / 10, 6) AS model_re, 1.0::DOUBLE AS model_im FROM {CVIS}")
add("uvsub_reverse", lambda s, d: rounded(calibrate.subtract_model(_with_model(s, d), reverse=True).select("scan", "spw", "c_re", "c_im")), f"SELECT scan, spw, round(re + weight / 10, 6) AS c_re, round(im + 1, 6) AS c_im FROM {CVIS}")
add("conjugate", lambda s, d: rounded(calibrate.conjugate(cvis(s, d), F.col("spw").isin(2, 3), ["im"]).select("scan", "spw", "im")), f"SELECT scan, spw, round(CASE WHEN spw IN (2, 3) THEN -im ELSE im END, 6) + 0.0 AS im FROM {CVIS}")
add("accor", lambda s, d: rounded(calibrate.accor(vis(s, d), ["ant", "spw"], F.col("ant") % 10 == F.col("k"), F.col("value"))), f"SELECT ant, spw, round(sqrt(avg(value)), 6) AS gain, count(*) AS n FROM {VIS} WHERE ant % 10 = k GROUP BY ant, spw")
add("blcal", lambda s, d: rounded(calibrate.solve_baselines(cvis(s, d).withColumn("model_re", F.col("spw") + 0.5).withColumn("model_im", F.lit(1.0)).withColumn("a", F.col("ant") % 5).withColumn("b", F.col("part") % 5), ["spw"], "a", "b"), digits=5),
    f"WITH q AS (SELECT *, ant % 5 AS a, part % 5 AS b, spw + 0.5::DOUBLE AS p, 1.0::DOUBLE AS q FROM {CVIS}) SELECT spw, a, b, round(sum(weight * (re * p + im * q)) / sum(weight * (p * p + q * q)), 5) AS g_re, round(sum(weight * (im * p - re * q)) / sum(weight * (p * p + q * q)), 5) AS g_im, count(*) AS n FROM q GROUP BY spw, a, b")
add("sdgaincal", lambda s, d: rounded(calibrate.sky_gains(vis(s, d), ["spw"], "t", "value", 86400.0)), f"WITH g AS (SELECT spw, CAST(floor(t / 86400) AS BIGINT) AS interval, avg(value) AS m, count(*) AS n FROM {VIS} GROUP BY 1, 2), w AS (SELECT spw, avg(value) AS w FROM {VIS} GROUP BY 1) SELECT spw, interval, n, round(m / w, 6) AS gain FROM g JOIN w USING (spw)")


# --- solvers --------------------------------------------------------------------------------------------------------
def _pairs(s: SparkSession, n: int, extra: int, both: bool = False) -> DataFrame:
    """(a, b, k): all pairs of n antennas for each k."""
    d = s.range(n * n * extra).select(F.expr(f"id div {n * extra}").alias("a"), F.expr(f"(id div {extra}) % {n}").alias("b"), (F.col("id") % extra).alias("k"))
    return d.where("a <> b" if both else "a < b")


def _pair_vis(d: DataFrame, gain) -> DataFrame:
    g = gain("a") * gain("b").conj()
    return d.withColumn("re", g.re).withColumn("im", g.im).withColumn("weight", F.lit(2.0))


def _solved(g: DataFrame, *keys: str) -> DataFrame:
    return rounded(g.select(*keys, "ant", F.hypot("g_re", "g_im").alias("amp"), F.atan2("g_im", "g_re").alias("phase"), "g_flag"), digits=4)


add("gaincal", lambda s, d: _solved(calibrate.solve_gains(_pair_vis(_pairs(s, 7, 4), lambda x: Complex.polar(1 + F.col(x) / 10 + F.col("k") / 20, 0.2 * F.col(x) * (F.col("k") + 1))), ["k"], "a", "b", rounds=400), "k"),
    "SELECT k, a AS ant, round(1 + a / 10.0::DOUBLE + k / 20.0::DOUBLE, 4) AS amp, round(atan2(sin(0.2 * a * (k + 1)), cos(0.2 * a * (k + 1))), 4) AS phase, false AS g_flag FROM range(7) x(a), range(4) y(k)")
add("bandpass", lambda s, d: _solved(calibrate.solve_bandpass(_pair_vis(_pairs(s, 6, 16), lambda x: Complex.polar((1 + F.col(x) / 10) * (1 + 0.05 * F.sin(F.col("k"))), 0.05 * F.col(x) * F.col("k"))).withColumn("spw", F.lit(1)), ["spw"], "k", "a", "b", rounds=400), "k"),
    "SELECT k, a AS ant, round((1 + 0.05 * sin(k)) / avg(1 + 0.05 * sin(k)) OVER (PARTITION BY a), 4) AS amp, round(atan2(sin(0.05 * a * k), cos(0.05 * a * k)), 4) AS phase, false AS g_flag FROM range(6) x(a), range(16) y(k)")
add("bandpass_polynomial", lambda s, d: _solved(calibrate.solve_bandpass(_pair_vis(_pairs(s, 5, 12), lambda x: Complex.polar(1 + 0.02 * F.col("k") + 0.003 * F.col("k") * F.col("k") * (F.col(x) + 1) / 7, F.lit(0.0))).withColumn("spw", F.lit(1)), ["spw"], "k", "a", "b", order=2, rounds=400), "k"),
    "WITH q AS (SELECT a, k, 1 + 0.02 * k + 0.003 * k * k * (a + 1) / 7.0::DOUBLE AS g FROM range(5) x(a), range(12) y(k)) SELECT k, a AS ant, round(g / avg(g) OVER (PARTITION BY a), 4)::DOUBLE AS amp, 0.0::DOUBLE AS phase, false AS g_flag FROM q")


def _delays(s: SparkSession, d: str) -> DataFrame:
    v = _pairs(s, 6, 64).withColumn("f", 1.4 + 0.01 * F.col("k")).withColumn("spw", F.lit(0))
    v = _pair_vis(v, lambda x: Complex.polar(F.lit(1.0) + F.col(x) / 10, 2 * math.pi * F.col("f") * (0.31 * F.col(x) - 0.4)))
    return rounded(calibrate.solve_delays(v, ["spw"], "f", "a", "b", 0).select("ant", "delay", "snr"), digits=4)


add("fringefit_delays", _delays, "SELECT a AS ant, round(0.31 * a, 4)::DOUBLE AS delay, 1.0::DOUBLE AS snr FROM range(1, 6) x(a)")


def _leakage(s: SparkSession, d: str) -> DataFrame:
    v = _pairs(s, 6, 3, both=True)
    da = lambda x: Complex(F.col(x) * 0.01, F.col(x) * -0.004)
    eb = lambda x: Complex(0.02 - F.col(x) * 0.003, F.col(x) * 0.002 + 0.001 * F.col("k"))
    p = Complex(3.0 + F.col("k"), F.lit(0.5))
    x = p * (da("a") + eb("b").conj())
    return rounded(calibrate.solve_leakage(v.withColumn("x_re", x.re).withColumn("x_im", x.im).withColumn("p_re", p.re).withColumn("p_im", p.im), ["k"], "a", "b"), digits=5)


add("polcal_leakage", _leakage, "SELECT k, a AS ant, round(a * 0.01, 5)::DOUBLE AS d_re, round(a * -0.004, 5)::DOUBLE + 0.0 AS d_im, round(0.02 - a * 0.003, 5)::DOUBLE AS e_re, round(a * 0.002 + 0.001 * k, 5)::DOUBLE AS e_im FROM range(6) x(a), range(3) y(k)")

# --- tables and their application -------------------------------------------------------------------------------------
for _kind, _parameter, _sql in (("amp", [2.0], "2.0::DOUBLE AS g_re, 0.0::DOUBLE AS g_im"), ("ph", [0.0, 30.0, 90.0], "round(cos(radians(p)), 6) AS g_re, round(sin(radians(p)), 6) AS g_im"), ("sbd", [0.1, 0.2, 0.3], "round(cos(2 * pi() * (a + 1) / 10 * s), 6) AS g_re, round(sin(2 * pi() * (a + 1) / 10 * s), 6) AS g_im")):
    add(f"gencal_{_kind}", lambda s, d, k=_kind, p=_parameter: rounded(calibrate.generated(s, k, [0, 1, 2], [1, 2], p)), f"SELECT s::BIGINT AS spw, a AS ant, {_sql}, false AS g_flag FROM (SELECT a, s, [0, 30, 90][a + 1] AS p FROM range(3) x(a), range(1, 3) y(s))")
_MATCH = f"(SELECT row_id, k AS a1, (k + 3) % 10 AS a2, spw, value FROM {VIS})"


def _rows(s: SparkSession, d: str) -> DataFrame:
    return vis(s, d).select("row_id", F.col("k").alias("a1"), ((F.col("k") + 3) % 10).cast("int").alias("a2"), "spw", "value")


add("calibration_match_antenna", lambda s, d: rounded(calibrate.matched(_rows(s, d), vis(s, d).where("k <> 5").groupBy("spw", F.col("k").alias("ant")).agg(F.max("value").alias("g")), ["spw"], "a1", "a2", ["g"]).select("row_id", "g1", "g2")),
    f"WITH c AS (SELECT spw, k, max(value) AS g FROM {VIS} WHERE k <> 5 GROUP BY 1, 2) SELECT row_id, round(p.g, 6) AS g1, round(q.g, 6) AS g2 FROM {_MATCH} v LEFT JOIN c p ON p.spw = v.spw AND p.k = a1 LEFT JOIN c q ON q.spw = v.spw AND q.k = a2")
add("calibration_match_baseline", lambda s, d: rounded(calibrate.matched(_rows(s, d), vis(s, d).groupBy("spw", F.col("k").alias("ant1"), ((F.col("k") + 3) % 10).cast("int").alias("ant2")).agg(F.max("value").alias("g")), ["spw"], "a1", "a2", ["g"], by="baseline").select("row_id", "g")), f"SELECT row_id, round(max(value) OVER (PARTITION BY spw, a1), 6) AS g FROM {_MATCH}")
add("gain_fields", lambda s, d: calibrate.gain_field(vis(s, d).withColumnRenamed("k", "field"), [1, 4]).select("row_id"), f"SELECT row_id FROM {VIS} WHERE k IN (1, 4)")


def _applied(mode: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        v = vis(s, d).select("row_id", (F.col("k") % 3).cast("int").alias("spw"), (F.col("k") % 10).cast("int").alias("a1"), ((F.col("k") + 1) % 10).cast("int").alias("a2"), F.col("t").alias("time"), F.col("value").alias("re"), F.lit(2.0).alias("im"), (F.col("value") > 80).alias("flag"), F.lit(1.0).alias("weight"))
        ants = s.range(10).select(F.col("id").cast("int").alias("ant"))
        fixed = ants.crossJoin(s.range(2).select(F.col("id").cast("int").alias("spw"))).select("spw", "ant", (1 + F.col("ant") / 10 + F.col("spw")).alias("g_re"), F.lit(0.0).alias("g_im"), (F.col("ant") == 4).alias("g_flag"))
        times = s.range(31).select((1704067200.0 + F.col("id") * 86400).alias("time"), (1 + F.col("id") * 0.01).alias("g_re"))
        moving = ants.crossJoin(times).select("ant", "time", (F.col("g_re") + F.col("ant") * 0.1).alias("g_re"), F.lit(0.0).alias("g_im"), F.lit(False).alias("g_flag"))
        tables = [{"table": fixed, "keys": ["spw"], "spwmap": [0, 1, 0], "calwt": True}, {"table": moving, "keys": [], "interp": "linear"}]
        out = calibrate.apply_tables(v, tables, "a1", "a2", mode=mode)
        keep = [c for c in ("c_re", "c_im", "c_flag") if c in out.columns]
        return rounded(out.select("row_id", "weight", *keep), digits=5)

    return run


_GAINS = f"WITH v AS (SELECT row_id, value, k % 10 AS a1, (k + 1) % 10 AS a2, CASE k % 3 WHEN 1 THEN 1 ELSE 0 END AS spw, least((t - 1704067200.0) / 86400, 30) * 0.01 AS x FROM {VIS}), g AS (SELECT *, a1 = 4 OR a2 = 4 AS lost, (1 + a1 / 10.0::DOUBLE + spw) * (1 + a2 / 10.0::DOUBLE + spw) AS f, (1 + x + a1 * 0.1) * (1 + x + a2 * 0.1) AS m FROM v)"
_LOST = "CASE WHEN lost THEN 1 ELSE f END"
for _mode, _columns in (
    ("calflag", f"round({_LOST} * {_LOST}, 5)::DOUBLE AS weight, round(value / ({_LOST} * m), 5) AS c_re, round(2 / ({_LOST} * m), 5)::DOUBLE AS c_im, value > 80 OR lost AS c_flag"),
    ("calonly", f"round({_LOST} * {_LOST}, 5)::DOUBLE AS weight, round(value / ({_LOST} * m), 5) AS c_re, round(2 / ({_LOST} * m), 5)::DOUBLE AS c_im, value > 80 AS c_flag"),
    ("flagonly", "1.0::DOUBLE AS weight, round(value, 5) AS c_re, 2.0::DOUBLE AS c_im, value > 80 OR lost AS c_flag"), ("trial", "1.0::DOUBLE AS weight"),
):
    add(f"applycal_{_mode}", _applied(_mode), f"{_GAINS} SELECT row_id, {_columns} FROM g")
add("noise_terms", lambda s, d: calibrate.noise(cvis(s, d).withColumn("re", F.lit(0.0)).withColumn("im", F.lit(0.0)), 0.5, 7).agg((F.abs(F.stddev("re") - 0.5) < 0.05).alias("re"), (F.abs(F.stddev("im") - 0.5) < 0.05).alias("im"), (F.abs(F.corr("re", "im")) < 0.1).alias("independent")), "SELECT true AS re, true AS im, true AS independent")
for _width in (None, 86400.0):
    add(f"asof_blocks_{'none' if _width is None else 'day'}", lambda s, d, w=_width: rounded(calibrate.asof(vis(s, d).where("spw <> 'click'").select("row_id", "ant", "t"), vis(s, d).where("spw = 'click'").select("ant", "t", F.col("value").alias("gain")).groupBy("ant", "t").agg(F.max("gain").alias("gain")), ["ant"], "t", ["gain"], "previous", w).select("row_id", "gain")),
        f"WITH c AS (SELECT ant, t, max(value) AS gain FROM {VIS} WHERE spw = 'click' GROUP BY 1, 2) SELECT v.row_id, round(c.gain, 6) AS gain FROM {VIS} v ASOF LEFT JOIN c ON v.ant = c.ant AND v.t >= c.t WHERE v.spw <> 'click'")

# --- fits -----------------------------------------------------------------------------------------------------------
_TWO = "(SELECT p, 5.0::DOUBLE + p AS h1, 20.3::DOUBLE + p * 0.5 AS c1, 6.0::DOUBLE AS w1, 3.0::DOUBLE + p * 0.1 AS h2, 60.0::DOUBLE - p * 0.3 AS c2, 9.0::DOUBLE AS w2 FROM range(8) r(p))"


def _profile(s: SparkSession, shape: str, two: bool = True, base: float = 0.0) -> DataFrame:
    d = s.range(8 * 90).select(F.expr("id div 90").alias("p"), (F.col("id") % 90).cast("double").alias("x"))
    line = (lambda h, c, w: h * F.exp(-4 * math.log(2) * F.pow((F.col("x") - c) / w, 2))) if shape == "gaussian" else (lambda h, c, w: h / (1 + 4 * F.pow((F.col("x") - c) / w, 2)))
    y = line(5.0 + F.col("p"), 20.3 + F.col("p") * 0.5, 6.0)
    if two:
        y = y + line(3.0 + F.col("p") * 0.1, 60.0 - F.col("p") * 0.3, 9.0)
    return d.withColumn("y", y + base)


for _shape, _area in (("gaussian", "sqrt(pi() / (4 * ln(2)))"), ("lorentzian", "pi() / 2")):
    add(f"profile_fit_{_shape}", lambda s, d, k=_shape: rounded(fit.fit_profiles(_profile(s, k), ["p"], "x", "y", 2, k).select("p", "component", "peak", "centre", "fwhm", "flux", "converged"), digits=3),
        f"SELECT p, 0 AS component, round(h1, 3) AS peak, round(c1, 3) AS centre, round(w1, 3) AS fwhm, round(h1 * w1 * {_area}, 3) AS flux, true AS converged FROM {_TWO} UNION ALL SELECT p, 1, round(h2, 3), round(c2, 3), round(w2, 3), round(h2 * w2 * {_area}, 3), true FROM {_TWO}")
add("profile_fit_estimates", lambda s, d: rounded(fit.fit_profiles(_profile(s, "gaussian", base=1.5), ["p"], "x", "y", order=1, estimates=fit.parse_estimates("6, 21, 5\n3, 58, 9, f # its width is known")).select("p", "component", "peak", "centre", "fwhm"), digits=3),
    f"SELECT p, 0 AS component, round(h1, 3) AS peak, round(c1, 3) AS centre, round(w1, 3) AS fwhm FROM {_TWO} UNION ALL SELECT p, 1, round(h2, 3), round(c2, 3), round(w2, 3) FROM {_TWO}")
add("gaussian_fit", lambda s, d: rounded(fit.gaussian_fit(_profile(s, "gaussian", two=False, base=2.0), ["p"], "x", "y").select("p", "height", "centre", "fwhm", "offset", "converged"), digits=3), f"SELECT p, round(h1, 3) AS height, round(c1, 3) AS centre, round(w1, 3) AS fwhm, 2.0::DOUBLE AS offset, true AS converged FROM {_TWO}")
add("initial_estimates", lambda s, d: _profile(s, "gaussian").groupBy("p").applyInPandas(_first_estimate, "p long, centre double, peak double").transform(lambda x: rounded(x, digits=0)), f"SELECT p, round(round(c1 - 1e-9), 0) AS centre, round(h1 * exp(-4 * ln(2) * pow((round(c1 - 1e-9) - c1) / w1, 2)) , 0) AS peak FROM {_TWO}")


def _first_estimate(p):
    import numpy as np
    import pandas as pd

    p = p.sort_values("x")
    h, c, _ = fit.estimate_components(p["x"].to_numpy(), p["y"].to_numpy() - np.median(p["y"]), 1, 0.1)[0]
    return pd.DataFrame({"p": [p["p"].iloc[0]], "centre": [c], "peak": [h + np.median(p["y"])]})


def _points(s: SparkSession, d: str) -> DataFrame:
    v = fact(s, d).where("spw <= 5").select("spw", (F.col("weight") - 25).alias("u"), ((F.col("ant") % 40) - 20).cast("double").alias("v"), "weight")
    f, phase = 2.0 + F.col("spw"), -2 * math.pi * (F.col("u") * F.col("spw") * 0.001 - F.col("v") * F.col("spw") * 0.0005)
    return v.withColumn("re", f * F.cos(phase)).withColumn("im", f * F.sin(phase))


add("uv_model_fit", lambda s, d: rounded(fit.fit_point(_points(s, d), ["spw"]).select("spw", "flux", (F.col("l") * 1000).alias("l"), (F.col("m") * 1000).alias("m")), digits=4), "SELECT CAST(k AS INTEGER) AS spw, 2.0::DOUBLE + k AS flux, k::DOUBLE AS l, round(-0.5 * k, 4)::DOUBLE AS m FROM range(1, 6) r(k)")


def _minimised(s: SparkSession, d: str) -> DataFrame:
    import numpy as np

    x = np.linspace(0, 4, 60)
    model = lambda p: (p[0] * np.exp(-p[1] * x), np.stack((np.exp(-p[1] * x), -p[0] * x * np.exp(-p[1] * x)), 1))
    p, _, _, done = fit.levenberg_marquardt(model, [1.0, 0.1], 3 * np.exp(-0.7 * x))
    samples, share = fit.metropolis(lambda q: -0.5 * float(((q - np.array([1.0, -2.0])) ** 2 / np.array([0.04, 0.25])).sum()), [0.0, 0.0], np.array([0.3, 0.7]), 20_000, 3)
    m, sd = samples[2000:].mean(0), samples[2000:].std(0)
    fine = bool(abs(m[0] - 1) < 0.05 and abs(m[1] + 2) < 0.1 and abs(sd[0] - 0.2) < 0.05 and abs(sd[1] - 0.5) < 0.1 and 0.1 < share < 0.8)
    return s.createDataFrame([(round(float(p[0]), 5), round(float(p[1]), 5), bool(done), fine)], "a double, b double, converged boolean, sampled boolean")


add("minimisers", _minimised, "SELECT 3.0::DOUBLE AS a, 0.7::DOUBLE AS b, true AS converged, true AS sampled")


def _baselined(s: SparkSession, d: str) -> DataFrame:
    """Slopes with one line in known channels, which alone is left."""
    y = lambda i: 3 + 0.1 * i - 0.002 * i * i + F.when(i.between(40, 44), 50.0 + F.col("id")).otherwise(0.0)
    d2 = s.range(6).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(99)), y))
    return rounded(fit.subtract_baselines(d2, "v", 2, find=True).select("id", F.posexplode("v").alias("chan", "value")), digits=3)


add("sd_baseline", _baselined, "SELECT p AS id, CAST(i AS INTEGER) AS chan, CASE WHEN i BETWEEN 40 AND 44 THEN 50.0::DOUBLE + p ELSE 0.0 END AS value FROM range(6) a(p), range(100) b(i)")
add("line_catalogue_fit", lambda s, d: rounded(fit.line_fit(catalog(s, d), ["species"], F.col("el").cast("double"), F.col("frequency"))), "SELECT p_brand AS species, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2, count(*) AS n FROM part GROUP BY 1")


# --- terms in closed form -------------------------------------------------------------------------------------------
_TERMS = f"(SELECT scan, spw, value, weight, ant, radians(20 + weight) AS el FROM {FACT})"


def _terms(s: SparkSession, d: str) -> DataFrame:
    return fact(s, d).withColumn("el", F.radians(20 + F.col("weight")))


add("gain_curves", lambda s, d: rounded(_terms(s, d).select("scan", "spw", calibrate.gain_curve(F.col("el"), [1.0, -0.002, 0.0001]).alias("curve"), calibrate.opacity_gain(F.lit(0.08), F.col("el")).alias("opacity"), calibrate.tsys_gain(F.col("weight") - 5).alias("tsys"))),
    f"SELECT scan, spw, round(1 - 0.002 * (90 - degrees(el)) + 0.0001 * pow(90 - degrees(el), 2), 6) AS curve, round(exp(-0.04 / sin(el)), 6) AS opacity, round(CASE WHEN weight > 5 THEN 1 / sqrt(weight - 5) END, 6) AS tsys FROM {_TERMS}")
add("switched_power", lambda s, d: rounded((lambda p: fact(s, d).select("scan", "spw", p[0].alias("gain"), (p[1] / math.pi).alias("tsys")))(calibrate.switched_power(F.col("value") / 1000, F.col("weight") / 10, F.lit(2.5)))), f"SELECT scan, spw, round(sqrt(weight / 10 / 2.5), 6) AS gain, round(value / 1000 * 2.5 / (2 * weight / 10) / pi(), 6) AS tsys FROM {FACT}")
add("radiometer_gains", lambda s, d: rounded(calibrate.radiometer_gains(fact(s, d).select("scan", "spw", "ant", "part", F.col("weight").alias("t1"), (F.col("value") / 1000).alias("t2")), ["ant"], ["t1", "t2"], [1e-4, -2e-5], 9e10).select("scan", "spw", "part", (F.col("path") * 1000).alias("path"), "g_re", "g_im"), digits=5),
    f"WITH p AS (SELECT scan, spw, part, 1e-4 * (weight - avg(weight) OVER (PARTITION BY ant)) - 2e-5 * (value / 1000 - avg(value / 1000) OVER (PARTITION BY ant)) AS p FROM {FACT}) SELECT scan, spw, part, round(p * 1000, 5) + 0.0 AS path, round(cos(-2 * pi() * 9e10 / 299792458.0 * p), 5) + 0.0 AS g_re, round(sin(-2 * pi() * 9e10 / 299792458.0 * p), 5) + 0.0 AS g_im FROM p")
add("faraday_rotation", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.faraday_rotation(F.col("weight"), F.lit(4e-5), F.col("spw") * 1.5e8).alias("turn"))), f"SELECT scan, spw, round(2.631e-13 * weight * 1e16 * 4e-5 * pow(299792458.0 / (spw * 1.5e8), 2), 6) AS turn FROM {FACT}")


def _plotted(s: SparkSession, d: str) -> DataFrame:
    g = vis(s, d).groupBy("spw", F.col("k").alias("ant")).agg((F.sum("value") / 100).alias("g_re"), (F.avg("value") / 10).alias("g_im")).withColumn("g_flag", F.col("ant") % 4 == 0)
    return rounded(calibrate.plot_points(g, "ant", "amp", ["spw"]).union(calibrate.plot_points(g, "ant", "phase", ["spw"])).withColumn("x", F.col("x").cast("long")))


add("plot_points", _plotted, f"WITH g AS (SELECT spw, k::BIGINT AS x, sum(value) / 100 AS a, avg(value) / 10 AS b FROM {VIS} WHERE k % 4 > 0 GROUP BY 1, 2) SELECT spw, x, round(sqrt(a * a + b * b), 6) AS y FROM g UNION ALL SELECT spw, x, round(degrees(atan2(b, a)), 6) FROM g")
add("velocity_frames", lambda s, d: rounded(_sky_rows(s, d).select("scan", "spw", (C.rest_velocity(F.col("lon"), F.col("lat")) / 1000).alias("v"), (C.reframed(F.lit(1.0e6), C.rest_velocity(F.col("lon"), F.col("lat")))).alias("f")), digits=5),
    f"WITH v AS (SELECT scan, spw, 20000 * (sin(lat) * sin(radians(30.0046667)) + cos(lat) * cos(radians(30.0046667)) * cos(lon - radians(270.9595417))) AS v FROM (SELECT scan, spw, radians(ant % 360) AS lon, radians(weight) AS lat FROM {FACT})) SELECT scan, spw, round(v / 1000, 5) + 0.0 AS v, round(1e6 * sqrt((1 - v / 299792458.0) / (1 + v / 299792458.0)), 5) AS f FROM v")
add("geocentric_positions", lambda s, d: rounded((lambda p: _sky_rows(s, d).select("scan", "spw", p[0].alias("ra"), p[1].alias("dec")))(C.geocentric(F.col("lon"), F.col("lat"), F.col("spw") * 60.0, F.lit(1.1), 0.6, 1.0))),
    f"WITH q AS (SELECT scan, spw, spw * 60.0 * cos(lat) * cos(lon) + cos(0.6) * cos(1.1) AS x, spw * 60.0 * cos(lat) * sin(lon) + cos(0.6) * sin(1.1) AS y, spw * 60.0 * sin(lat) + sin(0.6) AS z FROM (SELECT scan, spw, radians(ant % 360) AS lon, radians(weight) AS lat FROM {FACT})) SELECT scan, spw, round(atan2(y, x) - floor(atan2(y, x) / (2 * pi())) * 2 * pi(), 6) AS ra, round(atan2(z, sqrt(x * x + y * y)), 6) AS dec FROM q")


def _sky_rows(s: SparkSession, d: str) -> DataFrame:
    return fact(s, d).select("scan", "spw", F.radians(F.col("ant") % 360).alias("lon"), F.radians(F.col("weight")).alias("lat"))


add("atmosphere_factors", lambda s, d: rounded(spectra(s, d).select("vec_id", F.posexplode(spectral.scaled_between(F.col("v"), [(8, 1.2), (24, 1.6), (40, 1.1)])).alias("chan", "value"))),
    f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(value * CASE WHEN chan <= 8 THEN 1.2 WHEN chan < 24 THEN 1.2 + 0.4 * (chan - 8) / 16 WHEN chan < 40 THEN 1.6 - 0.5 * (chan - 24) / 16 ELSE 1.1 END, 6) + 0.0 AS value FROM {LONG}")
