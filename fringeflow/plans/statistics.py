"""Queries on statistics, averages, weights, flags and spectra."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import average, fit, flag, spectral, stats
from .base import CUBE, FACT, LONG, SPECTRA, VIS, cube, fact, long, spectra, vis
from .registry import add, r, rounded

# fact rows as complex visibilities: re the value in thousands, im from the weight
CVIS = f"(SELECT *, value / 1000 AS re, (weight - 25) * 2 AS im, weight - 25 AS u, ant % 40 - 20.0::DOUBLE AS v FROM {FACT})"


def cvis(s: SparkSession, d: str) -> DataFrame:
    f = fact(s, d)
    return f.withColumn("re", F.col("value") / 1000).withColumn("im", (F.col("weight") - 25) * 2).withColumn("u", F.col("weight") - 25).withColumn("v", (F.col("ant") % 40).cast("double") - 20.0)


_AXES = {"amp": "sqrt(re * re + im * im)", "phase": "atan2(im, re)", "imag": "im", "uvrange": "sqrt(u * u + v * v)", "weight": "weight"}
_ALL = ", ".join([r("min(x)", "min", 4), r("max(x)", "max", 4), r("avg(x)", "mean", 4), r("var_samp(x)", "variance", 3), r("median(x)", "median", 4), r("quantile_cont(x, 0.25)", "firstquartile", 4), r("quantile_cont(x, 0.75)", "thirdquartile", 4)])


def _some(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.withColumn("variance", F.round("variance", 3)).select(*keys, "npts", "min", "max", "mean", "variance", "median", "firstquartile", "thirdquartile", "medabsdevmed"), digits=4)


for _axis, _sql in _AXES.items():
    add(f"visstat_{_axis}", lambda s, d, a=_axis: _some(stats.visibility_statistics(cvis(s, d), a, ["spw"], few=a in ("amp", "phase")), "spw"),
        f"WITH x AS (SELECT spw, {_sql}::DOUBLE AS x FROM {CVIS} WHERE NOT flag), m AS (SELECT spw, median(x) AS m FROM x GROUP BY spw) SELECT spw, count(*) AS npts, {_ALL}, round(median(abs(x - m)), 4) AS medabsdevmed FROM x JOIN m USING (spw) GROUP BY spw")
add("visstat_averaged", lambda s, d: rounded(stats.visibility_statistics(cvis(s, d), "amp", ["spw"], average=["ant"], time_col="t", bin_width=3.0e7, max_uv=20.0, quantiles=False).select("spw", "npts", "mean", "max"), digits=4),
    f"WITH a AS (SELECT spw, sqrt(pow(avg(re), 2) + pow(avg(im), 2)) AS x FROM {CVIS} WHERE NOT flag AND sqrt(u * u + v * v) <= 20 GROUP BY spw, ant, floor(t / 3e7)) SELECT spw, count(*) AS npts, round(avg(x), 4) AS mean, round(max(x), 4) AS max FROM a GROUP BY spw")
add("visstat_accuracy", lambda s, d: stats.statistics(vis(s, d).where("row_id < 900"), F.col("value"), [], accuracy=10_000).select("npts", (F.abs(F.col("median") - 50) < 500).alias("fine")), f"SELECT count(*) AS npts, true AS fine FROM {VIS} WHERE row_id < 900")
add("array_statistics", lambda s, d: rounded(stats.array_statistics(spectra(s, d).withColumn("f", F.transform("v", lambda x: x < -1)), "v", ["label"], "f").select("label", "index", "npts", "mean", "max")),
    f"SELECT label, CAST(chan AS INTEGER) AS index, count(*) FILTER (WHERE value >= -1) AS npts, round(avg(value) FILTER (WHERE value >= -1), 6) AS mean, round(max(value) FILTER (WHERE value >= -1), 6) AS max FROM {LONG} GROUP BY 1, 2")
add("calstat_names", lambda s, d: rounded(stats.calibration_statistics(cvis(s, d), "amp", ["spw"], few=True).select("spw", "npts", "mean", F.round("var", 2).alias("var"), "median", "quartile"), digits=4),
    f"SELECT spw, count(*) AS npts, round(avg(x), 4) AS mean, round(var_samp(x), 2) AS var, round(median(x), 4) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS quartile FROM (SELECT spw, {_AXES['amp']} AS x FROM {CVIS}) GROUP BY spw")
add("image_stats_included", lambda s, d: rounded(stats.image_statistics(cube(s, d), "value", ["x", "y"], ["chan"], include=(30000.0, 60000.0)).select("chan", "npts", "mean", "max", "max_x", "max_y"), digits=3),
    f"SELECT chan, count(*) AS npts, round(avg(value), 3) AS mean, round(max(value), 3) AS max, arg_max(x, (value, -x, -y)) AS max_x, arg_max(y, (value, -x, -y)) AS max_y FROM {CUBE} WHERE value BETWEEN 30000 AND 60000 GROUP BY chan")
add("image_stats_excluded", lambda s, d: rounded(stats.image_statistics(cube(s, d), "value", ["x", "y"], ["chan"], exclude=(30000.0, 60000.0)).select("chan", "npts", "min", "min_x", "min_y"), digits=3),
    f"SELECT chan, count(*) AS npts, round(min(value), 3) AS min, arg_min(x, (value, x, y)) AS min_x, arg_min(y, (value, x, y)) AS min_y FROM {CUBE} WHERE value NOT BETWEEN 30000 AND 60000 GROUP BY chan")
add("robust_zscore_iterated", lambda s, d: rounded(stats.z_score(vis(s, d), "value", ["spw"], 2.0, rounds=3).groupBy("spw").agg(F.count("*").alias("npts"), F.avg("value").alias("mean"))),
    f"WITH a0 AS (SELECT spw, value FROM {VIS}), " + ", ".join(f"a{i + 1} AS (SELECT spw, value FROM a{i} QUALIFY abs(value - avg(value) OVER (PARTITION BY spw)) <= 2 * stddev_samp(value) OVER (PARTITION BY spw))" for i in range(3)) + " SELECT spw, count(*) AS npts, round(avg(value), 6) AS mean FROM a3 GROUP BY spw")
add("robust_zscore_until_stable", lambda s, d: rounded(stats.z_score(vis(s, d).withColumn("value", F.least("value", F.lit(60.0))), "value", ["spw"], 1.5, rounds=40, until_stable=True).groupBy("spw").agg(F.count("*").alias("npts"), F.avg("value").alias("mean"))),
    f"WITH a0 AS (SELECT spw, least(value, 60) AS value FROM {VIS}), " + ", ".join(f"a{i + 1} AS (SELECT spw, value FROM a{i} QUALIFY abs(value - avg(value) OVER (PARTITION BY spw)) <= 1.5 * stddev_samp(value) OVER (PARTITION BY spw))" for i in range(40)) + " SELECT spw, count(*) AS npts, round(avg(value), 6) AS mean FROM a40 GROUP BY spw")
_BW = "SELECT spw, sum(CASE WHEN abs(value - loc) < 6 * mad THEN pow(1 - pow((value - loc) / (6 * mad), 2), 2) * value ELSE 0 END) / sum(CASE WHEN abs(value - loc) < 6 * mad THEN pow(1 - pow((value - loc) / (6 * mad), 2), 2) ELSE 0 END) AS loc, any_value(mad) AS mad FROM v JOIN {} USING (spw) GROUP BY spw"
add("robust_biweight_iterated", lambda s, d: rounded(stats.biweight(vis(s, d), "value", ["spw"], rounds=3)),
    f"WITH v AS (SELECT spw, value FROM {VIS}), m AS (SELECT spw, median(value) AS loc FROM v GROUP BY spw), b0 AS (SELECT spw, any_value(loc) AS loc, median(abs(value - loc)) AS mad FROM v JOIN m USING (spw) GROUP BY spw), b1 AS ({_BW.format('b0')}), b2 AS ({_BW.format('b1')}), b3 AS ({_BW.format('b2')}) SELECT spw, count(*) AS npts, round(any_value(loc), 6) AS location FROM v JOIN b3 USING (spw) GROUP BY spw")
add("histogram_log", lambda s, d: rounded(stats.histogram(vis(s, d), "value", ["spw"], 10, 0.0, 100.0, cumulative=True, log10=True)),
    f"WITH h AS (SELECT spw, CAST(least(floor(value / 10), 9) AS INTEGER) AS bin, count(*) AS n FROM {VIS} WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2) SELECT spw, bin, round(log10(sum(n) OVER (PARTITION BY spw ORDER BY bin)), 6) AS counts, (bin + 0.5::DOUBLE) * 10 AS centre FROM h")
add("moments_4_5_7", lambda s, d: rounded(stats.moments(cube(s, d), "value", "chan", ["x", "y"], [4, 5, 7]).withColumn("moment_7", F.col("moment_7") / math.pi), digits=3),
    f"WITH c AS (SELECT * FROM {CUBE}), q AS (SELECT x, y, chan, sum(value) OVER w AS b, sum(value) OVER w - value AS a, sum(value) OVER (PARTITION BY x, y) / 2 AS h, lag(chan) OVER (PARTITION BY x, y ORDER BY chan) AS p FROM c WHERE value > 0 WINDOW w AS (PARTITION BY x, y ORDER BY chan ROWS UNBOUNDED PRECEDING)), f AS (SELECT x, y, min_by(CASE WHEN p IS NULL THEN chan::DOUBLE ELSE p + (chan - p) * (h - a) / (b - a) END, chan) AS m FROM q WHERE b >= h GROUP BY x, y), g AS (SELECT x, y, avg(value) AS m, stddev_samp(value) AS s FROM c GROUP BY x, y) SELECT c.x, c.y, round(any_value(f.m), 3) AS moment_4, round(any_value(s), 3) AS moment_5, round(avg(abs(value - g.m)) / pi(), 3) AS moment_7 FROM c JOIN g ON g.x = c.x AND g.y = c.y LEFT JOIN f ON f.x = c.x AND f.y = c.y GROUP BY c.x, c.y")
add("spectral_collapse", lambda s, d: rounded(stats.spectral_collapse(long(s, d).withColumn("f", 100 + F.col("chan") * 0.5), ["vec_id"], "f", "value", 120.0, 105.0)),
    f"SELECT vec_id, round(avg(value), 6) AS value, round(stddev_samp(value) / sqrt(count(*)), 6) AS error, count(*) AS nchan FROM {LONG} WHERE 100 + chan * 0.5 BETWEEN 105 AND 120 GROUP BY 1")
add("flux_total", lambda s, d: rounded(stats.total_flux(stats.flux_profile(cube(s, d), "value", "chan", F.col("chan") * F.lit(2.5))), digits=2), f"SELECT round(sum(value) * 2.5, 2)::DOUBLE AS total FROM {CUBE}")
add("flag_change", lambda s, d: rounded(stats.flag_change(fact(s, d).withColumn("after", F.col("flag") | (F.col("weight") > 40)), ["spw"], "flag", "after")),
    f"SELECT spw, round(100 * avg(flag::INT), 6) AS flagged_in, round(100 * avg((flag OR weight > 40)::INT), 6) AS flagged_out, CAST(sum((NOT flag AND weight > 40)::INT) AS BIGINT) AS newly FROM {FACT} GROUP BY spw")
add("calibration_fit", lambda s, d: rounded(stats.fit_statistics(fact(s, d), ["spw"], "weight", "value", "weight", "flag"), digits=3),
    f"WITH g AS (SELECT spw, weight AS x, value AS y, 1 / (weight * weight) AS w FROM {FACT} WHERE NOT flag), f AS (SELECT spw, count(*) AS n, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) AS b, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy FROM g GROUP BY spw), h AS (SELECT *, (sy - b * sx) / s AS a FROM f) SELECT spw, any_value(n) AS n, round(any_value(b), 3) AS slope, round(any_value(a), 3) AS intercept, round(avg(y - a - b * x), 3) AS res_mean, round(var_samp(y - a - b * x), 3) AS res_var, round(sum(w * pow(y - a - b * x, 2)) / (any_value(n) - 2), 3) AS redchi2 FROM g JOIN h USING (spw) GROUP BY spw")

# --- averages and weights -----------------------------------------------------------------------------------------
add("polarization_average", lambda s, d: rounded(average.polarization_average(vis(s, d).where("spw IN ('click', 'view')"), ["ant", "k"], "value")), f"SELECT ant, k, round(avg(value), 6) AS value FROM {VIS} WHERE spw IN ('click', 'view') GROUP BY ant, k")


def _single_dish(width: float | None, span: tuple[str, ...]):
    return lambda s, d: rounded(average.single_dish_average(fact(s, d).where("scan < 400").withColumn("state", F.col("part") % 2), "t", ["ant"], "value", F.col("weight"), width, "scan", "state", span), digits=4)


_SD = f"(SELECT *, part % 2 AS state FROM {FACT} WHERE scan < 400)"
_MEANS = "round(avg(t), 4) AS time, round(sum(value * weight) / sum(weight), 4) AS value, round(sum(weight), 4) AS weight, count(*) AS n"
add("sd_average_all", _single_dish(None, ()), f"SELECT scan, state, ant, {_MEANS} FROM {_SD} GROUP BY scan, state, ant")
add("sd_average_scan", _single_dish(None, ("scan",)), f"SELECT state, ant, {_MEANS} FROM {_SD} GROUP BY state, ant")
add("sd_average_both", _single_dish(None, ("scan", "state")), f"SELECT ant, {_MEANS} FROM {_SD} GROUP BY ant")
add("sd_average_none", _single_dish(0, ()), f"SELECT scan, state, ant, t AS time, round(value, 4) AS value, weight, 1::BIGINT AS n FROM {_SD}")
add("sd_average_bins", _single_dish(1.0e7, ("scan", "state")), f"WITH b AS (SELECT *, floor((t - min(t) OVER (PARTITION BY ant)) / 1e7) AS b FROM {_SD}) SELECT ant, {_MEANS} FROM b GROUP BY ant, b")
for _mode, _sql in (("vector", "sqrt(pow(avg(re), 2) + pow(avg(im), 2)) AS a, atan2(avg(im), avg(re)) AS p"), ("scalar", "avg(sqrt(re * re + im * im)) AS a, avg(atan2(im, re)) AS p")):
    add(f"average_{_mode}", lambda s, d, m=_mode: rounded(average.vector_or_scalar(cvis(s, d), ["ant", "spw"], "re", "im", m), digits=5), f"SELECT ant, spw, round(a, 5) AS amp, round(p, 5) AS phase, n FROM (SELECT ant, spw, {_sql}, count(*) AS n FROM {CVIS} GROUP BY ant, spw)")
add("average_channel_rows", lambda s, d: rounded(average.channel_rows(long(s, d), ["vec_id"], "label", "chan", [(0, 0, 9, 4), (1, 10, 21, 6), (0, 30, 30, 1)], "value")),
    f"WITH r AS (SELECT * FROM (VALUES (0, 0, 0, 9, 4), (1, 1, 10, 21, 6), (2, 0, 30, 30, 1)) t(i, s, a, b, k)) SELECT vec_id, CAST(i AS INTEGER) AS range, CAST((chan - a) // k AS INTEGER) AS bin, s || ':' || (a + (chan - a) // k * k) || '~' || least(a + (chan - a) // k * k + k - 1, b) AS name, round(avg(value), 6) AS value, count(*) AS n FROM {LONG}, r WHERE label = s AND chan BETWEEN a AND b GROUP BY 1, 2, 3, 4")
add("accumulators", lambda s, d: rounded(average.merge_accumulated([average.accumulate(fact(s, d).where(F.col("part") % 3 == i), ["spw"], "value", F.col("weight")) for i in range(3)], ["spw"]), digits=4), f"SELECT spw, round(sum(value * weight) / sum(weight), 4) AS value, round(sum(weight), 4) AS weight, count(*) AS n FROM {FACT} GROUP BY spw")
add("flags_and_weights", lambda s, d: rounded(average.flags_and_weights(fact(s, d), ["scan"], F.col("flag"), F.col("weight"))), f"SELECT scan, NOT bool_or(NOT flag) AS flag, round(coalesce(sum(weight) FILTER (WHERE NOT flag), sum(weight)), 6) AS weight FROM {FACT} GROUP BY scan")
add("channel_flags_collapse", lambda s, d: rounded((lambda p: spectra(s, d).withColumn("f", F.transform("v", lambda x: x > 0)).select("vec_id", p[0].alias("flag_row"), p[1].alias("weight")))(average.collapse_channels(F.col("f"), F.col("v")))),
    f"SELECT vec_id, bool_and(value > 0) AS flag_row, round(coalesce(avg(value) FILTER (WHERE value <= 0), 0), 6) AS weight FROM {LONG} GROUP BY vec_id")
for _which, _sql in (("data", "re"), ("corrected", "re * 2"), ("residual", "re * 2 - im"), ("residual_data", "re - im")):
    add(f"statwt_column_{_which}", lambda s, d, w=_which: rounded(cvis(s, d).groupBy("spw").agg(F.var_pop(average.weighted_column(w, F.col("re"), F.col("re") * 2, F.col("im"))).alias("variance")), digits=3), f"SELECT spw, round(var_pop({_sql}), 3) AS variance FROM {CVIS} GROUP BY spw")
for _name, _zero, _sql in (("mean", False, "var_pop(value) FILTER (WHERE NOT flag)"), ("zero", True, "avg(value * value) FILTER (WHERE NOT flag)")):
    add(f"weights_by_rms_{_name}", lambda s, d, z=_zero: rounded(average.weigh_by_rms(fact(s, d), ["ant", "spw"], "value", F.col("flag"), z).select("scan", "spw", "npts", (F.col("weight") * 1e9).alias("w"), "weight_flag"), digits=4),
        f"WITH g AS (SELECT ant, spw, count(*) FILTER (WHERE NOT flag) AS npts, {_sql} AS var FROM {FACT} GROUP BY ant, spw) SELECT scan, f.spw, npts, round(CASE WHEN npts >= 2 AND var > 0 THEN 1 / var ELSE 0 END * 1e9, 4)::DOUBLE AS w, NOT (npts >= 2 AND coalesce(var > 0, false)) OR flag AS weight_flag FROM {FACT} f JOIN g USING (ant, spw)")
for _mode, _sql in (("ones", "1.0"), ("nyq", "2 * weight * spw"), ("sigma", "CASE WHEN weight - 20 > 0 THEN 1 / pow(weight - 20, 2) ELSE 0 END"), ("tsys", "2 * weight * spw / pow(CASE WHEN ant % 3 > 0 THEN 50.0 + ant END, 2)")):
    add(f"initial_weights_{_mode}", lambda s, d, m=_mode: rounded(average.initial_weights(fact(s, d), m, F.col("weight"), F.col("spw"), F.col("weight") - 20, fact(s, d).select("ant").distinct().where("ant % 3 > 0").select("ant", (50.0 + F.col("ant")).alias("tsys")), ["ant"]).select("scan", "spw", "weight")),
        f"SELECT scan, spw, round({_sql}, 6)::DOUBLE AS weight FROM {FACT}")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Rows whose place and time are those of their run's number, so that runs are known."""
    rows = vis(s, d).where("row_id < 600").select((F.col("row_id") % 6).alias("b"), F.expr("row_id div 6").alias("i"), "value")
    rows = rows.withColumn("t", F.col("i") * 10.0).withColumn("u", F.expr("i div 7") * 50.0).withColumn("w", F.lit(0.0))
    return rounded(average.baseline_average(rows, ["b"], "t", "u", "w", "value", 30.0, 35.0))


add("baseline_dependent_average", _runs,
    f"WITH r AS (SELECT row_id % 6 AS b, row_id // 6 AS i, value FROM {VIS} WHERE row_id < 600), g AS (SELECT *, i // 7 * 2 + CASE WHEN i % 7 > 3 THEN 1 ELSE 0 END AS run FROM r) SELECT b, run, count(*) AS n, avg(i * 10.0)::DOUBLE AS t, round(avg(value), 6) AS value FROM g GROUP BY b, run")

# --- flags --------------------------------------------------------------------------------------------------------
_FM = f"WITH l AS (SELECT vec_id, chan, value, label FROM {LONG}), m AS (SELECT *, abs(value - median(value) OVER (PARTITION BY vec_id ORDER BY chan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS d FROM l), s AS (SELECT vec_id, median(d) AS s FROM m GROUP BY vec_id)"
add("flag_spectral_median", lambda s, d: flag.spectral_median_clip(long(s, d), "value", ["vec_id"], "chan", 2, 4.0).where("clipped").select("vec_id", "chan"), f"{_FM} SELECT vec_id, CAST(chan AS INTEGER) AS chan FROM m JOIN s USING (vec_id) WHERE d > 4 * s")
add("flag_spectral_rejection", lambda s, d: flag.spectral_rejection(long(s, d), "value", ["vec_id"], "chan", 2.5).where("rejected").select("vec_id", "chan"),
    f"WITH f AS (SELECT vec_id, regr_slope(value, chan) AS b, regr_intercept(value, chan) AS a FROM {LONG} GROUP BY 1), q AS (SELECT vec_id, chan, value - a - b * chan AS x FROM {LONG} JOIN f USING (vec_id)), s AS (SELECT vec_id, sqrt(avg(x * x)) AS s FROM q GROUP BY 1) SELECT vec_id, CAST(chan AS INTEGER) AS chan FROM q JOIN s USING (vec_id) WHERE abs(x) > 2.5 * s")
add("flag_row_clip", lambda s, d: flag.row_clip(long(s, d), "value", ["vec_id"], ["label"], 2.0).select("vec_id", "clipped"),
    f"WITH q AS (SELECT vec_id, label, avg(value) AS m FROM {LONG} GROUP BY 1, 2), c AS (SELECT label, median(m) AS c FROM q GROUP BY 1), e AS (SELECT vec_id, label, abs(m - c) AS e FROM q JOIN c USING (label)), s AS (SELECT label, median(e) AS s FROM e GROUP BY 1) SELECT vec_id, e > 2 * s AS clipped FROM e JOIN s USING (label)")
add("flag_rflag_spectral", lambda s, d: flag.rflag_spectral(long(s, d), "value", ["vec_id"], ["label"], "chan", 1, 3.0).where("rflag").select("vec_id", "chan"),
    f"WITH q AS (SELECT vec_id, label, chan, abs(value - avg(value) OVER (PARTITION BY vec_id ORDER BY chan ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS x FROM {LONG}), t AS (SELECT label, 3 * median(x) AS t FROM q GROUP BY 1) SELECT vec_id, CAST(chan AS INTEGER) AS chan FROM q JOIN t USING (label) WHERE x > t")
_RP = "SELECT row_id, ant, spw, value, f, stddev_pop(CASE WHEN NOT f THEN value END) OVER (PARTITION BY ant, spw ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM {}"
add("flag_rflag_passes", lambda s, d: flag.rflag_passes(vis(s, d), "value", ["ant", "spw"], ["spw"], "row_id", 2, 1.5, 2).where("rflag").select("row_id"),
    f"WITH a0 AS (SELECT row_id, ant, spw, value, false AS f FROM {VIS}), b0 AS ({_RP.format('a0')}), t0 AS (SELECT spw, 1.5 * median(s) FILTER (WHERE NOT f) AS t FROM b0 GROUP BY 1), a1 AS (SELECT row_id, ant, b0.spw, value, f OR coalesce(s > t, false) AS f FROM b0 JOIN t0 USING (spw)), b1 AS ({_RP.format('a1')}), t1 AS (SELECT spw, 1.5 * median(s) FILTER (WHERE NOT f) AS t FROM b1 GROUP BY 1) SELECT row_id FROM b1 JOIN t1 USING (spw) WHERE f OR coalesce(s > t, false)")


def _cropped(s: SparkSession, d: str) -> DataFrame:
    """A smooth surface with spikes of known places, which alone are to be found."""
    rows = s.range(12 * 40 * 30).select((F.col("id") % 12).alias("b"), (F.expr("id div 12") % 40).alias("t"), F.expr("id div 480").alias("chan"))
    spike = (F.col("b") * 7 + F.col("t") * 3 + F.col("chan")) % 97 == 0
    v = 5 + 0.02 * F.col("t") - 0.01 * F.col("chan") + F.when(spike, 30.0).otherwise(0.001 * ((F.col("t") * 31 + F.col("chan") * 17) % 13))
    return flag.time_freq_crop(rows.withColumn("value", v), ["b"], "t", "chan", "value", 4.0, 3, pieces=2).where("cropped").select("b", "t", "chan")


add("flag_tfcrop", _cropped, "SELECT b, t, c AS chan FROM range(12) x(b), range(40) y(t), range(30) z(c) WHERE (b * 7 + t * 3 + c) % 97 = 0")


def _mapped(s: SparkSession, d: str) -> DataFrame:
    v = cvis(s, d).select("scan", "spw", F.col("re").alias("re_xx"), F.col("im").alias("im_xx"), F.col("im").alias("re_yy"), F.col("u").alias("im_yy"))
    return rounded(v.select("scan", "spw", *(flag.value_of(x).alias(n) for n, x in (("a", "ABS(XX)-ABS(YY)"), ("b", "RE(XX)+IM(YY)"), ("c", "ARG(XX)"), ("d", "NORM(YY)"), ("e", "XX")))), digits=7)


add("flag_value_mappers", _mapped, f"SELECT scan, spw, round(sqrt(re * re + im * im) - sqrt(im * im + u * u), 7) AS a, round(re + u, 7) AS b, round(atan2(im, re), 7) AS c, round(im * im + u * u, 7) AS d, round(sqrt(re * re + im * im), 7) AS e FROM {CVIS}")
add("flag_cyclic_angles", lambda s, d: rounded(fact(s, d).select("scan", "spw", flag.angle_apart(F.col("weight"), F.col("spw") * 2.0).alias("apart"))), f"WITH q AS (SELECT scan, spw, weight - spw * 2.0 AS x FROM {FACT}), p AS (SELECT scan, spw, x - floor(x / (2 * pi())) * 2 * pi() AS y FROM q) SELECT scan, spw, round(least(y, 2 * pi() - y), 6) AS apart FROM p")
add("flag_report", lambda s, d: flag.report({"clip": (vis(s, d).withColumn("f", F.col("value") > 90), "f"), "manual": (vis(s, d).withColumn("f", F.col("k") == 3), "f")}, ["spw"]),
    f"SELECT 'clip' AS agent, spw, CAST(sum((value > 90)::INT) AS BIGINT) AS flagged, count(*) AS total FROM {VIS} GROUP BY spw UNION ALL SELECT 'manual', spw, CAST(sum((k = 3)::INT) AS BIGINT), count(*) FROM {VIS} GROUP BY spw")
add("flag_quack_increment", lambda s, d: flag.quack(vis(s, d).withColumn("flag", F.col("value") > 70), "t", ["ant", "spw"], 86400.0, "beg", "flag", increment=True).select("row_id", "quack"),
    f"SELECT row_id, coalesce(t <= min(CASE WHEN value <= 70 THEN t END) OVER (PARTITION BY ant, spw) + 86400, false) AS quack FROM {VIS}")


# --- spectra ------------------------------------------------------------------------------------------------------
def _channels(f) -> object:
    return lambda s, d: rounded(spectra(s, d).select("vec_id", F.posexplode(f(F.col("v"))).alias("chan", "value")))


_NEAR = f"(SELECT vec_id, chan, value, lag(value) OVER w AS p, lead(value) OVER w AS q FROM {LONG} WINDOW w AS (PARTITION BY vec_id ORDER BY chan))"
add("hanning_flags", lambda s, d: spectra(s, d).select("vec_id", F.posexplode(spectral.hanning_flags(F.transform("v", lambda x: x > 0.2))).alias("chan", "flag")), f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, value > 0.2 OR coalesce(p > 0.2, false) OR coalesce(q > 0.2, false) AS flag FROM {_NEAR}")
add("hanning_weights", _channels(lambda v: spectral.hanning_weights(F.transform(v, lambda x: F.greatest(x + 0.3, F.lit(0.0))))),
    f"WITH w AS (SELECT vec_id, chan, greatest(value + 0.3, 0) AS x, greatest(p + 0.3, 0) AS p, greatest(q + 0.3, 0) AS q, p IS NULL AS first, q IS NULL AS last FROM {_NEAR}) SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(CASE WHEN x <= 0 OR (NOT first AND p <= 0) OR (NOT last AND q <= 0) THEN 0 WHEN first THEN 1 / (0.25 / x + 0.25 / q) WHEN last THEN 1 / (0.25 / p + 0.25 / x) ELSE 1 / (0.0625 / p + 0.25 / x + 0.0625 / q) END, 6)::DOUBLE AS value FROM w")
add("hanning_decimate", _channels(spectral.hanning_decimated), f"SELECT vec_id, CAST((chan - 1) // 2 AS INTEGER) AS chan, round(0.25 * p + 0.5 * value + 0.25 * q, 6) AS value FROM {_NEAR} WHERE chan % 2 = 1 AND chan < 63")
add("hanning_decimate_mean", _channels(lambda v: spectral.hanning_decimated(v, "mean")), f"WITH h AS (SELECT vec_id, chan, 0.25 * p + 0.5 * value + 0.25 * q AS h FROM {_NEAR} WHERE chan BETWEEN 1 AND 62) SELECT vec_id, CAST((chan - 1) // 2 AS INTEGER) AS chan, round(avg(h), 6) AS value FROM h GROUP BY 1, 2")
add("boxcar_decimate", _channels(lambda v: spectral.boxcar_decimated(v, 4)), f"SELECT vec_id, CAST(chan // 4 AS INTEGER) AS chan, round(avg(value), 6) AS value FROM {LONG} GROUP BY 1, 2")
add("boxcar_reference", lambda s, d: s.createDataFrame([(w, spectral.boxcar_reference(100.0, 0.5, w)) for w in (1, 2, 5)], "width long, value double"), "SELECT w::BIGINT AS width, 100.0::DOUBLE + 0.5 * (w - 1) / 2 AS value FROM (VALUES (1), (2), (5)) t(w)")
add("sd_smooth_gaussian", _channels(lambda v: spectral.convolve(v, spectral.smoothing_kernel("gaussian", 3.0))),
    f"WITH k AS (SELECT i, exp(-0.5 * pow(i / (3 / 2.3548200450309493), 2)) AS g FROM range(-4, 5) r(i)) SELECT vec_id, CAST(c AS INTEGER) AS chan, round(sum(v[least(greatest(c + i, 0), 63) + 1] * g) / sum(g), 6) AS value FROM {SPECTRA}, range(64) q(c), k GROUP BY 1, 2")
_LEG = "(SELECT i AS chan, x, 1.0::DOUBLE AS p0, x AS p1, (3 * x * x - 1) / 2 AS p2, (5 * x * x * x - 3 * x) / 2 AS p3, i < 20 OR i >= 44 AS free FROM (SELECT i, 2.0::DOUBLE * i / 63 - 1 AS x FROM range(64) r(i)))"
_GS = "WITH b0 AS (SELECT * FROM " + _LEG + "), n0 AS (SELECT *, p0 / sqrt(sum(p0 * p0) FILTER (WHERE free) OVER ()) AS q0 FROM b0), n1 AS (SELECT *, p1 - q0 * sum(p1 * q0) FILTER (WHERE free) OVER () AS r1 FROM n0), m1 AS (SELECT *, r1 / sqrt(sum(r1 * r1) FILTER (WHERE free) OVER ()) AS q1 FROM n1), n2 AS (SELECT *, p2 - q0 * sum(p2 * q0) FILTER (WHERE free) OVER () - q1 * sum(p2 * q1) FILTER (WHERE free) OVER () AS r2 FROM m1), m2 AS (SELECT *, r2 / sqrt(sum(r2 * r2) FILTER (WHERE free) OVER ()) AS q2 FROM n2), n3 AS (SELECT *, p3 - q0 * sum(p3 * q0) FILTER (WHERE free) OVER () - q1 * sum(p3 * q1) FILTER (WHERE free) OVER () - q2 * sum(p3 * q2) FILTER (WHERE free) OVER () AS r3 FROM m2), m3 AS (SELECT chan, free, q0, q1, q2, r3 / sqrt(sum(r3 * r3) FILTER (WHERE free) OVER ()) AS q3 FROM n3), j AS (SELECT vec_id, l.chan, value, free, q0, q1, q2, q3 FROM " + LONG + " l JOIN m3 ON m3.chan = l.chan)"
add("continuum_sub_order3", lambda s, d: rounded(spectra(s, d).select("vec_id", F.posexplode(spectral.subtract_polynomial(F.col("v"), 64, [(0, 19), (44, 63)], 3)).alias("chan", "value"))),
    f"{_GS} SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(value - {' - '.join(f'q{i} * sum(value * q{i}) FILTER (WHERE free) OVER (PARTITION BY vec_id)' for i in range(4))}, 6) AS value FROM j")
add("image_continuum_sub", lambda s, d: rounded(spectral.pack_channels(cube(s, d).select("x", "y", "chan", "value"), ["x", "y"]).where("size(spectrum) = 7").select("x", "y", F.posexplode(spectral.subtract_line(F.col("spectrum"), F.array(*(F.lit(i not in (2, 3)) for i in range(7))), 1)).alias("chan", "value")), digits=4),
    f"WITH c AS (SELECT x, y, chan - 1 AS chan, value, count(*) OVER (PARTITION BY x, y) AS n FROM {CUBE}), w AS (SELECT *, chan NOT IN (2, 3) AS free FROM c WHERE n = 7) SELECT x, y, CAST(chan AS INTEGER) AS chan, round(value - (regr_intercept(value, chan) FILTER (WHERE free) OVER q + chan * regr_slope(value, chan) FILTER (WHERE free) OVER q), 4) + 0.0 AS value FROM w WINDOW q AS (PARTITION BY x, y)")
add("regrid_regular", lambda s, d: rounded(spectral.regrid(spectra(s, d), ["vec_id"], F.transform("v", lambda _, i: 10 + 0.5 * i.cast("double")), 9.75, 0.75, 45, "v", regular=True).select("vec_id", F.posexplode("v").alias("chan", "value"))),
    f"WITH g AS (SELECT i, (9.75::DOUBLE + 0.75 * i - 10) / 0.5 AS x FROM range(45) r(i)), h AS (SELECT i, x, CAST(floor(x) AS INTEGER) AS k FROM g) SELECT vec_id, CAST(i AS INTEGER) AS chan, round(CASE WHEN x < 0 OR x > 63 THEN NULL WHEN x = k THEN v[k + 1] ELSE v[k + 1] + (v[k + 2] - v[k + 1]) * (x - k) END, 6) AS value FROM {SPECTRA}, h")
add("velocity_regrid", lambda s, d: rounded(spectral.cvel(spectra(s, d), ["vec_id"], 200.0, -3000.0, 20, 1.0e9, 1.0e9 - 10000, 400.0).select("vec_id", F.posexplode("v").alias("chan", "value")), digits=5),
    f"WITH g AS (SELECT i, (1e9 * (1 - (-3000.0 + 200.0 * i) / 299792458.0) - (1e9 - 10000)) / 400.0 AS x FROM range(20) r(i)), h AS (SELECT i, x, CAST(floor(x) AS INTEGER) AS k FROM g) SELECT vec_id, CAST(i AS INTEGER) AS chan, round(CASE WHEN x < 0 OR x > 63 THEN NULL ELSE v[k + 1] + coalesce(v[k + 2] - v[k + 1], 0) * (x - k) END, 5) AS value FROM {SPECTRA}, h")
add("combine_windows", lambda s, d: rounded(spectral.combine_windows(long(s, d).withColumn("f", F.col("chan") * 1.3 + F.col("label") * 0.25).withColumn("w", F.col("label") + 1.0), ["label"], "f", "value", "w", 0.0, 1.0, 80)),
    f"WITH q AS (SELECT label, value, label + 1.0 AS w, CAST(round(chan * 1.3 + label * 0.25) AS INTEGER) AS c FROM {LONG}) SELECT label, c AS chan, round(sum(value * w) / sum(w), 6)::DOUBLE AS value, sum(w)::DOUBLE AS weight FROM q WHERE c >= 0 AND c < 80 GROUP BY 1, 2")



add("rotation_measure_errors", lambda s, d: rounded(fit.rotation_measure_fit(long(s, d), ["label"], F.col("value"), 0.1 + 0.01 * F.col("chan"), 0.1 + 0.002 * F.col("chan"))),
    f"WITH q AS (SELECT label, value AS y, pow(0.1 + 0.01 * chan, 2) AS x, 1 / pow(0.1 + 0.002 * chan, 2) AS w FROM {LONG}), g AS (SELECT label, count(*) AS n, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, max(x) - min(x) AS span FROM q GROUP BY label), f AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS rm, s * sxx - sx * sx AS d FROM g), h AS (SELECT *, (sy - rm * sx) / s AS pa0 FROM f) SELECT h.label, round(any_value(rm), 6) AS rm, round(any_value(sqrt(s / d)), 6) AS rm_err, round(any_value(pa0), 6) AS pa0, round(any_value(sqrt(sxx / d)), 6) AS pa0_err, round(sum(w * pow(y - pa0 - rm * x, 2)) / (any_value(n) - 2), 6) AS redchi2, CAST(floor(abs(any_value(rm)) * any_value(span) / pi()) AS INTEGER) AS nturns FROM q JOIN h USING (label) GROUP BY h.label")
