"""Every registered query with its SQL twin. Computed doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import average, calibrate, fit, flag, image, search, select, spectral, stats, uvgrid
from ..session import table
from . import base, sqlshim
from .base import CATALOG, CUBE, FACT, LONG, SPECTRA, VIS, catalog, cube, fact, long, spectra, vis

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """All double columns but those to keep, rounded."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


# --- statistics -------------------------------------------------------------------------------------------------
_STATS = ", ".join(
    [r("min(v)", "min"), r("max(v)", "max"), r("sum(v)", "sum", 4), r("sum(v * v)", "sumsq", 5), r("avg(v)", "mean"), r("var_samp(v)", "variance"), r("stddev_samp(v)", "stddev"), r("sqrt(avg(v * v))", "rms")]
    + [r("quantile_cont(v, 0.5)", "median"), r("quantile_cont(v, 0.25)", "firstquartile"), r("quantile_cont(v, 0.75)", "thirdquartile")]
)


def _stats(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("sum", F.round("sum", 4)).withColumn("sumsq", F.round("sumsq", 5)))


add("visstat_by_user_type", lambda s, d: _stats(stats.statistics(vis(s, d), F.col("value"), ["ant", "spw"])), f"SELECT ant, spw, count(v) AS npts, {_STATS} FROM (SELECT ant, spw, value AS v FROM {VIS}) GROUP BY ant, spw")
add(
    "visstat_flagged", lambda s, d: _stats(stats.statistics(fact(s, d), F.col("value"), ["spw"], F.col("flag"))),
    f"SELECT spw, count(v) AS npts, {_STATS} FROM (SELECT spw, CASE WHEN NOT flag THEN value END AS v FROM {FACT}) GROUP BY spw",
)
add(
    "visstat_time_average", lambda s, d: rounded(stats.statistics(average.with_time_bin(vis(s, d), "t", ["spw"], 3600.0), F.col("value"), ["spw", "bin"], quantiles=False).select("spw", "bin", "npts", "mean", "rms")),
    f"SELECT spw, CAST(floor((t - t0) / 3600.0) AS BIGINT) AS bin, count(*) AS npts, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms FROM (SELECT *, min(t) OVER (PARTITION BY spw) AS t0 FROM {VIS}) GROUP BY 1, 2",
)
add("calstat_deviation", lambda s, d: rounded(stats.deviation_median(vis(s, d), "value", ["spw"])),
    f"WITH m AS (SELECT spw, median(value) AS m FROM {VIS} GROUP BY spw) SELECT spw, round(any_value(m), 6) AS median, round(median(abs(value - m)), 6) AS medabsdevmed FROM {VIS} JOIN m USING (spw) GROUP BY spw")
add("weighted_mean", lambda s, d: rounded(fact(s, d).groupBy("spw").agg(stats.weighted_mean(F.col("value"), F.col("weight")).alias("mean"))), f"SELECT spw, round(sum(value * weight) / sum(weight), 6) AS mean FROM {FACT} GROUP BY spw")
add("robust_fences", lambda s, d: rounded(stats.hinges_fences(vis(s, d), "value", ["spw"]).groupBy("spw").agg(F.count("*").alias("npts"), F.avg("value").alias("mean"))),
    f"WITH q AS (SELECT spw, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM {VIS} GROUP BY spw) SELECT spw, count(*) AS npts, round(avg(value), 6) AS mean FROM {VIS} JOIN q USING (spw) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY spw")
add("robust_zscore", lambda s, d: rounded(stats.z_score(vis(s, d), "value", ["spw"], 2.0).groupBy("spw").agg(F.count("*").alias("npts"), F.avg("value").alias("mean"))),
    f"WITH q AS (SELECT spw, avg(value) AS m, stddev_samp(value) AS s FROM {VIS} GROUP BY spw) SELECT spw, count(*) AS npts, round(avg(value), 6) AS mean FROM {VIS} JOIN q USING (spw) WHERE abs(value - m) <= 2.0 * s GROUP BY spw")
_CHAUVENET = "(sqrt(-2 * ln(1 / (4 * n))) - (2.515517 + 0.802853 * sqrt(-2 * ln(1 / (4 * n))) + 0.010328 * (-2 * ln(1 / (4 * n)))) / (1 + 1.432788 * sqrt(-2 * ln(1 / (4 * n))) + 0.189269 * (-2 * ln(1 / (4 * n))) + 0.001308 * pow(-2 * ln(1 / (4 * n)), 1.5)))"
add("robust_chauvenet", lambda s, d: rounded(stats.z_score(vis(s, d), "value", ["spw"]).groupBy("spw").agg(F.count("*").alias("npts"), F.avg("value").alias("mean"))),
    f"WITH q AS (SELECT spw, avg(value) AS m, stddev_samp(value) AS s, count(*)::DOUBLE AS n FROM {VIS} GROUP BY spw) SELECT spw, count(*) AS npts, round(avg(value), 6) AS mean FROM {VIS} JOIN q USING (spw) WHERE abs(value - m) <= {_CHAUVENET} * s GROUP BY spw")
add("robust_fit_to_half", lambda s, d: rounded(stats.fit_to_half(vis(s, d), "value", ["spw"])),
    f"WITH q AS (SELECT spw, avg(value) AS m FROM {VIS} GROUP BY spw) SELECT spw, 2 * count(*) AS npts, round(any_value(m), 6) AS mean, round(2 * sum(pow(value - m, 2)) / (2 * count(*) - 1), 6) AS variance FROM {VIS} JOIN q USING (spw) WHERE value <= m GROUP BY spw")
add("robust_biweight", lambda s, d: rounded(stats.biweight(vis(s, d), "value", ["spw"])),
    f"WITH m AS (SELECT spw, median(value) AS m FROM {VIS} GROUP BY spw), a AS (SELECT spw, any_value(m) AS m, median(abs(value - m)) AS mad FROM {VIS} JOIN m USING (spw) GROUP BY spw), u AS (SELECT spw, value, (value - m) / (6.0 * mad) AS u FROM {VIS} JOIN a USING (spw)) SELECT spw, count(*) AS npts, round(sum(CASE WHEN abs(u) < 1 THEN pow(1 - u * u, 2) ELSE 0 END * value) / sum(CASE WHEN abs(u) < 1 THEN pow(1 - u * u, 2) ELSE 0 END), 6) AS location FROM u GROUP BY spw")
_BIN = "least(CAST(floor((value - 0.0) / 10.0) AS INTEGER), 9)"
add("histogram_counts", lambda s, d: rounded(stats.histogram(vis(s, d), "value", ["spw"], 10, 0.0, 100.0)), f"SELECT spw, {_BIN} AS bin, count(*) AS counts, round({_BIN} * 10.0 + 5.0, 6)::DOUBLE AS centre FROM {VIS} WHERE value BETWEEN 0 AND 100 GROUP BY spw, {_BIN}")
add("histogram_cumulative", lambda s, d: rounded(stats.histogram(vis(s, d), "value", ["spw"], 10, 0.0, 100.0, cumulative=True)),
    f"SELECT spw, bin, CAST(sum(c) OVER (PARTITION BY spw ORDER BY bin) AS BIGINT) AS counts, round(bin * 10.0 + 5.0, 6)::DOUBLE AS centre FROM (SELECT spw, {_BIN} AS bin, count(*) AS c FROM {VIS} WHERE value BETWEEN 0 AND 100 GROUP BY spw, {_BIN})")
_COLLAPSE = {
    "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "min": "min(value)", "npts": "count(value)::DOUBLE", "rms": "sqrt(avg(value * value))", "stddev": "stddev_samp(value)",
    "sum": "sum(value)", "variance": "var_samp(value)", "zero": "0.0::DOUBLE", "flux": "sum(value) / 4.0", "sqrtsum": "sqrt(sum(value))", "sqrtsum_npix": "sqrt(sum(value)) / count(value)",
    "sqrtsum_npix_beam": "sqrt(sum(value)) / (count(value) / 4.0)",
}
for _how, _sql in _COLLAPSE.items():
    add(f"collapse_{_how}", lambda s, d, h=_how: rounded(stats.collapse(cube(s, d), h, "value", ["x", "chan"], 4.0), digits=4), f"SELECT x, chan, {r(_sql, 'value', 4)} FROM {CUBE} GROUP BY x, chan")
for _how, _f in (("madm", 1.0), ("xmadm", C.XMADM)):
    add(f"collapse_{_how}", lambda s, d, h=_how: rounded(stats.collapse(cube(s, d), h, "value", ["x", "chan"]), digits=7),
        f"WITH c AS (SELECT * FROM {CUBE}), m AS (SELECT x, chan, median(value) AS m FROM c GROUP BY x, chan) SELECT x, chan, round(median(abs(value - m)) * {_f!r}::DOUBLE, 7) AS value FROM c JOIN m USING (x, chan) GROUP BY x, chan")
add("moments", lambda s, d: rounded(stats.moments(cube(s, d), "value", "chan", ["x", "y"], [-1, 0, 1, 2, 3, 6, 8, 9, 10, 11]), digits=7),
    f"SELECT x, y, round(avg(value), 7) AS moment_m1, round(sum(value), 7) AS moment_0, round(sum(value * chan) / sum(value), 7) AS moment_1, round(sqrt(abs(sum(value * chan * chan) / sum(value) - pow(sum(value * chan) / sum(value), 2))), 7) AS moment_2, round(median(value), 7) AS moment_3, round(sqrt(avg(value * value)), 7) AS moment_6, round(max(value), 7) AS moment_8, arg_max(chan, (value, -chan)) AS moment_9, round(min(value), 7) AS moment_10, arg_min(chan, (value, chan)) AS moment_11 FROM {CUBE} GROUP BY x, y")
add("image_stats_minpos_maxpos", lambda s, d: rounded(stats.positions(cube(s, d), "value", ["x", "y"], ["chan"])),
    f"SELECT chan, round(min(value), 6) AS min, round(max(value), 6) AS max, arg_min(x, (value, x, y)) AS min_x, arg_min(y, (value, x, y)) AS min_y, arg_max(x, (value, -x, -y)) AS max_x, arg_max(y, (value, -x, -y)) AS max_y FROM {CUBE} GROUP BY chan")
add("flag_summary", lambda s, d: stats.flag_summary(fact(s, d).withColumn("year", F.floor(F.col("t") / 31557600).cast("int")), "flag", [["spw"], ["ant"], ["ant", "year"], []]),
    f"SELECT spw, ant, year, CAST(sum(flag::INT) AS BIGINT) AS flagged, count(*) AS total FROM (SELECT *, CAST(floor(t / 31557600) AS INTEGER) AS year FROM {FACT}) GROUP BY GROUPING SETS ((spw), (ant), (ant, year), ())")
add("flux_profile", lambda s, d: rounded(stats.flux_profile(cube(s, d), "value", "chan", F.col("chan") * F.lit(2.5)), digits=3),
    f"WITH p AS (SELECT chan, count(value) AS npts, sum(value) AS flux, avg(value) AS mean, median(value) AS median, chan * 2.5::DOUBLE AS coord FROM {CUBE} GROUP BY chan) SELECT chan, npts, round(flux, 3) AS flux, round(mean, 3) AS mean, round(median, 3) AS median, coord, coalesce(abs(lead(coord) OVER (ORDER BY chan) - coord), abs(coord - lag(coord) OVER (ORDER BY chan))) AS step FROM p")
add("goodness_of_fit", lambda s, d: rounded(fit.goodness(fact(s, d), ["spw", "flag"], F.col("value") / F.col("weight")), digits=7),
    f"SELECT spw, flag, count(*) AS count, round(avg(value / weight), 7) AS average, round(min(value / weight), 7) AS min, round(max(value / weight), 7) AS max FROM {FACT} GROUP BY spw, flag")

# --- selection ----------------------------------------------------------------------------------------------------
add("select_channels", lambda s, d: long(s, d).where(select.channels("chan", "<4,10~12;11~15,60", 64)).groupBy("chan").agg(F.count("*").alias("n")), f"SELECT chan, count(*) AS n FROM {LONG} WHERE chan BETWEEN 0 AND 3 OR chan BETWEEN 10 AND 15 OR chan = 60 GROUP BY chan")
add("select_keyed", lambda s, d: select.select(vis(s, d), {"time": "t", "spw": "spw", "antenna": "ant,k"}, time="2024/01/03~2024/01/09/12:00:00", spw="c*,view", antenna="!3&7").select("row_id"),
    f"SELECT row_id FROM {VIS} WHERE t BETWEEN 1704240000 AND 1704801600 AND (spw LIKE 'c%' OR spw = 'view') AND NOT (((ant = 3 AND k = 7) OR (k = 3 AND ant = 7)) AND ant <> k)")
add("select_uv_range", lambda s, d: fact(s, d).where(select.uv_range("ant", "weight", "10~60")).groupBy("spw").agg(F.count("*").alias("n")), f"SELECT spw, count(*) AS n FROM {FACT} WHERE sqrt(ant * ant + weight * weight) BETWEEN 10 AND 60 GROUP BY spw")
add("select_unflagged_rows", lambda s, d: spectra(s, d).select("vec_id", F.transform("v", lambda x: x < 0.2).alias("flag"), (F.col("label") == 3).alias("bad")).where(select.unflagged("bad", "flag")).select("vec_id"),
    f"SELECT vec_id FROM {SPECTRA} WHERE NOT (label = 3 OR list_bool_and(list_transform(v, lambda x: x < 0.2)))")
add("query_dialect", lambda s, d: sqlshim.query(vis(s, d), "SELECT row_id, ant, value FROM t WHERE ant == 7 && spw IN ['click', 'view'] && !(value < 10) ORDERBY value DESC, row_id LIMIT 50"), f"SELECT row_id, ant, value FROM {VIS} WHERE ant = 7 AND spw IN ('click', 'view') AND NOT value < 10 ORDER BY value DESC, row_id LIMIT 50")
add("query_dialect_offset", lambda s, d: sqlshim.query(catalog(s, d), "SELECT line_id, frequency FROM t ORDERBY frequency, line_id LIMIT 10 OFFSET 20"), f"SELECT line_id, frequency FROM {CATALOG} ORDER BY frequency, line_id LIMIT 10 OFFSET 20")
add("strided_cells", lambda s, d: select.strided(vis(s, d), "row_id", 5, 100, 7).select("row_id", "value"), f"SELECT row_id, value FROM {VIS} WHERE row_id >= 5 AND (row_id - 5) % 7 = 0 AND row_id < 705")
add("filter_rules", lambda s, d: select.sorted_rules(catalog(s, d), [("el", ">", 20, False), ("species", "contains", "#1", False), ("chemname", "=", "STANDARD", True)]).select("line_id"), f"SELECT line_id FROM {CATALOG} WHERE el > 20 AND species LIKE '%#1%' AND chemname <> 'STANDARD'")

# --- joins --------------------------------------------------------------------------------------------------------
_CALSQL = f"(SELECT ant, tick // 3600000000 * 3600000000 AS tick, avg(value) AS gain FROM {VIS} WHERE spw = 'click' GROUP BY 1, 2)"


def _cal(s: SparkSession, d: str) -> DataFrame:
    return vis(s, d).where("spw = 'click'").groupBy("ant", F.expr("tick div 3600000000 * 3600000000").alias("tick")).agg(F.avg("value").alias("gain"))


def _asof(how: str) -> Query:
    return lambda s, d: rounded(calibrate.asof(vis(s, d).where("spw <> 'click'").select("row_id", "ant", "tick"), _cal(s, d), ["ant"], "tick", ["gain"], how).select("row_id", "gain"))


_LEFT = f"(SELECT row_id, ant, tick FROM {VIS} WHERE spw <> 'click')"
_TWO = f"WITH c AS (SELECT * FROM {_CALSQL}), l AS (SELECT * FROM {_LEFT}), a AS (SELECT l.row_id, l.tick, c.tick AS ta, c.gain AS ga FROM l ASOF LEFT JOIN c ON l.ant = c.ant AND l.tick >= c.tick), b AS (SELECT l.row_id, c.tick AS tb, c.gain AS gb FROM l ASOF LEFT JOIN c ON l.ant = c.ant AND l.tick <= c.tick)"
add("cal_asof_previous", _asof("previous"), f"{_TWO} SELECT row_id, round(ga, 6) AS gain FROM a")
add("cal_asof_next", _asof("next"), f"{_TWO} SELECT row_id, round(gb, 6) AS gain FROM b")
add("cal_asof_nearest", _asof("nearest"), f"{_TWO} SELECT row_id, round(CASE WHEN tb IS NULL OR tick - ta <= tb - tick THEN ga ELSE gb END, 6) AS gain FROM a JOIN b USING (row_id)")
add("cal_asof_linear", _asof("linear"), f"{_TWO} SELECT row_id, round(CASE WHEN ta IS NULL THEN gb WHEN tb IS NULL OR ta = tb THEN ga ELSE ga + (gb - ga) * (tick - ta)::DOUBLE / (tb - ta) END, 6) AS gain FROM a JOIN b USING (row_id)")
_SPANS = "(SELECT CAST(i AS BIGINT) AS span, 1704067200.0::DOUBLE + i * 86400 AS lo, 1704067200.0::DOUBLE + i * 86400 + 72000 AS hi FROM range(28) r(i))"


def _spans(s: SparkSession) -> DataFrame:
    return s.range(28).select(F.col("id").alias("span"), (1704067200.0 + F.col("id") * 86400).alias("lo"), (1704067200.0 + F.col("id") * 86400 + 72000).alias("hi"))


add("scan_assign_interval", lambda s, d: calibrate.assign_interval(vis(s, d).select("row_id", "t"), _spans(s), "t").groupBy("span").agg(F.count("*").alias("n")),
    f"SELECT coalesce(s.span, 0) AS span, count(*) AS n FROM {VIS} v ASOF LEFT JOIN {_SPANS} s ON v.t >= s.lo - 1e-5 GROUP BY 1")
add("range_join_spans", lambda s, d: calibrate.in_span(vis(s, d), _spans(s).withColumn("spw", F.lit("view")), ["spw"], "t", 86400.0).groupBy("span").agg(F.count("*").alias("n")), f"SELECT span, count(*) AS n FROM {VIS} v JOIN {_SPANS} s ON v.spw = 'view' AND v.t BETWEEN s.lo AND s.hi GROUP BY span")
add("spwmap", lambda s, d: calibrate.map_spw(fact(s, d), "spw", [0, 1, 1, 3, 3, 5, 5, 7]).groupBy("spw").agg(F.count("*").alias("n")), f"SELECT CAST([0, 1, 1, 3, 3, 5, 5, 7][spw + 1] AS INTEGER) AS spw, count(*) AS n FROM {FACT} GROUP BY 1")

# --- flags --------------------------------------------------------------------------------------------------------
for _name, _spec, _sql in (
    ("outside", {"low": 20.0, "high": 80.0}, "value > 80 OR value < 20 OR isnan(value)"), ("inside", {"low": 20.0, "high": 80.0, "outside": False}, "value BETWEEN 20 AND 80 OR isnan(value)"),
    ("nan_zero", {"zeros": True}, "isnan(value) OR value = 0"),
):
    add(f"flag_clip_{_name}", lambda s, d, k=_spec: vis(s, d).select("row_id", flag.clip(F.col("value"), **k).alias("flag")), f"SELECT row_id, {_sql} AS flag FROM {VIS}")
for _mode, _sql in (("beg", "t <= lo + 7200"), ("endb", "t >= hi - 7200"), ("tail", "t > lo + 7200"), ("end", "t < hi - 7200")):
    add(f"flag_quack_{_mode}", lambda s, d, m=_mode: flag.quack(vis(s, d), "t", ["ant", "spw"], 7200.0, m).select("row_id", "quack"), f"SELECT row_id, {_sql} AS quack FROM (SELECT *, min(t) OVER (PARTITION BY ant, spw) AS lo, max(t) OVER (PARTITION BY ant, spw) AS hi FROM {VIS})")
add("flag_manual", lambda s, d: vis(s, d).select("row_id", flag.manual((F.col("ant") == 3) & (F.col("spw") == "view")).alias("flag")), f"SELECT row_id, ant = 3 AND spw = 'view' AS flag FROM {VIS}")
add("flag_elevation", lambda s, d: fact(s, d).groupBy(flag.elevation(F.col("weight") * 2, F.col("weight") * 2, 10, 90).alias("low")).agg(F.count("*").alias("n")), f"SELECT weight * 2 < 10 OR weight * 2 > 90 AS low, count(*) AS n FROM {FACT} GROUP BY 1")
add("flag_extend_time", lambda s, d: flag.extend_time(vis(s, d).withColumn("flag", F.col("value") > 95), "flag", ["ant", "spw"], "tick", 600_000_000).select("row_id", "extended"), f"SELECT row_id, bool_or(value > 95) OVER (PARTITION BY ant, spw ORDER BY tick RANGE BETWEEN 600000000 PRECEDING AND 600000000 FOLLOWING) AS extended FROM {VIS}")
add("flag_grow", lambda s, d: flag.grow(vis(s, d).withColumn("flag", F.col("value") > 60), "flag", ["ant", "spw"], 40.0).select("row_id", "grown"), f"SELECT row_id, value > 60 OR 100 * avg((value > 60)::INT) OVER (PARTITION BY ant, spw) > 40 AS grown FROM {VIS}")
add("flag_grow_around", lambda s, d: flag.grow_around(vis(s, d).withColumn("flag", F.col("value") > 60), "flag", ["ant", "spw"], "row_id").select("row_id", "grown"), f"SELECT row_id, value > 60 OR (coalesce(lag(value > 60) OVER w, false) AND coalesce(lead(value > 60) OVER w, false)) AS grown FROM {VIS} WINDOW w AS (PARTITION BY ant, spw ORDER BY row_id)")
add("flag_antint", lambda s, d: flag.antenna_integrations(fact(s, d), "flag", ["scan"], "ant", 0.5).groupBy("antint").agg(F.count("*").alias("n")),
    f"WITH b AS (SELECT scan, ant, avg(flag::INT) AS f FROM {FACT} GROUP BY scan, ant), t AS (SELECT scan FROM b GROUP BY scan HAVING min(f) > 0.5) SELECT flag OR scan IN (SELECT scan FROM t) AS antint, count(*) AS n FROM {FACT} GROUP BY 1")
add("flag_median_clip", lambda s, d: flag.median_clip(vis(s, d), "value", ["ant", "spw"], "row_id", 2, 4.0).select("row_id", "clipped"),
    f"WITH m AS (SELECT row_id, ant, spw, abs(value - median(value) OVER (PARTITION BY ant, spw ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS dv FROM {VIS}), s AS (SELECT ant, spw, median(dv) AS s FROM m GROUP BY ant, spw) SELECT row_id, dv > 4.0 * s AS clipped FROM m JOIN s USING (ant, spw)")
add("flag_rflag", lambda s, d: flag.rflag(vis(s, d), "value", ["ant", "spw"], ["spw"], "row_id", 2, 1.5).select("row_id", "rflag"),
    f"WITH m AS (SELECT row_id, spw, stddev_pop(value) OVER (PARTITION BY ant, spw ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM {VIS}), t AS (SELECT spw, 1.5 * median(r) AS t FROM m GROUP BY spw) SELECT row_id, r > t AS rflag FROM m JOIN t USING (spw)")
add("rflag_threshold_merge", lambda s, d: rounded(flag.rflag_thresholds(vis(s, d).groupBy("spw", "k").agg(F.stddev_samp("value").alias("threshold")), ["spw"])), f"SELECT spw, round(median(x), 6) AS threshold FROM (SELECT spw, k, stddev_samp(value) AS x FROM {VIS} GROUP BY spw, k) GROUP BY spw")
add("flag_uv_population", lambda s, d: flag.uv_bin_population(fact(s, d), F.col("weight"), F.col("value"), 10, 10, 51.0, 120000.0, 200).groupBy("thin").agg(F.count("*").alias("n")),
    f"WITH c AS (SELECT least(floor(weight / 51.0 * 10), 9) AS a, least(floor(value / 120000.0 * 10), 9) AS b FROM {FACT}), n AS (SELECT a, b, count(*) AS p FROM c GROUP BY a, b) SELECT p < 200 AS thin, CAST(sum(p) AS BIGINT) AS n FROM n GROUP BY 1")
add("flag_shadow", lambda s, d: flag.shadow(fact(s, d).select((F.col("scan") % 500).alias("time"), F.col("part").alias("ant"), F.col("weight").alias("u"), (F.col("value") / 2000).alias("v"), F.col("part").cast("double").alias("w"), F.lit(2.0).alias("diameter"))).groupBy("time").agg(F.count("*").alias("n")),
    f"WITH a AS (SELECT DISTINCT scan % 500 AS time, part AS ant, weight AS u, value / 2000 AS v FROM {FACT}) SELECT time, count(*) AS n FROM (SELECT DISTINCT a.time, a.ant FROM a JOIN a b ON a.time = b.time AND a.ant < b.ant AND sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2)) < 2.0) GROUP BY time")
for _how, _sql in (("or", "a OR b"), ("and", "a AND b"), ("replace", "b")):
    add(f"flag_version_{_how}", lambda s, d, h=_how: vis(s, d).select("row_id", (F.col("value") > 70).alias("a")).join(vis(s, d).select("row_id", (F.col("k") > 5).alias("b")), "row_id").select("row_id", flag.merge(F.col("a"), F.col("b"), h).alias("flag")), f"SELECT row_id, {_sql} AS flag FROM (SELECT row_id, value > 70 AS a, k > 5 AS b FROM {VIS})")

# --- averages and weights -----------------------------------------------------------------------------------------
add("time_average_scan", lambda s, d: rounded(average.time_average(fact(s, d), "t", ["scan"], ["spw"], 604800.0, "value", F.col("weight"), F.col("flag"), many=True), digits=4),
    f"WITH b AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY scan)) / 604800.0) AS BIGINT) AS bin FROM {FACT}) SELECT scan, spw, bin, count(*) AS n, round(CASE WHEN bool_or(NOT flag) THEN sum(value * weight) FILTER (WHERE NOT flag) / sum(weight) FILTER (WHERE NOT flag) ELSE sum(value * weight) / sum(weight) END, 4) AS value, round(sum(weight) FILTER (WHERE NOT flag), 4) AS weight, NOT bool_or(NOT flag) AS flag, round(avg(t), 4) AS time FROM b GROUP BY scan, spw, bin")
add("time_average_window", lambda s, d: rounded(average.time_average(fact(s, d), "t", ["spw"], ["ant"], 6048000.0, "value", F.col("weight"), F.col("flag")), digits=4),
    f"WITH b AS (SELECT *, CAST(floor((t - min(t) OVER (PARTITION BY spw)) / 6048000.0) AS BIGINT) AS bin FROM {FACT}) SELECT spw, ant, bin, count(*) AS n, round(CASE WHEN bool_or(NOT flag) THEN sum(value * weight) FILTER (WHERE NOT flag) / sum(weight) FILTER (WHERE NOT flag) ELSE sum(value * weight) / sum(weight) END, 4) AS value, round(sum(weight) FILTER (WHERE NOT flag), 4) AS weight, NOT bool_or(NOT flag) AS flag, round(avg(t), 4) AS time FROM b GROUP BY spw, ant, bin")
add("channel_average", lambda s, d: rounded(average.channel_average(long(s, d), ["vec_id"], "chan", 8, "value")), f"SELECT vec_id, CAST(chan // 8 AS INTEGER) AS bin, round(avg(value), 6) AS value, count(*) AS n FROM {LONG} GROUP BY 1, 2")
add("sigma_weight", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.weight_of_sigma(F.col("weight") - 1).alias("weight"), C.sigma_of_weight(F.col("weight") - 1).alias("sigma"))), f"SELECT scan, spw, round(CASE WHEN weight - 1 > 1e-38 THEN 1 / pow(weight - 1, 2) ELSE 0 END, 6)::DOUBLE AS weight, round(CASE WHEN weight - 1 > 0 THEN 1 / sqrt(weight - 1) ELSE -1 END, 6)::DOUBLE AS sigma FROM {FACT}")
add("statwt_block", lambda s, d: rounded(average.weigh_by_scatter(fact(s, d).withColumn("im", F.col("value") / 2), ["ant", "spw"], "value", "im", "weight", 2, "flag").select("scan", "spw", (F.col("weight") * 1e6).alias("w"), "weight_flag"), digits=4),
    f"WITH g AS (SELECT ant, spw, count(*) AS n, ((sum(weight * value * value) - pow(sum(weight * value), 2) / sum(weight)) / count(*)) * 0.625 AS var FROM {FACT} WHERE NOT flag GROUP BY ant, spw), j AS (SELECT f.scan, f.spw, f.flag, CASE WHEN n >= 2 AND var > 0 THEN f.weight / var ELSE 0 END AS w FROM {FACT} f LEFT JOIN g USING (ant, spw)) SELECT scan, spw, round(w * 1e6, 4)::DOUBLE AS w, w = 0 OR flag AS weight_flag FROM j")
for _name, _rows, _half, _frame in (("sliding_time", False, 86_400_000_000, "RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING"), ("sliding_rows", True, 3, "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING")):
    _ord = "tick" if not _rows else "row_id"
    add(f"statwt_{_name}", lambda s, d, h=_half, w=_rows, o=_ord: rounded(average.weigh_by_window(vis(s, d), ["ant", "spw"], o, "value", h, w).select("row_id", "npts", (F.col("weight") * 1000).alias("w")), digits=3),
        f"SELECT row_id, n AS npts, round(CASE WHEN n >= 2 AND var > 0 THEN 1 / var ELSE 0 END * 1000, 3)::DOUBLE AS w FROM (SELECT row_id, count(value) OVER w AS n, var_pop(value) OVER w AS var FROM {VIS} WINDOW w AS (PARTITION BY ant, spw ORDER BY {_ord} {_frame}))")
for _how, _fn in (("mean", "avg"), ("median", "median")):
    add(f"smoothcal_{_how}", lambda s, d, h=_how: rounded(average.smooth_time(vis(s, d), ["ant", "spw"], "tick", "value", 172_800_000_000, h).select("row_id", "smoothed")),
        f"WITH v AS (SELECT *, count(*) OVER (PARTITION BY ant, spw) AS n FROM {VIS}) SELECT row_id, round(CASE WHEN n > 1 THEN {_fn}(value) OVER (PARTITION BY ant, spw ORDER BY tick RANGE BETWEEN 86399999999 PRECEDING AND 86400000000 FOLLOWING) ELSE value END, 6) AS smoothed FROM v")
add("phase_unwrap", lambda s, d: rounded(average.unwrap(vis(s, d).withColumn("phase", F.col("value") % 6.0 - 3.0), ["ant"], "row_id", "phase").select("row_id", "unwrapped")),
    f"WITH p AS (SELECT row_id, ant, value % 6.0 - 3.0 AS phase FROM {VIS}), q AS (SELECT *, coalesce(-round((phase - lag(phase) OVER (PARTITION BY ant ORDER BY row_id)) / (2 * pi())), 0) AS k FROM p) SELECT row_id, round(phase + 2 * pi() * sum(k) OVER (PARTITION BY ant ORDER BY row_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM q")
add("session_reindex", lambda s, d: average.gap_sessions(vis(s, d).withColumn("array", F.lit(0)), "tick", ["ant"], "spw", 86_400_000_000, "array").select("row_id", "scan"),
    f"WITH a AS (SELECT row_id, ant, spw, tick, lag(tick) OVER (PARTITION BY ant, spw ORDER BY tick) AS p FROM {VIS}), b AS (SELECT *, (p IS NULL OR tick - p > 86400000000)::INT AS n FROM a), c AS (SELECT *, sum(n) OVER (PARTITION BY ant ORDER BY tick, spw ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT row_id, CAST(last_value(CASE WHEN n = 1 THEN g END IGNORE NULLS) OVER (PARTITION BY ant, spw ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM c")

# --- spectra ------------------------------------------------------------------------------------------------------
_LAGS = f"SELECT vec_id, chan, value, lag(value) OVER w AS p, lead(value) OVER w AS q, count(*) OVER (PARTITION BY vec_id) AS n FROM {LONG} WINDOW w AS (PARTITION BY vec_id ORDER BY chan)"


def _per_channel(f) -> Query:
    return lambda s, d: rounded(spectra(s, d).select("vec_id", F.posexplode(f(F.col("v"))).alias("chan", "value")))


add("hanning", _per_channel(spectral.hanning), f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(CASE WHEN p IS NULL THEN (value + q) / 2 WHEN q IS NULL THEN (p + value) / 2 ELSE 0.25 * p + 0.5 * value + 0.25 * q END, 6) AS value FROM ({_LAGS})")
add("boxcar", _per_channel(lambda v: spectral.boxcar(v, 5)), f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(m, 6) AS value FROM (SELECT vec_id, chan, avg(value) OVER (PARTITION BY vec_id ORDER BY chan ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS m FROM {LONG}) WHERE chan <= 59")
add("decimate_copy", _per_channel(lambda v: spectral.decimate(v, 5)), f"SELECT vec_id, CAST(chan // 5 AS INTEGER) AS chan, round(value, 6) AS value FROM {LONG} WHERE chan % 5 = 0")
add("decimate_mean", _per_channel(lambda v: spectral.decimate(v, 5, "mean")), f"SELECT vec_id, CAST(chan // 5 AS INTEGER) AS chan, round(avg(value), 6) AS value FROM {LONG} WHERE chan < 60 GROUP BY 1, 2")
add("convolve_triangle", _per_channel(lambda v: spectral.convolve(v, [0.2, 0.6, 0.2])), f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, round(0.2 * coalesce(p, value) + 0.6 * value + 0.2 * coalesce(q, value), 6) + 0.0 AS value FROM ({_LAGS})")


def _free():
    return F.transform("v", lambda _, i: (i < 20) | (i >= 44))


for _order, _sql in ((0, "value - avg(value) FILTER (WHERE free) OVER w"), (1, "value - (regr_intercept(value, chan) FILTER (WHERE free) OVER w + chan * regr_slope(value, chan) FILTER (WHERE free) OVER w)")):
    add(f"continuum_sub_order{_order}", lambda s, d, o=_order: rounded(spectra(s, d).withColumn("free", _free()).select("vec_id", F.posexplode(spectral.subtract_line(F.col("v"), F.col("free"), o)).alias("chan", "value"))),
        f"SELECT vec_id, CAST(chan AS INTEGER) AS chan, round({_sql}, 6) AS value FROM (SELECT *, chan < 20 OR chan >= 44 AS free FROM {LONG}) WINDOW w AS (PARTITION BY vec_id)")
add("regrid_linear", lambda s, d: rounded(spectral.regrid(spectra(s, d), ["vec_id"], F.transform("v", lambda _, i: i.cast("double")), 0.25, 1.5, 42, "v").select("vec_id", F.posexplode("v").alias("chan", "value"))),
    f"SELECT vec_id, CAST(i AS INTEGER) AS chan, round(a + (b - a) * (0.25 + 1.5 * i - floor(0.25 + 1.5 * i)), 6)::DOUBLE AS value FROM (SELECT vec_id, i, v[CAST(floor(0.25 + 1.5 * i) AS INTEGER) + 1] AS a, v[CAST(floor(0.25 + 1.5 * i) AS INTEGER) + 2] AS b FROM {SPECTRA}, range(42) t(i))")
add("spectral_index", lambda s, d: rounded(fit.spectral_index(long(s, d).where("value > 0.01"), ["vec_id"], F.col("chan") + 1.0, F.col("value")).select("vec_id", "alpha", "n")), f"SELECT vec_id, round(regr_slope(ln(value), ln(chan + 1.0)), 6) AS alpha, count(*) AS n FROM {LONG} WHERE value > 0.01 GROUP BY vec_id")
add("rotation_measure", lambda s, d: rounded(fit.rotation_measure(long(s, d), ["label"], F.col("value"), 0.1 + 0.01 * F.col("chan")).select("label", "rm", "pa0")), f"SELECT label, round(regr_slope(value, pow(0.1 + 0.01 * chan, 2)), 6) AS rm, round(regr_intercept(value, pow(0.1 + 0.01 * chan, 2)), 6) AS pa0 FROM {LONG} GROUP BY label")
add("peak_parabola", lambda s, d: rounded(image.peak_fit(long(s, d), ["vec_id"], "chan", "value")),
    f"WITH l AS ({_LAGS}), m AS (SELECT vec_id, arg_max(chan, (value, -chan)) AS c FROM l GROUP BY vec_id) SELECT vec_id, round(chan + CASE WHEN p IS NULL OR q IS NULL OR p - 2 * value + q = 0 THEN 0 ELSE 0.5 * (p - q) / (p - 2 * value + q) END, 6)::DOUBLE AS position, round(coalesce(value - 0.25 * (p - q) * CASE WHEN p - 2 * value + q = 0 THEN 0 ELSE 0.5 * (p - q) / (p - 2 * value + q) END, value), 6) AS peak FROM l JOIN m USING (vec_id) WHERE chan = c")

# --- images -------------------------------------------------------------------------------------------------------
for _name, _test, _sql in (
    ("box", lambda x, y: image.box(x, y, 5, 8, 30, 40), "x BETWEEN 5 AND 30 AND y BETWEEN 8 AND 40"), ("circle", lambda x, y: image.circle(x, y, 30, 30, 12), "pow(x - 30, 2) + pow(y - 30, 2) <= 144"),
    ("annulus", lambda x, y: image.annulus(x, y, 30, 30, 6, 14), "pow(x - 30, 2) + pow(y - 30, 2) BETWEEN 36 AND 196"), ("ellipse", lambda x, y: image.ellipse(x, y, 30, 30, 16, 8), "pow((x - 30) / 16.0, 2) + pow((y - 30) / 8.0, 2) <= 1"),
    ("centre_box", lambda x, y: image.centre_box(x, y, 20, 20, 11, 7), "x BETWEEN 14.5 AND 25.5 AND y BETWEEN 16.5 AND 23.5"),
    ("rotated_box", lambda x, y: image.rotated_box(x, y, 30.1, 30.3, 21, 9, 0.5), "abs((x - 30.1) * cos(0.5) + (y - 30.3) * sin(0.5)) <= 10.5 AND abs((y - 30.3) * cos(0.5) - (x - 30.1) * sin(0.5)) <= 4.5"),
    ("polygon", lambda x, y: image.polygon(x, y, [(4.5, 4.5), (50.5, 10.5), (20.5, 55.5)]), "((CASE WHEN (4.5 > y) <> (10.5 > y) AND x < 46 * (y - 4.5) / 6 + 4.5 THEN 1 ELSE 0 END) + (CASE WHEN (10.5 > y) <> (55.5 > y) AND x < -30 * (y - 10.5) / 45 + 50.5 THEN 1 ELSE 0 END) + (CASE WHEN (55.5 > y) <> (4.5 > y) AND x < -16 * (y - 55.5) / -51 + 20.5 THEN 1 ELSE 0 END)) % 2 = 1"),
    ("composed", lambda x, y: image.parse_regions("circle [[30, 30], 20]\n- box [[25, 25], [35, 35]] # hole\n+ box [[0, 0], [4, 4]]", x, y), "((pow(x - 30, 2) + pow(y - 30, 2) <= 400) AND NOT (x BETWEEN 25 AND 35 AND y BETWEEN 25 AND 35)) OR (x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 4)"),
):
    add(f"region_{_name}", lambda s, d, t=_test: rounded(cube(s, d).where(t(F.col("x"), F.col("y"))).groupBy("chan").agg(F.count("*").alias("npix"), F.sum("value").alias("flux")), digits=3), f"SELECT chan, count(*) AS npix, round(sum(value), 3) AS flux FROM {CUBE} WHERE {_sql} GROUP BY chan")
add("image_subimage", lambda s, d: rounded(image.subimage(cube(s, d), ["x", "y"], image.box(F.col("x"), F.col("y"), 10, 12, 20, 22))), f"SELECT x - min(x) OVER () AS x, y - min(y) OVER () AS y, chan, round(value, 6) AS value, mask FROM {CUBE} WHERE x BETWEEN 10 AND 20 AND y BETWEEN 12 AND 22")
add("image_crop", lambda s, d: image.crop(cube(s, d).withColumn("mask", F.col("mask") & F.col("x").between(3, 50)), ["x", "y"], "mask").agg(F.count("*").alias("n")), f"WITH c AS (SELECT x, y, mask AND x BETWEEN 3 AND 50 AS mask FROM {CUBE}), b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM c WHERE mask) SELECT count(*) AS n FROM c, b WHERE x BETWEEN a AND b.b AND y BETWEEN b.c AND d")
add("image_transpose", lambda s, d: rounded(image.transpose(cube(s, d).select("x", "y", "chan", "value"), ["x", "y", "chan"], "1-02", {"x": 64, "y": 64, "chan": 8})), f"SELECT y AS x, 63 - x AS y, chan, round(value, 6) AS value FROM {CUBE}")
add("image_rebin", lambda s, d: rounded(image.rebin(cube(s, d), {"x": 5, "y": 5}, {"x": 64, "y": 64}, ["chan"], "value", "mask")), f"SELECT chan, CAST(x // 5 AS INTEGER) AS x, CAST(y // 5 AS INTEGER) AS y, round(avg(value) FILTER (WHERE mask), 6) AS value, count(*) FILTER (WHERE mask) AS npix FROM {CUBE} WHERE x < 60 AND y < 60 GROUP BY 1, 2, 3")
add("image_concat", lambda s, d: rounded(image.concat([cube(s, d), cube(s, d)], "chan", [8, 8]).groupBy("chan").agg(F.sum("value").alias("flux")), digits=3), f"SELECT chan, round(sum(value), 3) AS flux FROM (SELECT chan, value FROM {CUBE} UNION ALL SELECT chan + 8, value FROM {CUBE}) GROUP BY chan")
add("image_pv", lambda s, d: rounded(image.pv_slice(cube(s, d), (5, 8), (55, 8), 5, "chan", "value")), f"SELECT CAST(x - 5 AS INTEGER) AS offset, chan, round(avg(value), 6) AS value, count(*) AS npts FROM {CUBE} WHERE abs(y - 8) <= 2.5 AND x BETWEEN 5 AND 55 GROUP BY 1, 2")
add("image_pbcor", lambda s, d: rounded(image.primary_beam_correct(cube(s, d), cube(s, d).select("x", "y", C.primary_beam("gaussian", F.hypot(F.col("x") - 32, F.col("y") - 32), 30.0).alias("value")).distinct(), ["x", "y"], 0.2).select("x", "y", "chan", "value"), digits=3),
    f"SELECT x, y, chan, round(CASE WHEN b >= 0.2 THEN value / b END, 3) AS value FROM (SELECT *, exp(-4 * ln(2) * (pow(x - 32, 2) + pow(y - 32, 2)) / 900.0) AS b FROM {CUBE})")
add("image_statistic_grid", lambda s, d: rounded(image.statistic_image(cube(s, d), 8, 5, ["chan"], F.stddev_samp("value")), digits=4), f"SELECT chan, CAST(gx * 8 AS INTEGER) AS x, CAST(gy * 8 AS INTEGER) AS y, round(stddev_samp(value), 4) AS statistic, count(*) AS npts FROM {CUBE}, range(9) a(gx), range(9) b(gy) WHERE abs(x - gx * 8) <= 5 AND abs(y - gy * 8) <= 5 GROUP BY 1, 2, 3")
add("image_sources", lambda s, d: rounded(image.sources(cube(s, d), ["chan"], 60000.0, 20)), f"WITH c AS (SELECT * FROM {CUBE}) SELECT chan, x, y, round(value, 6) AS value FROM c WHERE value > 60000 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.chan = c.chan AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 AND o.value > c.value) ORDER BY c.value DESC, chan, x, y LIMIT 20")
add("image_smooth", lambda s, d: rounded(image.smooth(cube(s, d), {(i, j): 1 / 9 for i in (-1, 0, 1) for j in (-1, 0, 1)}, ["chan"]), digits=6), f"SELECT chan, CAST(x + i AS INTEGER) AS x, CAST(y + j AS INTEGER) AS y, round(sum(value * (1.0::DOUBLE / 9)), 6) AS value FROM {CUBE}, range(-1, 2) a(i), range(-1, 2) b(j) GROUP BY 1, 2, 3")
add("image_two_point", lambda s, d: rounded(image.two_point(cube(s, d), ["chan"], "value", 2), digits=0), f"WITH c AS (SELECT * FROM {CUBE}) SELECT a.chan, CAST(b.x - a.x AS INTEGER) AS lx, CAST(b.y - a.y AS INTEGER) AS ly, round(avg(a.value * b.value), 0) AS corr, count(*) AS npairs FROM c a JOIN c b ON a.chan = b.chan AND b.x - a.x BETWEEN 0 AND 2 AND b.y - a.y BETWEEN 0 AND 2 GROUP BY 1, 2, 3")
add("image_mosaic", lambda s, d: rounded(image.mosaic([cube(s, d).select("x", "y", "chan", "value", F.lit(2.0).alias("weight")), cube(s, d).select((F.col("x") + 1).alias("x"), "y", "chan", "value", F.lit(1.0).alias("weight"))], ["x", "y", "chan"]), digits=4),
    f"SELECT x, y, chan, round(sum(value * w) / sum(w), 4) AS value, sum(w) AS weight FROM (SELECT x, y, chan, value, 2.0::DOUBLE AS w FROM {CUBE} UNION ALL SELECT x + 1, y, chan, value, 1.0::DOUBLE FROM {CUBE}) GROUP BY x, y, chan")
add("image_replace_masked", lambda s, d: rounded(cube(s, d).select("x", "y", "chan", image.replace_masked(F.col("value"), F.col("mask"), F.lit(-1.0)).alias("value"))), f"SELECT x, y, chan, round(CASE WHEN mask THEN value ELSE -1 END, 6) AS value FROM {CUBE}")
add("polarization_images", lambda s, d: rounded(cube(s, d).select("x", "y", "chan", C.linear_polarization(F.col("value"), F.col("value") / 2, 30000.0).alias("linear"), C.polarization_angle(F.col("value"), F.col("value") * (F.col("x") - 30)).alias("angle")), digits=4),
    f"SELECT x, y, chan, round(CASE WHEN value * value * 1.25 - 9e8 >= 0 THEN sqrt(value * value * 1.25 - 9e8) END, 4) AS linear, round(degrees(atan2(value * (x - 30), value)) / 2, 4) AS angle FROM {CUBE}")

# --- catalogue ----------------------------------------------------------------------------------------------------
add("slsearch", lambda s, d: search.search(catalog(s, d), (950.0, 1050.0), ranges={"el": (5, 25)}, like={"species": "Brand#%"}).select("line_id", "frequency", "species"), f"SELECT line_id, frequency, species FROM {CATALOG} WHERE frequency BETWEEN 950 AND 1050 AND el BETWEEN 5 AND 25 AND species LIKE 'Brand#%'")
add("slsearch_count", lambda s, d: search.search(catalog(s, d), (950.0, 1050.0)).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM {CATALOG} WHERE frequency BETWEEN 950 AND 1050")
add("slsearch_species", lambda s, d: catalog(s, d).select("species").distinct(), f"SELECT DISTINCT species FROM {CATALOG}")
add("slsearch_paging", lambda s, d: search.search(catalog(s, d), (0.0, 1e9), order=["frequency", "line_id"], limit=15, offset=30).select("line_id"), f"SELECT line_id FROM {CATALOG} ORDER BY frequency, line_id LIMIT 15 OFFSET 30")

# --- uv plane -----------------------------------------------------------------------------------------------------
_UV = f"(SELECT *, weight - 25 AS u, CAST(ant % 50 AS DOUBLE) - 25 AS v FROM {FACT})"


def _uv(s: SparkSession, d: str) -> DataFrame:
    return fact(s, d).withColumn("u", F.col("weight") - 25).withColumn("v", (F.col("ant") % 50).cast("double") - 25)


add("uvbin_weighted", lambda s, d: rounded(uvgrid.grid(_uv(s, d), F.col("u"), F.col("v"), 4.0, ["spw"], F.col("value"), F.col("value") / 2, F.col("weight")), digits=3),
    f"SELECT CAST(floor(u / 4) AS BIGINT) AS iu, CAST(floor(v / 4) AS BIGINT) AS iv, spw, round(sum(value * weight) / sum(weight), 3) AS re, round(sum(value / 2 * weight) / sum(weight), 3) AS im, round(sum(weight), 3) AS weight, count(*) AS n FROM {_UV} GROUP BY 1, 2, 3")
for _mode, _sql in (
    ("natural", "weight"), ("radial", "weight * sqrt(u * u + v * v)"), ("uniform", "weight / d"), ("briggs", "weight / (1 + d * 25 / (SELECT sum(x * x) / sum(x) FROM (SELECT sum(weight) AS x FROM u GROUP BY floor(u / 4), floor(v / 4))))"),
):
    add(f"weights_{_mode}", lambda s, d, m=_mode: rounded(uvgrid.imaging_weights(_uv(s, d), "u", "v", "weight", 4.0, m).groupBy("spw").agg(F.sum("imaging_weight").alias("total"), F.max("imaging_weight").alias("top")), digits=4),
        f"WITH u AS (SELECT * FROM {_UV}), w AS (SELECT *, sum(weight) OVER (PARTITION BY floor(u / 4), floor(v / 4)) AS d FROM u) SELECT spw, round(sum({_sql}), 4) AS total, round(max({_sql}), 4) AS top FROM w GROUP BY spw")
add("apparent_sensitivity", lambda s, d: rounded(uvgrid.apparent_sensitivity(fact(s, d), "weight", ["spw"])), f"SELECT spw, round(1 / sqrt(sum(weight)), 6) AS sensitivity FROM {FACT} GROUP BY spw")

# --- complex numbers and calibration ------------------------------------------------------------------------------
add("phase_shift", lambda s, d: (lambda p: rounded(fact(s, d).select("scan", "spw", p.re.alias("re"), p.im.alias("im")), digits=3))(C.phase_shift(C.Complex(F.col("value"), F.col("value") / 2), F.col("weight"), F.col("ant"), 1e-3, 2e-3, F.col("spw") * 1e9)),
    f"WITH p AS (SELECT scan, spw, value AS a, value / 2 AS b, (weight * 1e-3 + ant * 2e-3) * (spw * 1e9) * (-2 * pi() / 299792458.0) AS f FROM {FACT}) SELECT scan, spw, round(a * cos(f) - b * sin(f), 3) AS re, round(a * sin(f) + b * cos(f), 3) AS im FROM p")
_GAIN = f"(SELECT k AS ant, spw, sum(value) / 100 AS g_re, avg(value) / 10 AS g_im, k = 4 AS g_flag FROM {VIS} GROUP BY k, spw)"


def _gain(s: SparkSession, d: str) -> DataFrame:
    return vis(s, d).groupBy(F.col("k").alias("ant"), "spw").agg((F.sum("value") / 100).alias("g_re"), (F.avg("value") / 10).alias("g_im")).withColumn("g_flag", F.col("ant") == 4)


add("applycal", lambda s, d: rounded(calibrate.apply_gains(vis(s, d).select("row_id", "spw", F.col("k").alias("a1"), ((F.col("k") + 1) % 10).cast("int").alias("a2"), F.col("value").alias("re"), F.lit(1.0).alias("im")), _gain(s, d), ["spw"], "a1", "a2").select("row_id", (F.col("c_re") * 1000).alias("re"), (F.col("c_im") * 1000).alias("im"), "c_flag"), digits=4),
    f"WITH g AS (SELECT * FROM {_GAIN}), j AS (SELECT v.row_id, v.value AS a, 1.0 AS b, p.g_re * q.g_re + p.g_im * q.g_im AS c, p.g_im * q.g_re - p.g_re * q.g_im AS d, coalesce(p.g_flag OR q.g_flag, true) AS f FROM {VIS} v LEFT JOIN g p ON p.spw = v.spw AND p.ant = v.k LEFT JOIN g q ON q.spw = v.spw AND q.ant = (v.k + 1) % 10) SELECT row_id, round((a * c + b * d) / (c * c + d * d) * 1000, 4) AS re, round((b * c - a * d) / (c * c + d * d) * 1000, 4) AS im, f AS c_flag FROM j")
add("rereference", lambda s, d: rounded(calibrate.rereference(_gain(s, d), ["spw"], [4, 2, 7]).select("spw", "ant", "g_re", "g_im", "g_flag"), digits=4),
    f"WITH g AS (SELECT * FROM {_GAIN}), f AS (SELECT spw, arg_min((g_re, g_im), CASE ant WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS p FROM g WHERE ant IN (4, 2, 7) AND NOT g_flag GROUP BY spw), h AS (SELECT spw, p[1] / sqrt(p[1] * p[1] + p[2] * p[2]) AS a, p[2] / sqrt(p[1] * p[1] + p[2] * p[2]) AS b FROM f) SELECT g.spw, ant, round(coalesce(g_re * a + g_im * b, g_re), 4) + 0.0 AS g_re, round(coalesce(g_im * a - g_re * b, g_im), 4) + 0.0 AS g_im, g_flag FROM g LEFT JOIN h ON h.spw = g.spw")
add("solve_counts", lambda s, d: calibrate.counts(fact(s, d), ["spw"], "ant", "flag"), f"SELECT spw, count(DISTINCT ant) AS expected, count(*) AS attempted, CAST(sum((NOT flag)::INT) AS BIGINT) AS succeeded FROM {FACT} GROUP BY spw")
add("doppler", lambda s, d: rounded(catalog(s, d).select("line_id", *(C.velocity(F.col("frequency"), 1000.0, k).alias(k) for k in ("radio", "optical", "relativistic", "z"))), digits=3),
    f"SELECT line_id, round((1 - frequency / 1000) * 299792458.0, 3) AS radio, round((1000 / frequency - 1) * 299792458.0, 3) AS optical, round((1 - pow(frequency / 1000, 2)) / (1 + pow(frequency / 1000, 2)) * 299792458.0, 3) AS relativistic, round(1000 / frequency - 1, 3) AS z FROM {CATALOG}")
add("direction_separation", lambda s, d: rounded(fact(s, d).select("scan", "spw", C.separation(F.radians(F.col("ant") % 360), F.radians(F.col("weight")), F.lit(1.0), F.lit(0.5)).alias("sep"))),
    f"SELECT scan, spw, round(atan2(sqrt(pow(cos(0.5) * sin(1.0 - l), 2) + pow(cos(b) * sin(0.5) - sin(b) * cos(0.5) * cos(1.0 - l), 2)), sin(b) * sin(0.5) + cos(b) * cos(0.5) * cos(1.0 - l)), 6) AS sep FROM (SELECT scan, spw, radians(ant % 360) AS l, radians(weight) AS b FROM {FACT})")

# --- sets, sources and windows of time ----------------------------------------------------------------------------
add("intersect_sets", lambda s, d: vis(s, d).where("k < 6").select("ant").intersect(vis(s, d).where("k > 8").select("ant")), f"SELECT ant FROM {VIS} WHERE k < 6 INTERSECT SELECT ant FROM {VIS} WHERE k > 8")
from . import calibration, images, statistics, tables  # noqa: E402,F401  (they add their queries)

__all__ = ["add", "queries", "oracle_sql", "base"]
