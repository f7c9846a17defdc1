"""As-of and interval joins, and calibration: solve in closed form, interpolate, apply, re-reference."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import C_M_S, Complex, polynomial

MOST_COMPONENTS = 1000


def _carried(samples: DataFrame, rows: DataFrame, keys: list[str], width: float | None) -> DataFrame:
    """The rows (keys, _t, _row), each with the latest sample (keys, _t, _s) at or before it as _a and the earliest one at
    or after it as _b.

    Both frames grow from the start of their sort: one that ends at the last row is computed anew for each row. With a
    width the rows of a key are dealt by blocks of time, so one hot key is many tasks; each block with rows gets the last
    sample before it and the first one after it as two more samples, so nothing is joined.
    """
    part, side, at = [*keys], F.lit(0).alias("_side"), F.lit(0).alias("_at")
    if width is not None:
        block = F.floor(F.col("_t") / width).alias("_block")
        samples, rows = samples.select("*", block), rows.select("*", block)
        part.append("_block")
    u = samples.select("*", side, at).unionByName(rows.select("*", F.lit(1).alias("_side"), at), allowMissingColumns=True)
    if width is not None:
        own = samples.groupBy(*part).agg(F.min_by("_s", "_t").alias("_first"), F.max_by("_s", "_t").alias("_last"))
        both = own.unionByName(rows.select(*part).distinct().withColumn("_asked", F.lit(True)), allowMissingColumns=True)
        edges = both.groupBy(*part).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_first", "_last", "_asked")))
        earlier, later = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_block"), F.desc("_block")))
        found = F.array(F.struct(F.lit(-1).alias("at"), F.last("_last", ignorenulls=True).over(earlier).alias("s")), F.struct(F.lit(1).alias("at"), F.last("_first", ignorenulls=True).over(later).alias("s")))
        edges = edges.select(*part, "_asked", found.alias("_found")).where("_asked").select(*part, F.explode("_found").alias("_e"))
        u = u.unionByName(edges.where("_e.s IS NOT NULL").select(*part, F.col("_e.s").alias("_s"), side, F.col("_e.at").alias("_at")), allowMissingColumns=True)
    before, after = (Window.partitionBy(*part).orderBy(*o, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in ((F.asc("_at"), F.asc("_t")), (F.desc("_at"), F.desc("_t"))))
    return u.withColumn("_a", F.last("_s", ignorenulls=True).over(before)).withColumn("_b", F.last("_s", ignorenulls=True).over(after)).where("_side = 1")


def asof(left: DataFrame, right: DataFrame, keys: list[str], time_col: str, values: list[str], how: str = "linear", width: float | None = None) -> DataFrame:
    """Values of `right` at the times of `left`: nearest (the earlier of two equally near), previous, next, or linear,
    which holds the first and last value beyond the ends and takes an exact hit as it is.

    One shuffle: both sides are sorted together by key and time and the neighbours carried along by window functions,
    so the work is linear whatever the sizes, and nothing is broadcast. width: deals each key by blocks of time, for
    keys with more rows than a task should have; the result is the same.
    """
    carried = [f"_{v}" for v in values]
    r = right.select(*keys, F.col(time_col).alias("_t"), F.struct(F.col(time_col).alias("t"), *(F.col(v).alias(c) for v, c in zip(values, carried))).alias("_s"))
    cols = [c for c in left.columns if c not in keys]
    lft = left.select(*keys, F.col(time_col).alias("_t"), F.struct(*cols).alias("_row"))
    u = _carried(r, lft, keys, width)
    out = []
    for v, c in zip(values, carried):
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        da, db = F.col("_t") - F.col("_a.t"), F.col("_b.t") - F.col("_t")
        x = {
            "previous": a, "next": b, "nearest": F.when(db.isNull() | (da <= db), a).otherwise(b),
            "linear": F.when(da.isNull(), b).when(db.isNull() | (da + db == 0), a).otherwise(a + (b - a) * da / (da + db)),
        }[how]
        out.append(x.alias(v))
    return u.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in cols), *out)


def _spans(samples: DataFrame, keys: list[str], time_col: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row a key (its first and last sample with their times, the levels of its spans), and the spans from a sample to the
    next one, each in the blocks it meets. A span of level n is longer than half of 2^n, the size of its blocks, so at most
    three spans of a key and level share a block, however the samples lie, and no span is in more than three. Values go by their
    place, so Spark sees that two antennas ask for the same table."""
    order = Window.partitionBy(*keys).orderBy("_lo")
    s = samples.where(F.col(time_col).isNotNull()).select(*keys, F.col(time_col).alias("_lo"), F.struct(*(F.col(v).alias(f"_{i}") for i, v in enumerate(values))).alias("_s"))
    s = s.select("*", F.lead("_lo").over(order).alias("_hi"), F.lead("_s").over(order).alias("_n"))
    s = s.withColumn("_level", F.when(F.col("_hi") > F.col("_lo"), F.ceil(F.log2((F.col("_hi") - F.col("_lo")).cast("double"))).cast("int")))
    ends = s.groupBy(*keys).agg(F.min("_lo").alias("_from"), F.max("_lo").alias("_to"), F.min_by("_s", "_lo").alias("_first"), F.max_by("_s", "_lo").alias("_last"), F.collect_set("_level").alias("_levels"))
    blocks = F.sequence(*(F.floor(F.col(c) / F.pow(F.lit(2.0), "_level")) for c in ("_lo", "_hi")))
    return ends, s.where("_level IS NOT NULL").select("*", F.explode(blocks).alias("_block"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time_col: str, values: list[str], how: str = "linear") -> DataFrame:
    """nearest or linear values as by asof(), by equi-joins of a row's key and then of its blocks of time, one block a level
    of its key, with the samples. No row is sorted, and none is dealt where the samples are few enough for Spark to send them
    to all tasks. A row without a time takes the last sample."""
    t, level = F.col(time_col), F.col("_level")
    ends, spans = _spans(right, keys, time_col, values)
    inside = (t >= F.col("_from")) & (t < F.col("_to"))
    out = left.join(ends, keys, "left").select("*", F.explode_outer(F.when(inside, F.col("_levels"))).alias("_level")).withColumn("_block", F.floor(t / F.pow(F.lit(2.0), level)))
    on = [*keys, "_level", "_block"]
    spans = spans.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(on)})
    same = reduce(lambda x, y: x & y, (out[k] == F.col(f"_k{i}") for i, k in enumerate(on)))
    out = out.join(spans, same & (t >= F.col("_lo")) & (t < F.col("_hi")), "left").where(F.col("_lo").isNotNull() | level.isNull())
    before, hit = t < F.col("_from"), t == F.col("_lo")
    at = F.when(level.isNotNull(), F.col("_lo")).when(~F.coalesce(before, F.lit(False)), F.col("_to"))
    bt = F.when(level.isNotNull(), F.when(hit, F.col("_lo")).otherwise(F.col("_hi"))).when(before, F.col("_from"))
    da, db = t - at, bt - t
    got = []
    for i, v in enumerate(values):
        a = F.when(level.isNotNull(), F.col(f"_s._{i}")).otherwise(F.col(f"_last._{i}"))
        b = F.when(level.isNotNull(), F.when(hit, F.col(f"_s._{i}")).otherwise(F.col(f"_n._{i}"))).otherwise(F.col(f"_first._{i}"))
        x = {
            "nearest": F.when(at.isNull(), b).when(bt.isNull() | (da <= db), a).otherwise(b),
            "linear": F.when(at.isNull(), b).when(bt.isNull() | (da + db == 0), a).otherwise(a + (b - a) * da / (da + db)),
        }[how]
        got.append(x.alias(v))
    return out.select(*left.columns, *got)


def assign_interval(points: DataFrame, spans: DataFrame, time_col: str, pad: float = 1e-5, width: float = 3600.0) -> DataFrame:
    """Each point gets the span (span, lo, hi) whose padded bounds hold it; before the first it is the first, in gaps and
    after the last the latest begun. Spans do not overlap; there is one row each, sorted with the points inside blocks of
    `width` of time, to which the latest earlier span is carried."""
    s = spans.select((F.col("lo") - pad).alias("_t"), F.struct("span").alias("_s"))
    p = points.select(F.col(time_col).alias("_t"), F.struct(*points.columns).alias("_row"))
    first = spans.agg(F.min_by("span", "lo").alias("_first"))  # one row
    u = _carried(s, p, [], width)
    return u.crossJoin(F.broadcast(first)).select("_row.*", F.coalesce(F.col("_a.span"), F.col("_first")).alias("span"))


def in_span(points: DataFrame, spans: DataFrame, keys: list[str], time_col: str, width: float) -> DataFrame:
    """Range join of points and spans [lo, hi] with equal keys, through blocks of time of the given width."""
    b = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_b")
    s = spans.select(*spans.columns, b)
    p = points.withColumn("_b", F.floor(F.col(time_col) / width))
    return p.join(s, [*keys, "_b"]).where(F.col(time_col).between(F.col("lo"), F.col("hi"))).drop("_b")


def map_spw(df: DataFrame, column: str, spwmap: list[int]) -> DataFrame:
    """spwmap[i] is the window whose solutions serve window i; [-1] is identity."""
    if list(spwmap) == [-1]:
        return df
    return df.withColumn(column, F.coalesce(F.get(F.array(*map(F.lit, spwmap)), F.col(column).cast("int")), F.col(column)))


def accor(df: DataFrame, keys: list[str], auto: Column, power: Column) -> DataFrame:
    """Amplitude gain from autocorrelations: the root of their mean."""
    return df.where(auto).groupBy(*keys).agg(F.sqrt(F.avg(power)).alias("gain"), F.count("*").alias("n"))


def apply_gains(vis: DataFrame, gains: DataFrame, keys: list[str], a: str, b: str, weights: bool = False) -> DataFrame:
    """vis / (g_a conj g_b) by two equi-joins of the gain table (keys, ant, g_re, g_im, g_flag)."""
    g1 = gains.select(*keys, F.col("ant").alias(a), F.col("g_re").alias("_r1"), F.col("g_im").alias("_i1"), F.col("g_flag").alias("_f1"))
    g2 = gains.select(*keys, F.col("ant").alias(b), F.col("g_re").alias("_r2"), F.col("g_im").alias("_i2"), F.col("g_flag").alias("_f2"))
    j = vis.join(g1, [*keys, a], "left").join(g2, [*keys, b], "left")
    g = Complex(F.col("_r1"), F.col("_i1")) * Complex(F.col("_r2"), F.col("_i2")).conj()
    c = Complex(F.col("re"), F.col("im")) / g
    j = j.withColumn("c_re", c.re).withColumn("c_im", c.im).withColumn("c_flag", F.coalesce(F.col("_f1") | F.col("_f2"), F.lit(True)))
    if weights:
        j = j.withColumn("weight", F.col("weight") * (g.re * g.re + g.im * g.im))
    return j.drop("_r1", "_i1", "_f1", "_r2", "_i2", "_f2")


def rereference(cal: DataFrame, keys: list[str], antennas: list[int], mode: str = "flex") -> DataFrame:
    """Turns every solution of a key by minus the phase of its reference antenna: the first unflagged one of the list.

    flex: a key without any of them keeps its phases; strict: only the first counts, and without it the key is flagged.
    """
    order = F.array_position(F.array(*map(F.lit, antennas if mode == "flex" else antennas[:1])), F.col("ant"))
    ref = cal.where((order > 0) & ~F.col("g_flag")).groupBy(*keys).agg(F.min_by(F.struct("ant", "g_re", "g_im"), order).alias("_ref"))
    j = cal.join(ref, keys, "left")
    r = Complex(F.col("_ref.g_re"), F.col("_ref.g_im"))
    unit = Complex(r.re / r.amp(), r.im / r.amp())
    t = Complex(F.col("g_re"), F.col("g_im")) * unit.conj()
    none = F.col("_ref").isNull()
    flag = F.col("g_flag") | none if mode == "strict" else F.col("g_flag")
    return j.select(*keys, "ant", F.coalesce(t.re, F.col("g_re")).alias("g_re"), F.coalesce(t.im, F.col("g_im")).alias("g_im"), flag.alias("g_flag"), F.col("_ref.ant").alias("refant"))


def solve_gains(vis: DataFrame, keys: list[str], a: str, b: str, refant: int = 0, rounds: int = 50, least: int = 3, min_snr: float = 0.0) -> DataFrame:
    """Antenna gains of each key (a solution interval), model a point of 1: alternating least squares.

    The visibilities of an interval are averaged per baseline before the shuffle, so a group is at most one row a
    baseline; the iteration on it is an Arrow function.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(vis.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ant long, g_re double, g_im double, snr double, g_flag boolean"
    mean = vis.where(F.col(a) != F.col(b)).groupBy(*keys, a, b).agg(F.sum(F.col("re") * F.col("weight")).alias("_r"), F.sum(F.col("im") * F.col("weight")).alias("_i"), F.sum("weight").alias("_w"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        ants = np.unique(p[[a, b]].to_numpy())
        n = len(ants)
        v, w = np.zeros((n, n), complex), np.zeros((n, n))
        x, y = np.searchsorted(ants, p[a]), np.searchsorted(ants, p[b])
        good = p["_w"].to_numpy() > 0
        z = np.where(good, (p["_r"] + 1j * p["_i"]) / np.where(good, p["_w"], 1), 0)
        v[x, y], v[y, x], w[x, y], w[y, x] = z, z.conj(), p["_w"], p["_w"]
        g = np.ones(n, complex)
        for _ in range(rounds):
            new = (w * v) @ g / np.maximum((w * np.abs(g) ** 2).sum(1), 1e-30)
            done = np.abs(new - g).max() < 1e-10
            g = (g + new) / 2
            if done:
                break
        ref = np.searchsorted(ants, refant)
        if ref < n and ants[ref] == refant and abs(g[ref]):
            g = g * np.conj(g[ref]) / abs(g[ref])
        res = np.abs(v - np.outer(g, g.conj())) ** 2 * w
        noise = np.sqrt(res.sum() / max((w > 0).sum(), 1))
        snr = np.abs(g) * np.sqrt((w * np.abs(g) ** 2).sum(1)) / (noise or 1.0)
        bad = ((w > 0).sum(1) < least) | (snr < min_snr)
        out = pd.DataFrame({k: [p[k].iloc[0]] * n for k in keys})
        return out.assign(ant=ants, g_re=g.real, g_im=g.imag, snr=snr, g_flag=bad)

    return mean.groupBy(*keys).applyInPandas(solve, schema)


def counts(solutions: DataFrame, keys: list[str], expected: str, flag: str) -> DataFrame:
    """Expected, attempted and succeeded solutions."""
    return solutions.groupBy(*keys).agg(F.count_distinct(expected).alias("expected"), F.count("*").alias("attempted"), F.sum((~F.col(flag)).cast("long")).alias("succeeded"))


_STRINGS = ("caltable", "field", "intent", "spw", "obs", "scan", "tinterp", "finterp", "reach")
_MAPS = ("antmap", "fldmap", "obsmap", "scanmap", "spwmap")


def parse_library(text: str) -> list[dict]:
    """Lines of key=value: strings quoted, calwt True or False, maps as [..]; # begins a comment."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"#.*$", "", line).strip()
        if not line:
            continue
        row: dict = {}
        at = 0
        for m in re.finditer(r"(\w+)\s*=\s*('[^']*'|\"[^\"]*\"|\[[^\]]*\]|True|False|T|F)\s*,?\s*", line):
            if m.start() != at:
                break
            at, key, value = m.end(), m[1], m[2]
            if key in _STRINGS and value[0] in "'\"":
                row[key] = value[1:-1]
            elif key == "calwt" and value[0] in "TF":
                row[key] = value[0] == "T"
            elif key in _MAPS and value[0] == "[":
                row[key] = [int(x) for x in re.split(r"[,\s]+", value[1:-1].strip()) if x]
            else:
                raise ValueError(f"{key}={value} is not understood")
        if at != len(line) or "caltable" not in row:
            raise ValueError(f"not a line of a calibration library: {line!r}")
        out.append(row)
    return out


# --- models -------------------------------------------------------------------------------------------------------
def with_model(vis: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """A virtual model column: the visibility of each row's point model (keys, flux, l, m) by its u and v in wavelengths;
    1 where there is none."""
    m = models.select(*keys, F.col("flux").alias("_f"), F.col("l").alias("_l"), F.col("m").alias("_m"))
    j = vis.join(m, keys, "left")
    v = Complex.polar(F.col("_f"), -2 * math.pi * (F.col("u") * F.col("_l") + F.col("v") * F.col("_m")))
    return j.withColumn("model_re", F.when(F.col("_f").isNull(), 1.0).otherwise(v.re)).withColumn("model_im", F.when(F.col("_f").isNull(), 0.0).otherwise(v.im)).drop("_f", "_l", "_m")


def predict(vis: DataFrame, components: DataFrame, keys: list[str], incremental: bool = False) -> DataFrame:
    """Model visibilities as the sum over components (flux, l, m), of which there are few: they are held in each row's
    expression, up to MOST_COMPONENTS of them."""
    rows = components.select("flux", "l", "m").orderBy("l", "m", "flux").limit(MOST_COMPONENTS + 1).collect()
    if len(rows) > MOST_COMPONENTS:
        raise ValueError(f"more than {MOST_COMPONENTS} components")
    table = F.array(*(F.struct(F.lit(float(r["flux"])).alias("f"), F.lit(float(r["l"])).alias("l"), F.lit(float(r["m"])).alias("m")) for r in rows))
    phase = lambda c: -2 * math.pi * (F.col("u") * c["l"] + F.col("v") * c["m"])
    total = lambda f: F.aggregate(table, F.lit(0.0), f) if rows else F.lit(0.0)
    re, im = total(lambda a, c: a + c["f"] * F.cos(phase(c))), total(lambda a, c: a + c["f"] * F.sin(phase(c)))
    if incremental:
        re, im = re + F.col("model_re"), im + F.col("model_im")
    return vis.withColumn("_re", re).withColumn("_im", im).drop("model_re", "model_im").withColumnsRenamed({"_re": "model_re", "_im": "model_im"})


def delete_model(vis: DataFrame) -> DataFrame:
    return vis.drop("model_re", "model_im")


def clear(vis: DataFrame, add_model: bool = False) -> DataFrame:
    """Corrected data are the data again, the model a point of 1 (made if asked for)."""
    out = vis.withColumn("c_re", F.col("re")).withColumn("c_im", F.col("im"))
    if add_model or "model_re" in vis.columns:
        out = out.withColumn("model_re", F.lit(1.0)).withColumn("model_im", F.lit(0.0))
    return out


def subtract_model(vis: DataFrame, reverse: bool = False) -> DataFrame:
    """Corrected less model, or plus it."""
    c, m = Complex(F.col("c_re"), F.col("c_im")), Complex(F.col("model_re"), F.col("model_im"))
    r = c + m if reverse else c - m
    return vis.withColumn("c_re", r.re).withColumn("c_im", r.im)


def conjugate(vis: DataFrame, selected: Column, columns: list[str]) -> DataFrame:
    """The imaginary parts of selected rows change sign."""
    return vis.withColumns({c: F.when(selected, -F.col(c)).otherwise(F.col(c)) for c in columns})


# --- calibration tables -------------------------------------------------------------------------------------------
def generated(spark, kind: str, antennas: list[int], spws: list[int], parameter: list[float]) -> DataFrame:
    """Solutions from given parameters, one for all or one an antenna: amp, ph (degrees) or sbd (delay in ns, phase at the
    spectral window's number in GHz)."""
    if len(parameter) not in (1, len(antennas)):
        raise ValueError("one parameter, or one for each antenna")
    rows = []
    for i, a in enumerate(antennas):
        p = float(parameter[i if len(parameter) > 1 else 0])
        for s in spws:
            angle = {"amp": 0.0, "ph": math.radians(p), "sbd": 2 * math.pi * p * s}[kind]
            size = p if kind == "amp" else 1.0
            rows.append((s, a, size * math.cos(angle), size * math.sin(angle), False))
    return spark.createDataFrame(rows, "spw long, ant long, g_re double, g_im double, g_flag boolean")


def matched(vis: DataFrame, cal: DataFrame, keys: list[str], a: str, b: str, values: list[str], by: str = "antenna") -> DataFrame:
    """Rows with the calibration rows that match them exactly: by antenna the two antennas' (suffix 1 and 2), by baseline one."""
    if by == "baseline":
        return vis.join(cal.select(*keys, F.col("ant1").alias(a), F.col("ant2").alias(b), *values), [*keys, a, b], "left")
    if by != "antenna":
        raise ValueError("by antenna or baseline")
    one = [cal.select(*keys, F.col("ant").alias(c), *(F.col(v).alias(f"{v}{i}") for v in values)) for i, c in ((1, a), (2, b))]
    return vis.join(one[0], [*keys, a], "left").join(one[1], [*keys, b], "left")


def apply_tables(vis: DataFrame, tables: list[dict], a: str, b: str, time_col: str = "time", mode: str = "calflag", calwt: bool = False) -> DataFrame:
    """Several calibration tables after one another. Each is {table, keys, interp, spwmap, calwt}: interp none for constant
    solutions, else nearest or linear in time, per antenna and key, as by asof_join(); spwmap as in map_spw().

    Modes: calflag calibrates and flags what has no solution; calflagstrict also flags what a table does not know; calonly
    leaves flags alone; flagonly leaves data alone; trial changes nothing. Adds c_re, c_im, c_flag, and scales weight.
    """
    if mode not in ("calflag", "calflagstrict", "calonly", "flagonly", "trial"):
        raise ValueError(f"unknown mode {mode!r}")
    out = vis.withColumn("c_re", F.col("re")).withColumn("c_im", F.col("im")).withColumn("c_flag", F.coalesce(F.col("flag"), F.lit(False)) if "flag" in vis.columns else F.lit(False))
    for t in tables:
        cal, keys = t["table"], t["keys"]
        out = out.withColumn("_spw", F.col("spw"))
        if t.get("spwmap"):
            out = map_spw(out, "_spw", t["spwmap"])
        on = ["_spw" if k == "spw" else k for k in keys]
        cal = cal.withColumnRenamed("spw", "_spw") if "spw" in keys else cal
        for i, c in ((1, a), (2, b)):
            names = {"g_re": f"_r{i}", "g_im": f"_i{i}"}
            if t.get("interp"):
                good = cal.where(~F.col("g_flag")).select(*on, F.col("ant").alias(c), F.col(time_col), *(F.col(k).alias(n) for k, n in names.items()))
                out = asof_join(out, good, [*on, c], time_col, list(names.values()), t["interp"])
            else:
                s = cal.where(~F.col("g_flag")).select(*on, F.col("ant").alias(c), *(F.col(k).alias(n) for k, n in names.items()))
                out = out.join(s, [*on, c], "left")
        g = Complex(F.col("_r1"), F.col("_i1")) * Complex(F.col("_r2"), F.col("_i2")).conj()
        known = g.re.isNotNull()
        v = Complex(F.col("c_re"), F.col("c_im")) / g
        if mode in ("calflag", "calflagstrict", "calonly"):
            out = out.withColumn("_a", F.when(known, v.re).otherwise(F.col("c_re"))).withColumn("_b", F.when(known, v.im).otherwise(F.col("c_im")))
            out = out.drop("c_re", "c_im").withColumnsRenamed({"_a": "c_re", "_b": "c_im"})
            if (calwt or t.get("calwt")) and "weight" in vis.columns:
                out = out.withColumn("weight", F.when(known, F.col("weight") * (g.re * g.re + g.im * g.im)).otherwise(F.col("weight")))
        if mode != "calonly" and mode != "trial":
            out = out.withColumn("c_flag", F.col("c_flag") | ~known)
        out = out.drop("_spw", "_r1", "_i1", "_r2", "_i2")
    return out.select(*vis.columns, "c_re", "c_im", "c_flag") if mode != "trial" else vis


def gain_field(cal: DataFrame, fields: list[int]) -> DataFrame:
    """Only the solutions of some fields."""
    return cal.where(F.col("field").isin(fields)) if fields else cal


def pointing(vis: DataFrame, directions: DataFrame, antenna: str, time_col: str, columns: list[str]) -> DataFrame:
    """Where an antenna points at a row's time: linear between the pointing table's rows of that antenna."""
    return asof(vis, directions.withColumnRenamed("antenna", antenna), [antenna], time_col, columns, "linear")


# --- solvers ------------------------------------------------------------------------------------------------------
def solve_bandpass(vis: DataFrame, keys: list[str], chan: str, a: str, b: str, refant: int = 0, order: int | None = None, **how) -> DataFrame:
    """Antenna gains of each channel (B), normalised to a mean amplitude of 1 over the channels of an antenna; with an order
    a polynomial in channel through their real and imaginary parts (BPOLY)."""
    import numpy as np
    import pandas as pd

    gains = solve_gains(vis, [*keys, chan], a, b, refant, **how)
    mean = gains.where(~F.col("g_flag")).groupBy(*keys, "ant").agg(F.avg(F.hypot("g_re", "g_im")).alias("_m"))
    out = gains.join(mean, [*keys, "ant"], "left").withColumn("g_re", F.col("g_re") / F.col("_m")).withColumn("g_im", F.col("g_im") / F.col("_m")).drop("_m")
    if order is None:
        return out
    kinds = dict(out.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out.columns)

    def smooth(p: pd.DataFrame) -> pd.DataFrame:
        good = ~p["g_flag"].to_numpy()
        if good.sum() > order:
            x = p[chan].to_numpy(float)
            for c in ("g_re", "g_im"):
                y = p[c].to_numpy(float)
                p[c] = np.polyval(np.polyfit(x[good], y[good], order), x)
        return p

    return out.groupBy(*keys, "ant").applyInPandas(smooth, schema)


def solve_delays(vis: DataFrame, keys: list[str], freq: str, a: str, b: str, refant: int = 0, pad: int = 8) -> DataFrame:
    """Antenna delays against the reference antenna (fringe fit over frequency): the peak of each baseline's padded Fourier
    transform to that antenna, refined by a line through the phases it leaves. Rows (keys, ant, delay, snr).

    Visibilities are averaged per baseline and channel before the shuffle.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(vis.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ant long, delay double, snr double"
    sign = F.when(F.col(a) == refant, -1.0).otherwise(1.0)
    d = vis.where((F.col(a) != F.col(b)) & ((F.col(a) == refant) | (F.col(b) == refant)))
    d = d.withColumn("_ant", F.when(F.col(a) == refant, F.col(b)).otherwise(F.col(a)).cast("long"))
    d = d.groupBy(*keys, "_ant", freq).agg(F.avg("re").alias("_re"), F.avg(F.col("im") * sign).alias("_im"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(freq)
        f = p[freq].to_numpy(float)
        v = p["_re"].to_numpy() + 1j * p["_im"].to_numpy()
        step = float(np.median(np.diff(f))) if len(f) > 1 else 1.0
        spec = np.fft.fft(v, pad * len(v))
        lag = np.fft.fftfreq(len(spec), step)[np.argmax(np.abs(spec))]
        left = v * np.exp(-2j * np.pi * lag * f)
        left = left * np.exp(-1j * np.angle(left.sum()))
        w = np.abs(v)
        c = f - np.average(f, weights=w)
        slope = (w * c * np.angle(left)).sum() / max((w * c * c).sum(), 1e-300)
        peak = np.abs((v * np.exp(-2j * np.pi * (lag + slope / (2 * np.pi)) * f)).sum())
        row = {k: [p[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"ant": [int(p["_ant"].iloc[0])], "delay": [lag + slope / (2 * np.pi)], "snr": [peak / max(np.abs(v).sum(), 1e-300)]})

    return d.groupBy(*keys, "_ant").applyInPandas(fit, schema)


def solve_baselines(vis: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Gains of baselines (M): the weighted mean of data over model, in closed form."""
    r = Complex(F.col("re"), F.col("im")) * Complex(F.col("model_re"), F.col("model_im")).conj()
    p = F.sum(F.col("weight") * (F.col("model_re") * F.col("model_re") + F.col("model_im") * F.col("model_im")))
    return vis.groupBy(*keys, a, b).agg((F.sum(F.col("weight") * r.re) / p).alias("g_re"), (F.sum(F.col("weight") * r.im) / p).alias("g_im"), F.count("*").alias("n"))


def solve_leakage(vis: DataFrame, keys: list[str], a: str, b: str, refant: int = 0) -> DataFrame:
    """Instrumental polarization of an unpolarized source: cross hands over the parallel ones are d_a + conj(e_b), linear in
    both; one least-squares problem a key, of a row a baseline. The reference antenna's d is zero. Rows (keys, ant, d_re,
    d_im, e_re, e_im)."""
    import numpy as np
    import pandas as pd

    kinds = dict(vis.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ant long, d_re double, d_im double, e_re double, e_im double"
    mean = vis.where(F.col(a) != F.col(b)).groupBy(*keys, a, b).agg(*(F.avg(c).alias(c) for c in ("x_re", "x_im", "p_re", "p_im")))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        ants = np.unique(p[[a, b]].to_numpy())
        n = len(ants)
        x, y = np.searchsorted(ants, p[a]), np.searchsorted(ants, p[b])
        z = (p["x_re"] + 1j * p["x_im"]).to_numpy() / (p["p_re"] + 1j * p["p_im"]).to_numpy()
        m = np.zeros((len(p) + 1, 2 * n), complex)
        m[np.arange(len(p)), x] = 1
        m[np.arange(len(p)), n + y] = 1
        ref = int(np.searchsorted(ants, refant)) if refant in ants else 0
        m[-1, ref] = 1  # the reference antenna has none
        s = np.linalg.lstsq(m, np.append(z, 0), rcond=None)[0]
        out = pd.DataFrame({k: [p[k].iloc[0]] * n for k in keys}, index=range(n))
        return out.assign(ant=ants, d_re=s[:n].real, d_im=s[:n].imag, e_re=s[n:].real, e_im=-s[n:].imag)

    return mean.groupBy(*keys).applyInPandas(solve, schema)


def sky_gains(on: DataFrame, keys: list[str], time_col: str, value: str, interval: float) -> DataFrame:
    """Single-dish gains: each interval's mean over the key's overall mean."""
    d = on.withColumn("interval", F.floor(F.col(time_col) / interval).cast("long"))
    each = d.groupBy(*keys, "interval").agg(F.avg(value).alias("_m"), F.count("*").alias("n"))
    whole = d.groupBy(*keys).agg(F.avg(value).alias("_all"))
    return each.join(whole, keys).withColumn("gain", F.col("_m") / F.col("_all")).drop("_m", "_all")


def noise(vis: DataFrame, sigma: float, seed: int = 1) -> DataFrame:
    """Simulated thermal noise: independent normal terms on the real and imaginary parts, repeatable for the same partitions."""
    return vis.withColumn("re", F.col("re") + sigma * F.randn(seed)).withColumn("im", F.col("im") + sigma * F.randn(seed + 1))


# --- terms in closed form -----------------------------------------------------------------------------------------
def gain_curve(elevation_angle: Column, coefficients: list[float]) -> Column:
    """Voltage gain by a polynomial of the zenith angle in degrees."""
    return polynomial(90.0 - F.degrees(elevation_angle), coefficients)


def opacity_gain(opacity: Column, elevation_angle: Column) -> Column:
    """Voltage gain that a flat atmosphere of a zenith opacity leaves."""
    return F.exp(-0.5 * opacity / F.sin(elevation_angle))


def tsys_gain(tsys: Column) -> Column:
    """Gain that makes correlation coefficients temperatures when divided out: one over the root."""
    return F.when(tsys > 0, 1 / F.sqrt(tsys))


def switched_power(total: Column, difference: Column, calibration: Column) -> tuple[Column, Column]:
    """Gain and system temperature from the sum and the difference of powers with a noise source on and off."""
    gain = F.when((difference > 0) & (calibration > 0), F.sqrt(difference / calibration))
    return gain, total * calibration / (2 * difference)


def radiometer_gains(df: DataFrame, keys: list[str], channels: list[str], coefficients: list[float], freq: float) -> DataFrame:
    """Phase gains from water vapour radiometers: each channel's change of temperature from its key's mean, times how much
    path (m) a kelvin of it is, summed over the channels and turned into phase at a frequency (Hz)."""
    means = df.groupBy(*keys).agg(*(F.avg(c).alias(f"_{c}") for c in channels))
    j = df.join(means, keys)
    path = reduce(lambda a, b: a + b, (k * (F.col(c) - F.col(f"_{c}")) for c, k in zip(channels, coefficients, strict=True)))
    phase = -2 * math.pi * freq / C_M_S * path
    return j.withColumn("path", path).withColumn("g_re", F.cos(phase)).withColumn("g_im", F.sin(phase)).drop(*(f"_{c}" for c in channels))


def plot_points(cal: DataFrame, x: str, y: str, series: list[str], flagged: bool = False) -> DataFrame:
    """A calibration table as points of a plot: x a column, y amp, phase (degrees), real, imag or a column, by series."""
    axis = {"amp": F.hypot("g_re", "g_im"), "phase": F.degrees(F.atan2("g_im", "g_re")), "real": F.col("g_re"), "imag": F.col("g_im")}.get(y)
    d = cal if flagged else cal.where(~F.col("g_flag"))
    return d.select(*series, F.col(x).alias("x"), (axis if axis is not None else F.col(y)).alias("y"))
