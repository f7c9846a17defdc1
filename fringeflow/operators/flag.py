"""Flagging: rules that set a boolean column (true is bad), and named versions of it."""

from __future__ import annotations

import math
import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .average import with_groups
from .stats import window_median


def manual(selected: Column) -> Column:
    return F.coalesce(selected, F.lit(False))


def clip(value: Column, low: float | None = None, high: float | None = None, outside: bool = True, zeros: bool = False) -> Column:
    """Outside: beyond the bounds; inside: within them, bounds too. NaN always, zero if asked; without bounds only these."""
    bad = F.isnan(value.cast("double"))
    if low is not None and high is not None:
        test = (value > high) | (value < low) if outside else value.between(low, high)
        bad = bad | test
    if zeros:
        bad = bad | (value == 0)
    return F.coalesce(bad, F.lit(False))


def quack(df: DataFrame, time_col: str, keys: list[str], interval: float = 1.0, mode: str = "beg", flag: str | None = None, increment: bool = False) -> DataFrame:
    """Edges of each scan (keys). beg: t <= start + q; endb: t >= stop - q; tail: t > start + q; end: t < stop - q.

    With increment the start and stop are those of unflagged rows.
    """
    if interval <= 0:
        raise ValueError("the interval is above zero")
    t = F.col(time_col)
    seen = F.when(~F.col(flag), t) if increment and flag else t
    df = with_groups(df, keys, _start=F.min(seen), _stop=F.max(seen))
    start, stop = F.col("_start"), F.col("_stop")
    test = {"beg": t <= start + interval, "endb": t >= stop - interval, "tail": t > start + interval, "end": t < stop - interval}[mode]
    return df.withColumn("quack", F.coalesce(test, F.lit(False))).drop("_start", "_stop")


def elevation(el1: Column, el2: Column, lower: float = 0.0, upper: float = 90.0) -> Column:
    return (el1 < lower) | (el1 > upper) | (el2 < lower) | (el2 > upper)


def extend_time(df: DataFrame, flag: str, keys: list[str], time_col: str, reach: int) -> DataFrame:
    """A row is flagged if one of its group within `reach` units of the integer time column is."""
    w = Window.partitionBy(*keys).orderBy(time_col).rangeBetween(-reach, reach)
    return df.withColumn("extended", F.max(F.col(flag)).over(w))


def grow(df: DataFrame, flag: str, keys: list[str], percent: float) -> DataFrame:
    """Whole groups whose flagged share exceeds a percentage."""
    d = with_groups(df, keys, _share=100 * F.avg(F.col(flag).cast("double")))
    return d.withColumn("grown", F.col(flag) | (F.col("_share") > percent)).drop("_share")


def grow_around(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """A row both of whose neighbours are flagged."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.coalesce(F.lag(flag).over(w), F.lit(False)) & F.coalesce(F.lead(flag).over(w), F.lit(False))
    return df.withColumn("grown", F.col(flag) | near)


def antenna_integrations(df: DataFrame, flag: str, time_keys: list[str], baseline: str, fraction: float = 0.6) -> DataFrame:
    """Times at which every baseline has more than a fraction of its samples flagged: all rows of such times are flagged."""
    per = df.groupBy(*time_keys, baseline).agg(F.avg(F.col(flag).cast("double")).alias("_f"))
    bad = per.groupBy(*time_keys).agg(F.min("_f").alias("_f")).where(F.col("_f") > fraction).select(*time_keys, F.lit(True).alias("_bad"))
    return df.join(bad, time_keys, "left").withColumn("antint", F.col(flag) | F.coalesce("_bad", F.lit(False))).drop("_bad")


def median_clip(df: DataFrame, value: str, keys: list[str], order: str, half: int, cut: float) -> DataFrame:
    """|value - sliding median| against cut times the median of such deviations in the group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    d = df.withColumn("_d", F.abs(F.col(value) - window_median(F.col(value), w)))
    s = d.groupBy(*keys).agg(F.median("_d").alias("_s"))
    return d.join(s, keys).withColumn("clipped", F.col("_d") > cut * F.col("_s")).drop("_d", "_s")


def rflag(df: DataFrame, value: str, keys: list[str], group: list[str], order: str, half: int = 1, scale: float = 5.0) -> DataFrame:
    """Local standard deviation in time per series (keys), held against scale times the median over the group's series."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    d = df.withColumn("rms", F.stddev_pop(value).over(w))
    t = d.groupBy(*group).agg((scale * F.median("rms")).alias("threshold"))
    return d.join(t, group).withColumn("rflag", F.col("rms") > F.col("threshold"))


def rflag_thresholds(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merges thresholds found on parts of a set: their median per key."""
    return parts.groupBy(*keys).agg(F.median("threshold").alias("threshold"))


def time_freq_crop(df: DataFrame, keys: list[str], time_col: str, chan: str, value: str, cut: float = 4.0, rounds: int = 3, pieces: int = 1) -> DataFrame:
    """Per group a robust line through the mean bandpass and through the mean time series; samples beyond cut deviations.
    pieces: each axis is cut into so many equal runs, a line each.

    The fits are iterative, so each group goes to an Arrow function; a group is one baseline's block of time.
    """
    import numpy as np
    import pandas as pd

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cropped boolean"

    def crop(p: pd.DataFrame) -> pd.DataFrame:
        v = p[value].to_numpy(float)
        bad = np.isnan(v)
        for axis in (chan, time_col):
            x = p[axis].to_numpy(float)
            part = np.minimum(((x - x.min()) / (np.ptp(x) or 1.0) * pieces).astype(int), pieces - 1)
            for _ in range(rounds):
                r = np.zeros(len(v))
                for k in np.unique(part):
                    own = part == k
                    good = own & ~bad
                    if good.sum() >= 3:
                        r[own] = v[own] - np.polyval(np.polyfit(x[good], v[good], 1 if np.ptp(x[good]) > 0 else 0), x[own])
                bad |= np.abs(r) > cut * (np.std(r[~bad]) or np.inf)
        return p.assign(cropped=bad)

    return df.groupBy(*keys).applyInPandas(crop, schema)


def shadow(antennas: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(time, ant) of antennas that another one, nearer the source, overlaps: rows (time, ant, u, v, w, diameter).

    Antennas are sorted into square cells whose diagonal is the farthest that two can overlap. Each is held against the
    one of its cell nearest the source, which settles nearly all where many share a cell; only the rest are joined to the
    antennas of the 25 cells about, and of these only to cells that hold a nearer one.
    """
    farthest = antennas.agg((F.max("diameter") - tolerance).alias("_far"))  # one row
    cell = lambda c: F.floor(F.least(F.greatest(F.col(c) / (F.col("_far") / math.sqrt(2)), F.lit(-1e15)), F.lit(1e15)))
    at, one = ["time", "_x", "_y"], ["ant", "u", "v", "w", "diameter"]
    d = antennas.select("time", *one).crossJoin(F.broadcast(farthest)).where("_far > 0").select("time", *one, cell("u").alias("_x"), cell("v").alias("_y"))

    def overlaps(o) -> Column:
        near = F.hypot(F.col("u") - o("u"), F.col("v") - o("v")) < (F.col("diameter") + o("diameter")) / 2 - tolerance
        return F.coalesce((F.col("ant") != o("ant")) & near & (F.col("w") < o("w")), F.lit(False))

    first = Window.partitionBy(*at).orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = d.withColumn("_o", F.first(F.struct(*one)).over(first)).withColumn("_hit", overlaps(lambda c: F.col(f"_o.{c}"))).drop("_o")
    about = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)))
    rest = held.where(~F.col("_hit")).select("*", F.explode(about).alias("_n")).select("time", *one, (F.col("_x") + F.col("_n.i")).alias("_x"), (F.col("_y") + F.col("_n.j")).alias("_y"))
    rest = rest.join(d.groupBy(*at).agg(F.max("w").alias("_top")), at).where("_top > w").drop("_top")
    found = rest.join(d.select(*at, *(F.col(c).alias("o_" + c) for c in one)), at).where(overlaps(lambda c: F.col("o_" + c)))
    return held.where("_hit").select("time", "ant").unionByName(found.select("time", "ant")).distinct()


def uv_bin_population(df: DataFrame, uv: Column, amp: Column, nu: int, na: int, uv_max: float, amp_max: float, least: int) -> DataFrame:
    """Rows in thinly filled cells of a (uv, amplitude) grid."""
    cell = lambda c, n, top: F.least(F.floor(c / top * n), F.lit(n - 1))
    d = df.withColumn("_u", cell(uv, nu, uv_max)).withColumn("_a", cell(amp, na, amp_max))
    n = d.groupBy("_u", "_a").agg(F.count("*").alias("population"))
    return d.join(n, ["_u", "_a"]).withColumn("thin", F.col("population") < least).drop("_u", "_a")


def merge(current: Column, saved: Column, how: str) -> Column:
    return {"or": current | saved, "and": current & saved, "replace": saved}[how]


class Versions:
    """Named snapshots of flags by row id, as Parquet tables under one folder with a list of names and comments."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path("")) if s.isDirectory())

    def save(self, df: DataFrame, name: str, row_id: str = "row_id", flag: str = "flag") -> None:
        if name in self.names():  # the older one keeps its flags under another name
            self.rename(name, f"{name}.old.{int(time.time())}")
        df.select(F.col(row_id).alias("row_id"), F.col(flag).alias("flag")).write.parquet(f"{self.root}/{name}")

    def restore(self, df: DataFrame, name: str, how: str = "replace", row_id: str = "row_id", flag: str = "flag") -> DataFrame:
        saved = self.spark.read.parquet(f"{self.root}/{name}").select(F.col("row_id").alias(row_id), F.col("flag").alias("_saved"))
        j = df.join(saved, row_id, "left")
        return j.withColumn(flag, F.coalesce(merge(F.col(flag), F.col("_saved"), how), F.col(flag))).select(*df.columns)

    def rename(self, name: str, to: str) -> None:
        self._fs().rename(self._path(name), self._path(to))

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


# --- more agents --------------------------------------------------------------------------------------------------
_CORRELATION = re.compile(r"\s*([+-]?)\s*(?:(ABS|ARG|RE|IM|NORM)\s*\()?\s*([A-Z]{1,2})\s*\)?\s*", re.I)


def value_of(expression: str, re_of: str = "re_{}", im_of: str = "im_{}") -> Column:
    """The value that an agent looks at: `ABS XX`-like terms ABS, ARG, RE, IM or NORM of correlations, added and taken
    away: `ABS(XX)`, `ABS(XX)-ABS(YY)`, `RE(XX)+RE(YY)`. A bare correlation is its amplitude."""
    at, out = 0, None
    while at < len(expression):
        m = _CORRELATION.match(expression, at)
        if not m or (out is not None and not m[1]):
            raise ValueError(f"no value: {expression!r}")
        a, b = F.col(re_of.format(m[3].lower())), F.col(im_of.format(m[3].lower()))
        term = {"ABS": F.hypot(a, b), "ARG": F.atan2(b, a), "RE": a, "IM": b, "NORM": a * a + b * b}[(m[2] or "ABS").upper()]
        term = -term if m[1] == "-" else term
        out, at = term if out is None else out + term, m.end()
    if out is None:
        raise ValueError("an empty value")
    return out


def angle_apart(a: Column, b: Column) -> Column:
    """The distance of two cyclic angles, at most half a turn."""
    d = F.pmod(a - b, F.lit(2 * math.pi))
    return F.least(d, 2 * math.pi - d)


def spectral_median_clip(df: DataFrame, value: str, keys: list[str], chan: str, half: int, cut: float) -> DataFrame:
    """median_clip() along channels: a spectrum's values against their sliding median."""
    return median_clip(df, value, keys, chan, half, cut)


def spectral_rejection(df: DataFrame, value: str, keys: list[str], chan: str, cut: float) -> DataFrame:
    """Per row a line through its spectrum, in closed form; channels beyond `cut` deviations of the residuals."""
    x, y = F.col(chan).cast("double"), F.col(value)
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    d = df.join(fit, keys).withColumn("_r", y - F.col("_a") - F.col("_b") * x)
    s = d.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("_s"))
    return d.join(s, keys).withColumn("rejected", F.abs("_r") > cut * F.col("_s")).drop("_a", "_b", "_r", "_s")


def row_clip(df: DataFrame, value: str, row_keys: list[str], group: list[str], cut: float) -> DataFrame:
    """Rows whose mean value is further than `cut` median deviations from the median of their group's rows."""
    rows = df.groupBy(*row_keys, *[g for g in group if g not in row_keys]).agg(F.avg(value).alias("_mean"))
    m = rows.groupBy(*group).agg(F.median("_mean").alias("_med"))
    r = rows.join(m, group).withColumn("_dev", F.abs(F.col("_mean") - F.col("_med")))
    s = r.groupBy(*group).agg(F.median("_dev").alias("_mad"))
    return r.join(s, group).select(*row_keys, *[g for g in group if g not in row_keys], (F.col("_dev") > cut * F.col("_mad")).alias("clipped"))


def rflag_spectral(df: DataFrame, value: str, keys: list[str], group: list[str], chan: str, half: int = 1, scale: float = 5.0) -> DataFrame:
    """The spectral part: a channel's distance from the mean of its neighbours, against scale times the group's median of it."""
    w = Window.partitionBy(*keys).orderBy(chan).rowsBetween(-half, half)
    d = df.withColumn("deviation", F.abs(F.col(value) - F.avg(value).over(w)))
    t = d.groupBy(*group).agg((scale * F.median("deviation")).alias("threshold"))
    return d.join(t, group).withColumn("rflag", F.col("deviation") > F.col("threshold"))


def rflag_passes(df: DataFrame, value: str, keys: list[str], group: list[str], order: str, half: int = 1, scale: float = 5.0, passes: int = 2) -> DataFrame:
    """Several passes: what a pass flags does not enter the next one's thresholds. Adds `rflag`."""
    d = df.withColumn("rflag", F.lit(False))
    for _ in range(passes):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
        d = d.withColumn("_rms", F.stddev_pop(F.when(~F.col("rflag"), F.col(value))).over(w))
        t = d.where(~F.col("rflag")).groupBy(*group).agg((scale * F.median("_rms")).alias("_t"))
        d = d.join(t, group, "left").withColumn("rflag", F.col("rflag") | F.coalesce(F.col("_rms") > F.col("_t"), F.lit(False))).drop("_rms", "_t")
    return d


def report(flags: dict[str, tuple[DataFrame, str]], keys: list[str]) -> DataFrame:
    """What several agents flagged: (agent, keys, flagged, total), one row an agent and group."""
    rows = [df.groupBy(*keys).agg(F.sum(F.col(c).cast("long")).alias("flagged"), F.count("*").alias("total")).withColumn("agent", F.lit(name)) for name, (df, c) in flags.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)
