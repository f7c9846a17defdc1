"""Averages, bins and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import window_median


def with_groups(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of each row's group. The groups are aggregated and joined back, null keys too: unlike a window
    this ships no row to its group's one task, and a short table of groups is broadcast by its measured size."""
    named = {k: f"_{k}_of" for k in keys}
    g = df.groupBy(*(F.col(k).alias(n) for k, n in named.items())).agg(*(c.alias(n) for n, c in aggregates.items()))
    return df.join(g, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()), F.lit(True))).drop(*named.values())


def with_time_bin(df: DataFrame, time_col: str, bounds: list[str], width: float, name: str = "bin", many: bool = False) -> DataFrame:
    """Bins that start anew at each boundary group's first time. many: the groups are many and short, so a window over
    them deals the rows as an aggregate by group and bin needs them anyway: one shuffle. Else grouped minima are joined back."""
    if many:
        start = F.min(time_col).over(Window.partitionBy(*bounds))
        return df.withColumn(name, F.floor((F.col(time_col) - start) / width).cast("long"))
    d = with_groups(df, bounds, _start=F.min(time_col))
    return d.withColumn(name, F.floor((F.col(time_col) - F.col("_start")) / width).cast("long")).drop("_start")


def time_average(
    df: DataFrame, time_col: str, bounds: list[str], keys: list[str], width: float, value: str, weight: Column, flag: Column | None = None, many: bool = False
) -> DataFrame:
    """Weighted mean per boundary group, key and bin; where all is flagged, the flagged mean, flagged. many: as in with_time_bin()."""
    d = with_time_bin(df, time_col, bounds, width, many=many)
    good = ~flag if flag is not None else F.lit(True)
    some = F.max(good)
    v, w = F.col(value), weight
    mean = F.sum(F.when(good, v * w)) / F.sum(F.when(good, w))
    return d.groupBy(*bounds, *keys, "bin").agg(
        F.count("*").alias("n"), F.when(some, mean).otherwise(F.sum(v * w) / F.sum(w)).alias("value"), F.sum(F.when(good, w)).alias("weight"),
        (~some).alias("flag"), F.avg(time_col).alias("time"),
    )


def gap_sessions(df: DataFrame, time_col: str, series: list[str], field: str, gap: float, array: str) -> DataFrame:
    """Scan numbers: a new one when a field's gap exceeds the limit or the array differs from the row before; rows take
    their field's latest scan. The running count over a series is a window of that series."""
    w = Window.partitionBy(*series).orderBy(time_col, *[field, array])
    per = Window.partitionBy(*series, field).orderBy(time_col, array)
    last = F.lag(time_col).over(per)
    new = last.isNull() | (F.col(time_col) - last > gap) | (F.col(array) != F.coalesce(F.lag(array).over(w), F.col(array)))
    d = df.withColumn("_new", new.cast("int"))
    d = d.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    scan = F.last(F.when(F.col("_new") == 1, F.col("_n")), ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("scan", scan).drop("_new", "_n")


def baseline_average(df: DataFrame, keys: list[str], time_col: str, u: str, v: str, value: str, max_distance: float, max_time: float) -> DataFrame:
    """Runs of samples that stay within a uv distance and a time span of the run's first one, averaged.

    Where a run ends depends on where it began, so each baseline is walked once in an Arrow function.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", run long, n long, `{time_col}` double, `{value}` double"

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(time_col, kind="stable")
        t, x, y = (p[c].to_numpy(float) for c in (time_col, u, v))
        run = np.zeros(len(p), int)
        first = 0
        for i in range(1, len(p)):
            if np.hypot(x[i] - x[first], y[i] - y[first]) > max_distance or t[i] - t[first] > max_time:
                first, run[i] = i, run[i - 1] + 1
            else:
                run[i] = run[i - 1]
        g = p.assign(run=run).groupby([*keys, "run"], as_index=False).agg(n=(value, "size"), **{time_col: (time_col, "mean"), value: (value, "mean")})
        return g[[*keys, "run", "n", time_col, value]]

    return df.groupBy(*keys).applyInPandas(walk, schema)


def channel_average(df: DataFrame, keys: list[str], chan: str, width: int, value: str, weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    return df.groupBy(*keys, F.floor(F.col(chan) / width).cast("int").alias("bin")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("value"), F.count("*").alias("n"))


def _variance(x: Column, w: Column) -> Column:
    return (F.sum(w * x * x) - F.pow(F.sum(w * x), 2) / F.sum(w)) / F.count(x)


def weigh_by_scatter(
    df: DataFrame, keys: list[str], re: str, im: str, exposure: str, least: int = 2, flag: str | None = None, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Weight exposure / variance per group, variance the mean of those of the real and imaginary parts over unflagged rows.

    Groups of fewer than `least` unflagged samples weigh 0; weight 0, or outside [low, high], flags.
    """
    good = df.where(~F.col(flag)) if flag else df
    x = F.col(exposure).cast("double")
    var = (_variance(F.col(re), x) + _variance(F.col(im), x)) / 2
    g = good.groupBy(*keys).agg(F.count("*").alias("npts"), var.alias("variance"))
    d = df.join(g, keys, "left")
    w = F.when((F.col("npts") >= least) & (F.col("variance") > 0), F.col(exposure) / F.col("variance")).otherwise(0.0)
    d = d.withColumn("weight", w)
    bad = F.col("weight") == 0
    if low is not None and high is not None:
        bad = bad | ~F.col("weight").between(low, high)
    return d.withColumn("weight_flag", bad | F.col(flag) if flag else bad)


def weigh_by_window(df: DataFrame, keys: list[str], order: str, value: str, half: int, rows: bool = False, least: int = 2) -> DataFrame:
    """1 / population variance of a sliding window, by range of the integer order column or by rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(-half, half) if rows else w.rangeBetween(-half, half)
    n, var = F.count(value).over(w), F.var_pop(value).over(w)
    return df.withColumn("npts", n).withColumn("weight", F.when((F.col("npts") >= least) & (var > 0), 1 / var).otherwise(0.0))


def nominal_weight(channel_width: Column, exposure: Column) -> Column:
    """2 * bandwidth * time."""
    return 2 * channel_width * exposure


def collapse_channels(flags: Column, weights: Column) -> tuple[Column, Column]:
    """Row flag (all channels flagged) and row weight (mean of the unflagged channels') from arrays."""
    good = F.filter(F.zip_with(flags, weights, lambda f, w: F.when(~f, w)), lambda x: x.isNotNull())
    total = F.aggregate(good, F.lit(0.0), lambda a, x: a + x)
    return F.forall(flags, lambda f: f), F.when(F.size(good) > 0, total / F.size(good)).otherwise(0.0)


def smooth_time(df: DataFrame, keys: list[str], tick: str, value: str, width: int, how: str = "mean", flag: str | None = None) -> DataFrame:
    """Mean or median over (t - width / 2, t + width / 2] of an integer time; a slot is good if any in its window is.

    Groups of a single slot keep their value.
    """
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(tick).rangeBetween(-half + 1, half)
    whole = Window.partitionBy(*keys)
    v = F.when(~F.col(flag), F.col(value)) if flag else F.col(value)
    s = F.avg(v).over(w) if how == "mean" else window_median(v, w)
    return df.withColumn("smoothed", F.when(F.count("*").over(whole) > 1, s).otherwise(F.col(value)))


def unwrap(df: DataFrame, keys: list[str], order: str, phase: str) -> DataFrame:
    """Adds whole turns so that no step exceeds half a turn."""
    w = Window.partitionBy(*keys).orderBy(order)
    turns = F.sum(F.coalesce(-F.round((F.col(phase) - F.col("_p")) / (2 * 3.141592653589793)), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_p", F.lag(phase).over(w)).withColumn("unwrapped", F.col(phase) + 2 * 3.141592653589793 * turns).drop("_p")


# --- more averages ------------------------------------------------------------------------------------------------
def polarization_average(df: DataFrame, keys: list[str], value: str, weight: Column | None = None, flag: Column | None = None) -> DataFrame:
    """Half the sum of the two parallel hands, or the one that is there: the mean over a row's unflagged polarizations."""
    v = F.when(~flag, F.col(value)) if flag is not None else F.col(value)
    w = F.when(v.isNotNull(), weight if weight is not None else F.lit(1.0))
    return df.groupBy(*keys).agg((F.sum(v * w) / F.sum(w)).alias("value"))


def relabel_beams(antenna: Column, beams: list[int], on_source: Column) -> Column:
    """Rows of the chosen beams on the source become rows of the least one of them."""
    return F.when(antenna.isin(beams) & on_source, F.lit(min(beams))).otherwise(antenna)


def beam_average(df: DataFrame, antenna: str, beams: list[int], on_source: Column, keys: list[str], value: str) -> DataFrame:
    d = df.withColumn("beam", relabel_beams(F.col(antenna), beams, on_source))
    return d.groupBy("beam", *keys).agg(F.avg(value).alias("value"), F.count("*").alias("n"))


def single_dish_average(df: DataFrame, time_col: str, keys: list[str], value: str, weight: Column, bin_width: float | None, scan: str, state: str, span: tuple[str, ...] = ()) -> DataFrame:
    """Time averages that stay inside a scan and a state unless `span` names these. bin_width None: all of it is one bin,
    zero: none is averaged, else bins that start anew at each group's first time."""
    bounds = [c for c, name in ((scan, "scan"), (state, "state")) if name not in span]
    if bin_width == 0:
        return df.select(*bounds, *keys, F.col(time_col).alias("time"), F.col(value).alias("value"), weight.alias("weight"), F.lit(1).cast("long").alias("n"))
    d = df.withColumn("_w", weight)
    d = with_time_bin(d, time_col, [*bounds, *keys], bin_width, "_bin") if bin_width is not None else d.withColumn("_bin", F.lit(0))
    return d.groupBy(*bounds, *keys, "_bin").agg(
        F.avg(time_col).alias("time"), (F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"), F.count("*").alias("n")
    ).drop("_bin")


def vector_or_scalar(df: DataFrame, keys: list[str], re: str, im: str, mode: str = "vector") -> DataFrame:
    """Amplitude and phase of an average: of the complex mean (vector), or the means of the amplitudes and phases (scalar)."""
    if mode == "vector":
        a, b = F.avg(re), F.avg(im)
        return df.groupBy(*keys).agg(F.hypot(a, b).alias("amp"), F.atan2(b, a).alias("phase"), F.count("*").alias("n"))
    if mode != "scalar":
        raise ValueError(f"unknown mode {mode!r}")
    return df.groupBy(*keys).agg(F.avg(F.hypot(re, im)).alias("amp"), F.avg(F.atan2(im, re)).alias("phase"), F.count("*").alias("n"))


def channel_rows(df: DataFrame, keys: list[str], spw: str, chan: str, rows: list[tuple[int, int, int, int]], value: str) -> DataFrame:
    """Channels chosen and averaged by rows (spw, start, end, step), ends included: `range` numbers the row, `bin` the mean
    of `step` channels inside it (the last one may have fewer), `name` says what it is made of."""
    found = []
    for i, (s, start, end, step) in enumerate(rows):
        if step < 1 or end < start:
            raise ValueError(f"no channel row: {rows[i]}")
        d = df.where((F.col(spw) == s) & F.col(chan).between(start, end))
        b = F.floor((F.col(chan) - start) / step).cast("int")
        found.append(d.select(*keys, F.lit(i).alias("range"), b.alias("bin"), F.lit(start).alias("_s"), F.lit(step).alias("_k"), F.lit(end).alias("_e"), F.lit(s).alias("_spw"), F.col(value).alias("_v")))
    u = reduce(lambda a, b: a.unionAll(b), found)
    lo = F.col("_s") + F.col("bin") * F.col("_k")
    hi = F.least(lo + F.col("_k") - 1, F.col("_e"))
    name = F.concat(F.col("_spw").cast("string"), F.lit(":"), lo.cast("string"), F.lit("~"), hi.cast("string"))
    return u.groupBy(*keys, "range", "bin", name.alias("name")).agg(F.avg("_v").alias("value"), F.count("*").alias("n"))


def accumulate(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """Sums that can be merged: of weights, weighted values and rows."""
    return df.groupBy(*keys).agg(F.sum(weight).alias("w"), F.sum(F.col(value) * weight).alias("wx"), F.count("*").alias("n"))


def merge_accumulated(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The average of what several accumulators hold."""
    u = reduce(lambda a, b: a.unionByName(b), parts)
    g = u.groupBy(*keys).agg(F.sum("w").alias("weight"), F.sum("wx").alias("_wx"), F.sum("n").alias("n"))
    return g.select(*keys, (F.col("_wx") / F.col("weight")).alias("value"), "weight", "n")


def flags_and_weights(df: DataFrame, keys: list[str], flag: Column, weight: Column) -> DataFrame:
    """How flags and weights average: flagged if all are, weight the sum of the unflagged ones' (of all where all are flagged)."""
    some = F.max(~flag)
    return df.groupBy(*keys).agg((~some).alias("flag"), F.when(some, F.sum(F.when(~flag, weight))).otherwise(F.sum(weight)).alias("weight"))


# --- more weights -------------------------------------------------------------------------------------------------
COLUMNS = ("DATA", "CORRECTED", "RESIDUAL", "RESIDUAL_DATA")


def weighted_column(which: str, data: Column, corrected: Column, model: Column) -> Column:
    """What the scatter is taken of: the data, the corrected data, or one of them less the model."""
    if which.upper() not in COLUMNS:
        raise ValueError(f"{which!r} is none of {', '.join(COLUMNS)}")
    of = corrected if which.upper() in ("CORRECTED", "RESIDUAL") else data
    return of - model if which.upper().startswith("RESIDUAL") else of


def weigh_by_rms(df: DataFrame, keys: list[str], value: str, flag: Column, about_zero: bool = False, least: int = 2) -> DataFrame:
    """The older setter: one over the variance of each group's unflagged values, about their mean or about zero; groups of
    fewer than `least` weigh 0 and are flagged."""
    v = F.when(~flag, F.col(value))
    var = F.avg(v * v) if about_zero else F.var_pop(v)
    d = with_groups(df, keys, npts=F.count(v), _var=var)
    w = F.when((F.col("npts") >= least) & (F.col("_var") > 0), 1 / F.col("_var")).otherwise(0.0)
    return d.withColumn("weight", w).withColumn("weight_flag", (F.col("weight") == 0) | flag).drop("_var")


def initial_weights(df: DataFrame, mode: str, width: Column, exposure: Column, sigma: Column | None = None, tsys: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Weights before any data are looked at. ones; nyq: 2 * bandwidth * time; sigma: one over its square; tsys: nyq over the
    squared system temperature of the row's keys (null where the table has none)."""
    if mode == "ones":
        return df.withColumn("weight", F.lit(1.0))
    if mode == "nyq":
        return df.withColumn("weight", nominal_weight(width, exposure))
    if mode == "sigma":
        return df.withColumn("weight", F.when(sigma > 0, 1 / (sigma * sigma)).otherwise(0.0))
    if mode == "tsys":
        d = df.join(tsys.select(*keys, F.col("tsys").alias("_t")), keys, "left")
        return d.withColumn("weight", nominal_weight(width, exposure) / (F.col("_t") * F.col("_t"))).drop("_t")
    raise ValueError(f"unknown mode {mode!r}")
