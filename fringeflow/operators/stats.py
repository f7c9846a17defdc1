"""Grouped statistics: plain, robust, histograms, collapses, moments, flag summaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import XMADM, min_match
from ..session import Scratch


QUARTILES = {"median": 0.5, "firstquartile": 0.25, "thirdquartile": 0.75}


def _quantile(v: Column, share: float, accuracy: int | None) -> Column:
    return F.percentile(v, share) if accuracy is None else F.percentile_approx(v, share, accuracy)


def _beside(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with what its group's one row has, null keys too. The groups are few and broadcast."""
    g = groups.withColumnsRenamed({k: f"_{k}_of" for k in keys})
    return df.join(F.broadcast(g), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys), F.lit(True)), how).drop(*(f"_{k}_of" for k in keys))


def exact_quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float], sketch: int = 2000) -> DataFrame:
    """Exact quantiles, as those of percentile(), of few groups of any size; groups without a value have no row.

    A sketch of each group gives an interval about each quantile, one reading counts the values below it and up to its end,
    and only the values inside are sorted, about 6 / sketch of a group for each quantile. An interval that proves not to hold
    its quantile reaches to the group's extreme instead, so that no result rests on the sketch.
    """
    v, each = F.col(value), range(len(shares))
    good = df.select(*keys, value).where(v.isNotNull())
    near = [min(max(q + d / sketch, 0.0), 1.0) for q in shares.values() for d in (-2, 2)]
    s = good.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, near, sketch).alias("_near"))
    s = s.select(*keys, "_n", "_min", "_max", *(F.col("_near")[2 * i + j].alias(f"_{end}{i}") for i in each for j, end in enumerate(("lo", "hi"))))
    lo, hi, below, upto = ([F.col(f"_{c}{i}") for i in each] for c in ("lo", "hi", "below", "upto"))
    counts = (c for i in each for c in (F.count_if(v < lo[i]).alias(f"_below{i}"), F.count_if(v <= hi[i]).alias(f"_upto{i}")))
    c = _beside(good, s, keys).groupBy(*keys, *(x for x in s.columns if x not in keys)).agg(*counts)
    place = [F.lit(float(q)) * (F.col("_n") - 1) for q in shares.values()]
    left, right = [F.floor(p) for p in place], [F.ceil(p) for p in place]
    starts, ends = [below[i] <= left[i] for i in each], [upto[i] > right[i] for i in each]
    c = c.select(
        *keys, "_n", *(F.when(starts[i], lo[i]).otherwise(F.col("_min")).alias(f"_lo{i}") for i in each), *(F.when(ends[i], hi[i]).otherwise(F.col("_max")).alias(f"_hi{i}") for i in each),
        *(F.when(starts[i], below[i]).otherwise(0).alias(f"_below{i}") for i in each),
    )
    inside = [v.between(lo[i], hi[i]) for i in each]
    held = _beside(good, c, keys).where(reduce(lambda a, b: a | b, inside)).groupBy(*c.columns, value).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the values inside
    run = held.select(*keys, "_n", value, *(F.when(inside[i], below[i] + F.sum(F.when(inside[i], F.col("_m"))).over(w)).alias(f"_upto{i}") for i in each))
    ranks = (F.min(F.when(upto[i] > r[i], v)).alias(f"_{end}{i}") for i in each for end, r in (("lo", left), ("hi", right)))
    between = lambda i: F.when(lo[i] == hi[i], lo[i]).otherwise((right[i] - place[i]) * lo[i] + (place[i] - left[i]) * hi[i])
    return run.groupBy(*keys, "_n").agg(*ranks).select(*keys, *(between(i).alias(n) for i, n in enumerate(shares)))


def statistics(
    df: DataFrame, value: Column, keys: list[str], flag: Column | None = None, quantiles: bool = True, accuracy: int | None = None, few: bool = False
) -> DataFrame:
    """npts, min, max, sum, sumsq, mean, variance (sample), stddev, rms and quartiles of unflagged values per group.

    A group whose values are all flagged keeps its row with npts 0. Exact quartiles hold a group's distinct values in one
    task; with an accuracy they come from a sketch of that size, off by at most 1 / accuracy in rank. few: the groups are few
    and may be large, so exact quartiles come from exact_quantiles().
    """
    v = value.cast("double")
    v = F.when(~flag, v) if flag is not None else v
    aggs = [
        F.count(v).alias("npts"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.avg(v).alias("mean"),
        F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("stddev"), F.sqrt(F.avg(v * v)).alias("rms"),
    ]
    if quantiles and few and accuracy is None:
        return _beside(df.groupBy(*keys).agg(*aggs), exact_quantiles(df.select(*keys, v.alias("_v")), "_v", keys, QUARTILES), keys, "left")
    if quantiles:
        aggs += [_quantile(v, q, accuracy).alias(n) for n, q in QUARTILES.items()]
    return df.groupBy(*keys).agg(*aggs)


def deviation_median(df: DataFrame, value: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Median and median absolute deviation from it, per group: two grouped passes and one join on the keys. accuracy: as in statistics()."""
    med = df.groupBy(*keys).agg(_quantile(F.col(value), 0.5, accuracy).alias("median"))
    return df.join(med, keys).groupBy(*keys).agg(F.first("median").alias("median"), _quantile(F.abs(F.col(value) - F.col("median")), 0.5, accuracy).alias("medabsdevmed"))


def window_median(value: Column, window) -> Column:
    """Median over an ordered frame, which the aggregate itself does not take: the frame's sorted values' middle."""
    a = F.sort_array(F.collect_list(value).over(window))
    n = F.size(a)
    return (F.get(a, ((n - 1) / 2).cast("int")) + F.get(a, (n / 2).cast("int"))) / 2


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def hinges_fences(df: DataFrame, value: str, keys: list[str], f: float = 1.5) -> DataFrame:
    """Rows within the quartiles plus and minus f times their distance."""
    q = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    d = f * (F.col("_q3") - F.col("_q1"))
    return df.join(q, keys).where(F.col(value).between(F.col("_q1") - d, F.col("_q3") + d)).drop("_q1", "_q3")


def z_score(df: DataFrame, value: str, keys: list[str], z: float | None = None, rounds: int = 1, until_stable: bool = False) -> DataFrame:
    """Rows within z deviations of their group's mean, `rounds` times over; without z Chauvenet's criterion for each group's size.

    The criterion z(n) solves n erfc(z / sqrt 2) = 1 / 2; it is evaluated by a column formula good to 0.5 per cent.
    until_stable: rounds end once no row is left out; the rows are counted after each, and saved to be read once.
    """
    scratch = Scratch(df.sparkSession, "clipped") if until_stable else None
    n = df.count() if until_stable else -1
    for _ in range(rounds):
        m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
        limit = F.lit(z) if z is not None else chauvenet(F.col("_n"))
        df = df.join(m, keys).where(F.abs(F.col(value) - F.col("_m")) <= limit * F.col("_s")).drop("_m", "_s", "_n")
        if scratch is not None:
            df = scratch.save(df)
            left = df.count()
            if left == n:
                break
            n = left
    return df


def chauvenet(n: Column) -> Column:
    """Normal quantile of 1 - 1 / (4 n), by a rational approximation of it."""
    t = F.sqrt(-2 * F.log(1 / (4 * n)))
    return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)


def fit_to_half(df: DataFrame, value: str, keys: list[str], centre: str = "mean", lower: bool = True) -> DataFrame:
    """Statistics of the half on one side of a centre, mirrored about it: npts, mean (the centre), variance."""
    c = {"mean": F.avg(value), "median": F.median(value), "zero": F.lit(0.0)}[centre]
    m = df.groupBy(*keys).agg(c.alias("_c"))
    side = F.col(value) <= F.col("_c") if lower else F.col(value) >= F.col("_c")
    d2 = F.sum(F.pow(F.col(value) - F.col("_c"), 2))
    half = df.join(m, keys).where(side)
    return half.groupBy(*keys).agg((2 * F.count("*")).alias("npts"), F.first("_c").alias("mean"), (2 * d2 / (2 * F.count("*") - 1)).alias("variance"))


def biweight(df: DataFrame, value: str, keys: list[str], c: float = 6.0, rounds: int = 1) -> DataFrame:
    """Tukey's biweight location with tuning constant c, `rounds` steps from the median; the scale stays the median deviation."""
    at = deviation_median(df, value, keys).select(*keys, F.col("median").alias("_at"), F.col("medabsdevmed").alias("_scale"))
    for _ in range(rounds):
        u = (F.col(value) - F.col("_at")) / (c * F.col("_scale"))
        w = F.when(F.abs(u) < 1, F.pow(1 - u * u, 2)).otherwise(0.0)
        j = df.join(at, keys)
        step = j.groupBy(*keys).agg(F.count("*").alias("npts"), F.coalesce(F.sum(w * F.col(value)) / F.sum(w), F.first("_at")).alias("location"), F.first("_scale").alias("_scale"))
        at = step.select(*keys, F.col("location").alias("_at"), "_scale")
    return step.drop("_scale")


def histogram(df: DataFrame, value: str, keys: list[str], bins: int, lo: float, hi: float, cumulative: bool = False, log10: bool = False) -> DataFrame:
    """Counts in equal bins of [lo, hi], the last closed; centre of each bin."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    h = df.where(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("counts"))
    if cumulative:
        h = h.withColumn("counts", F.sum("counts").over(Window.partitionBy(*keys).orderBy("bin")))
    if log10:
        h = h.withColumn("counts", F.log10("counts"))
    return h.withColumn("centre", lo + (F.col("bin") + 0.5) * width)


AGGREGATES = ("max", "mean", "median", "min", "npts", "rms", "stddev", "sum", "variance", "zero", "flux", "sqrtsum", "sqrtsum_npix", "sqrtsum_npix_beam", "madm", "xmadm")


def collapse(df: DataFrame, how: str, value: str, keys: list[str], beam_pixels: float = 1.0) -> DataFrame:
    """One aggregate over all axes but the keys; the name may be cut short where one name starts so."""
    how = min_match(how, AGGREGATES)
    v = F.col(value)
    if how in ("madm", "xmadm"):
        out = deviation_median(df, value, keys)
        return out.select(*keys, (F.col("medabsdevmed") * (XMADM if how == "xmadm" else 1.0)).alias("value"))
    agg = {
        "max": F.max(v), "mean": F.avg(v), "median": F.median(v), "min": F.min(v), "npts": F.count(v).cast("double"), "rms": F.sqrt(F.avg(v * v)),
        "stddev": F.stddev_samp(v), "sum": F.sum(v), "variance": F.var_samp(v), "zero": F.lit(0.0), "flux": F.sum(v) / beam_pixels, "sqrtsum": F.sqrt(F.sum(v)),
        "sqrtsum_npix": F.sqrt(F.sum(v)) / F.count(v), "sqrtsum_npix_beam": F.sqrt(F.sum(v)) / (F.count(v) / beam_pixels),
    }[how]
    return df.groupBy(*keys).agg(agg.alias("value"))


def moments(df: DataFrame, value: str, coordinate: str, keys: list[str], which: list[int], low: float | None = None, high: float | None = None) -> DataFrame:
    """Moments of a profile: -1 mean, 0 integral (times the step of 1), 1 weighted coordinate, 2 its dispersion, 3 median value,
    4 median coordinate, 5 standard deviation about the mean, 6 root mean square, 7 mean absolute deviation, 8 maximum, 9 its coordinate, 10 minimum, 11 its coordinate. Values outside [low, high] are left out."""
    i, x = F.col(value), F.col(coordinate)
    if low is not None:
        df = df.where(i >= low)
    if high is not None:
        df = df.where(i <= high)
    m1 = F.sum(i * x) / F.sum(i)
    if 4 in which:
        d4 = median_coordinate(df, value, coordinate, keys)
    known = {
        -1: F.avg(i), 0: F.sum(i), 1: m1, 2: F.sqrt(F.abs(F.sum(i * x * x) / F.sum(i) - m1 * m1)), 3: F.median(i), 5: F.stddev_samp(i), 6: F.sqrt(F.avg(i * i)),
        8: F.max(i), 9: F.max_by(x, F.struct(i, -x)), 10: F.min(i), 11: F.min_by(x, F.struct(i, x)),
    }
    out = df.groupBy(*keys).agg(*(known[k].alias(f"moment_{'m' if k < 0 else ''}{abs(k)}") for k in which if k in known))
    if 7 in which:
        mean = df.groupBy(*keys).agg(F.avg(i).alias("_m"))
        out = out.join(df.join(mean, keys).groupBy(*keys).agg(F.avg(F.abs(i - F.col("_m"))).alias("moment_7")), keys)
    return out.join(d4, keys, "left") if 4 in which else out


def median_coordinate(df: DataFrame, value: str, coordinate: str, keys: list[str]) -> DataFrame:
    """Moment 4: the coordinate at which half of the profile's positive sum is reached, linear between two."""
    w = Window.partitionBy(*keys).orderBy(coordinate)  # a profile
    good = df.where(F.col(value) > 0)
    run = good.withColumn("_run", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.withColumn("_half", F.sum(value).over(Window.partitionBy(*keys)) / 2).withColumn("_x0", F.lag(coordinate).over(w)).withColumn("_r0", F.lag("_run").over(w))
    first = run.where((F.col("_run") >= F.col("_half")) & (F.col("_r0").isNull() | (F.col("_r0") < F.col("_half"))))
    x = F.col(coordinate)
    at = F.when(F.col("_r0").isNull(), x.cast("double")).otherwise(F.col("_x0") + (x - F.col("_x0")) * (F.col("_half") - F.col("_r0")) / (F.col("_run") - F.col("_r0")))
    return first.select(*keys, at.alias("moment_4"))


def positions(df: DataFrame, value: str, axes: list[str], keys: list[str]) -> DataFrame:
    """Extremes with their pixels; of equal ones the first in axis order."""
    at = F.struct(*axes)
    back = F.struct(*(-F.col(a) for a in axes))
    lo, hi = F.min_by(at, F.struct(F.col(value), at)), F.max_by(at, F.struct(F.col(value), back))
    out = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), lo.alias("_lo"), hi.alias("_hi"))
    return out.select(*keys, "min", "max", *(F.col(f"_lo.{a}").alias(f"min_{a}") for a in axes), *(F.col(f"_hi.{a}").alias(f"max_{a}") for a in axes))


def flag_summary(df: DataFrame, flag: str, sets: list[list[str]]) -> DataFrame:
    """Flagged and total counts for each of several groupings in one pass; axes that a grouping lacks are null."""
    axes = list(dict.fromkeys(a for s in sets for a in s))
    return df.groupingSets([[F.col(a) for a in s] for s in sets], *axes).agg(F.sum(F.col(flag).cast("long")).alias("flagged"), F.count("*").alias("total"))


def flux_profile(df: DataFrame, value: str, chan: str, coordinate: Column) -> DataFrame:
    """Per channel npts, flux, mean, median, and the step to the next coordinate (the last one repeated)."""
    p = df.groupBy(chan).agg(F.count(value).alias("npts"), F.sum(value).alias("flux"), F.avg(value).alias("mean"), F.median(value).alias("median")).withColumn("coord", coordinate)
    w = Window.orderBy(chan)  # one row a channel
    step = F.abs(F.lead("coord").over(w) - F.col("coord"))
    return p.withColumn("step", F.coalesce(step, F.abs(F.col("coord") - F.lag("coord").over(w))))


def expression_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def normal_quantile(p: float) -> float:
    """By bisection; for checks of the constants above."""
    lo, hi = -10.0, 10.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return lo


# --- statistics of named axes -------------------------------------------------------------------------------------
#: what an axis of a set is, in columns of a table of visibilities (re, im, u, v, ...)
TRANSFORMS = {
    "amp": lambda: F.hypot("re", "im"), "amplitude": lambda: F.hypot("re", "im"), "phase": lambda: F.atan2("im", "re"), "real": lambda: F.col("re"), "imag": lambda: F.col("im"),
    "imaginary": lambda: F.col("im"), "uvrange": lambda: F.hypot("u", "v"),
}


def transform(axis: str) -> Column:
    """The values of an axis: an amplitude, phase, real or imaginary part, uv distance, or any column, flags as 0 and 1."""
    known = TRANSFORMS.get(axis.lower())
    return known() if known else F.col(axis).cast("double")


def visibility_statistics(
    df: DataFrame, axis: str, keys: list[str] | None = None, use_flags: bool = True, flag: str = "flag", average: list[str] | None = None, time_col: str = "time", bin_width: float | None = None,
    max_uv: float | None = None, quantiles: bool = True, few: bool = False,
) -> DataFrame:
    """Statistics of an axis per group, with the median deviation. average: complex means are taken first over the rows
    that agree in these columns (and in the time bin, where a width is given); max_uv leaves out longer baselines; few: as
    in statistics(), for the median deviation too."""
    keys = keys or []
    if max_uv is not None:
        df = df.where(F.hypot("u", "v") <= max_uv)
    if average is not None:
        by = list(dict.fromkeys([*average, *keys]))
        if bin_width is not None:
            df = df.withColumn("_bin", F.floor(F.col(time_col) / bin_width))
            by.append("_bin")
        good = df.where(~F.col(flag)) if use_flags else df
        df = good.groupBy(*by).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
        use_flags = False
    value = transform(axis)
    if quantiles and few:
        d = df.select(*keys, (F.when(~F.col(flag), value) if use_flags else value).alias("_v"))
        q = exact_quantiles(d, "_v", keys, QUARTILES)
        off = _beside(d, q.select(*keys, "median"), keys).select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_off"))
        return _beside(_beside(statistics(d, F.col("_v"), keys, quantiles=False), q, keys, "left"), exact_quantiles(off, "_off", keys, {"medabsdevmed": 0.5}), keys, "left")
    out = statistics(df, value, keys, F.col(flag) if use_flags else None, quantiles)
    if not quantiles:
        return out
    good = df.where(~F.col(flag)) if use_flags else df
    dev = deviation_median(good.select(*keys, value.alias("_v")), "_v", keys) if keys else deviation_median(good.select(F.lit(0).alias("_k"), value.alias("_v")), "_v", ["_k"]).drop("_k")
    return out.join(dev.select(*keys, "medabsdevmed"), keys, "left") if keys else out.crossJoin(F.broadcast(dev.select("medabsdevmed")))  # one row


def array_statistics(df: DataFrame, column: str, keys: list[str], flag: str | None = None) -> DataFrame:
    """Statistics of an array column: one result for each place in it."""
    both = F.arrays_zip(column, flag) if flag else F.arrays_zip(column)
    e = df.select(*keys, F.posexplode(both).alias("index", "_e"))
    return statistics(e, F.col(f"_e.{column}"), [*keys, "index"], F.col(f"_e.{flag}") if flag else None, quantiles=False)


def calibration_statistics(df: DataFrame, axis: str, keys: list[str], few: bool = False) -> DataFrame:
    """The same of a calibration table, with its names: var, and quartile for the distance of the quartiles. few: as in statistics()."""
    s = statistics(df, transform(axis), keys, few=few)
    return s.withColumnRenamed("variance", "var").withColumn("quartile", F.col("thirdquartile") - F.col("firstquartile")).drop("firstquartile", "thirdquartile")


def in_pixel_range(df: DataFrame, value: str, include: tuple[float, float] | None = None, exclude: tuple[float, float] | None = None) -> DataFrame:
    """Pixels whose value lies in one range, and in none of the other; one number x stands for [-|x|, |x|]."""
    if include is not None and exclude is not None:
        raise ValueError("one of include and exclude")
    lo, hi = include or exclude or (None, None)
    if lo is None:
        return df
    inside = F.col(value).between(lo, hi)
    return df.where(inside if include is not None else ~inside)


def image_statistics(df: DataFrame, value: str, axes: list[str], keys: list[str], include: tuple[float, float] | None = None, exclude: tuple[float, float] | None = None) -> DataFrame:
    """Statistics with the places of the extremes, over pixels in range."""
    d = in_pixel_range(df, value, include, exclude)
    s = statistics(d, F.col(value), keys)
    p = positions(d, value, axes, keys).drop("min", "max")
    return s.join(p, keys) if keys else s.crossJoin(F.broadcast(p))  # one row


def spectral_collapse(df: DataFrame, keys: list[str], coordinate: str, value: str, low: float, high: float, how: str = "mean") -> DataFrame:
    """A cube between two spectral values as one plane, with the error of a mean, its deviation over the root of channels."""
    inside = df.where(F.col(coordinate).between(min(low, high), max(low, high)))
    agg = {"mean": F.avg(value), "sum": F.sum(value), "rms": F.sqrt(F.avg(F.col(value) * F.col(value)))}[how]
    return inside.groupBy(*keys).agg(agg.alias("value"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("error"), F.count(value).alias("nchan"))


def total_flux(profile: DataFrame, flux: str = "flux", step: str = "step") -> DataFrame:
    """The sum of flux times step over a profile: one row."""
    return profile.agg(F.sum(F.col(flux) * F.col(step)).alias("total"))


def flag_change(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Per cent flagged before and after a calibration."""
    share = lambda c: 100 * F.avg(F.col(c).cast("double"))
    return df.groupBy(*keys).agg(share(before).alias("flagged_in"), share(after).alias("flagged_out"), F.sum((F.col(after) & ~F.col(before)).cast("long")).alias("newly"))


def fit_statistics(df: DataFrame, keys: list[str], x: str, value: str, err: str, flag: str, order: int = 1) -> DataFrame:
    """A weighted polynomial of order 0 or 1 through unflagged values with errors: coefficients, the residuals' mean and
    variance, and the reduced chi squared. Sums that combine, then one pass over the residuals."""
    if order not in (0, 1):
        raise ValueError("order 0 or 1")
    good = df.where(~F.col(flag) & (F.col(err) > 0)).withColumn("_w", 1 / (F.col(err) * F.col(err)))
    w, t, y = F.col("_w"), F.col(x).cast("double"), F.col(value)
    sums = good.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("_s"), F.sum(w * t).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * t * t).alias("_xx"), F.sum(w * t * y).alias("_xy")
    )
    s, sx, sy, sxx, sxy = (F.col("_" + c) for c in ("s", "x", "y", "xx", "xy"))
    slope = F.try_divide(s * sxy - sx * sy, s * sxx - sx * sx) if order else F.lit(0.0)
    fit = sums.withColumn("slope", slope).withColumn("intercept", (sy - F.col("slope") * sx) / s).select(*keys, "n", "slope", "intercept")
    r = F.col(value) - F.col("intercept") - F.col("slope") * t
    out = good.join(fit, keys).groupBy(*keys, "n", "slope", "intercept").agg(F.avg(r).alias("res_mean"), F.var_samp(r).alias("res_var"), F.sum(r * r * w).alias("_chi2"))
    return out.withColumn("redchi2", F.try_divide(F.col("_chi2"), F.col("n") - F.lit(order + 1))).drop("_chi2")
