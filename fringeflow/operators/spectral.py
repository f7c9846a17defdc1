"""Operators on spectra held as arrays: smoothing, decimation, baselines. Elements stay in their row; nothing is shuffled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hanning(v: Column) -> Column:
    """1/4, 1/2, 1/4; the ends are means of two."""
    n = F.size(v)

    def at(x: Column, i: Column) -> Column:
        before, after = F.get(v, i - 1), F.get(v, i + 1)
        return F.when(n == 1, x).when(i == 0, (x + after) / 2).when(i == n - 1, (before + x) / 2).otherwise(0.25 * before + 0.5 * x + 0.25 * after)

    return F.transform(v, at)


def hanning_flags(f: Column) -> Column:
    """A smoothed channel is bad if one that enters it is."""
    return F.transform(f, lambda x, i: x | F.coalesce(F.get(f, i - 1), F.lit(False)) | F.coalesce(F.get(f, i + 1), F.lit(False)))


def hanning_weights(w: Column) -> Column:
    """Weights of smoothed channels: one over the sum of squared shares over the weights that enter; 0 where one of them is 0."""
    n = F.size(w)

    def at(x: Column, i: Column) -> Column:
        a, c = F.get(w, i - 1), F.get(w, i + 1)
        good = (x > 0) & F.coalesce(a > 0, F.lit(True)) & F.coalesce(c > 0, F.lit(True))
        ends = F.when(i == 0, 1 / (0.25 / x + 0.25 / c)).when(i == n - 1, 1 / (0.25 / a + 0.25 / x))
        return F.when(~good, F.lit(0.0)).when(n == 1, x).otherwise(F.coalesce(ends, 1 / (0.0625 / a + 0.25 / x + 0.0625 / c)))

    return F.transform(w, at)


def smoothing_kernel(kind: str, width: float) -> list[float]:
    """gaussian: of this width at half maximum, to three deviations; boxcar: that many equal shares. They add up to one."""
    if kind == "boxcar":
        n = int(width)
        k = [1.0] * n if n % 2 else [0.5] + [1.0] * (n - 1) + [0.5]
    elif kind == "gaussian":
        sigma = width / 2.3548200450309493
        reach = max(1, math.ceil(3 * sigma))
        k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    else:
        raise ValueError(f"unknown kernel {kind!r}")
    total = sum(k)
    return [x / total for x in k]


def convolve(v: Column, kernel: list[float]) -> Column:
    """A centred kernel of odd length; what lies beyond the ends counts as the end's value."""
    half, n = len(kernel) // 2, F.size(v)

    def at(_: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for j, k in enumerate(kernel):
            total = total + k * F.get(v, F.least(F.greatest(i + (j - half), F.lit(0)), n - 1))
        return total

    return F.transform(v, at)


def boxcar(v: Column, width: int) -> Column:
    """Running mean of `width` channels; width - 1 channels shorter."""
    last = F.size(v) - width + 1
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.aggregate(F.slice(v, i + 1, width), F.lit(0.0), lambda a, x: a + x) / width)


def boxcar_decimated(v: Column, width: int, how: str = "copy") -> Column:
    """Running means thinned out to one in `width`, or means of these."""
    return decimate(boxcar(v, width), width, how)


def boxcar_reference(value: float, increment: float, width: int) -> float:
    """The first channel's coordinate after a running mean: the middle of the channels that it is the mean of."""
    return value + increment * (width - 1) / 2


def decimate(v: Column, n: int, how: str = "copy") -> Column:
    """copy: every n-th channel (length rounded up); mean: of whole groups of n (rounded down)."""
    if how == "copy":
        return F.filter(v, lambda _, i: i % n == 0)
    groups = F.floor(F.size(v) / n).cast("int")
    starts = F.when(groups > 0, F.sequence(F.lit(0), groups - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.aggregate(F.slice(v, i * n + 1, n), F.lit(0.0), lambda a, x: a + x) / n)


def hanning_decimated(v: Column, how: str = "copy") -> Column:
    """Smoothed without the first channel, and without the last where that leaves an even number, then every second one
    (copy) or means of pairs (mean)."""
    s = hanning(v)
    inner = F.slice(s, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))
    if how == "copy":
        even = F.size(v) % 2 == 0
        inner = F.when(even, F.slice(s, F.lit(2), F.greatest(F.size(v) - 2, F.lit(0)))).otherwise(inner)
        return decimate(inner, 2, "copy")
    return decimate(inner, 2, "mean")


def explode_channels(df: DataFrame, keys: list[str], spectrum: str) -> DataFrame:
    return df.select(*keys, F.posexplode(spectrum).alias("chan", "value")).withColumn("value", F.col("value").cast("double"))


def pack_channels(df: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of explode_channels."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("chan", "value"))), lambda x: x["value"]).alias("spectrum"))


def held(value: Column, use) -> Column:
    """use(value), where the value is computed once a row, however often the lambdas inside `use` read it."""
    return F.get(F.transform(F.array(value), use), 0)


def subtract_line(v: Column, line_free: Column, order: int) -> Column:
    """Spectrum minus a polynomial of order 0 or 1 through its line-free channels (a boolean array), in closed form.

    The five sums are taken in one pass over the channels. A spectrum without enough line-free channels is null.
    """
    if order not in (0, 1):
        raise ValueError("higher orders: subtract_polynomial")
    x = F.transform(v, lambda y, i: F.struct(i.cast("double").alias("i"), F.coalesce(F.get(line_free, i), F.lit(False)).alias("ok"), y.cast("double").alias("y")))
    names = ("n", "x", "y", "xx", "xy")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))

    def add(a: Column, s: Column) -> Column:
        one = {"n": F.lit(1.0), "x": s["i"], "y": s["y"], "xx": s["i"] * s["i"], "xy": s["i"] * s["y"]}
        return F.when(s["ok"], F.struct(*((a[k] + one[k]).alias(k) for k in names))).otherwise(a)

    def line(s: Column) -> Column:
        if order == 0:
            return F.struct(F.try_divide(s["y"], s["n"]).alias("at"), F.lit(0.0).alias("slope"))
        slope = F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])
        return F.struct(F.try_divide(s["y"] - slope * s["x"], s["n"]).alias("at"), slope.alias("slope"))

    fit = F.aggregate(x, zero, add, line)
    return held(fit, lambda f: F.when(f["at"].isNotNull() & f["slope"].isNotNull(), F.transform(v, lambda y, i: y.cast("double") - f["at"] - f["slope"] * i)))


def subtract_polynomial(v: Column, n: int, line_free: list[tuple[int, int]], order: int) -> Column:
    """Spectrum of n channels minus a polynomial of any order through its line-free channels (ranges, ends included).

    The channels are the same in every row, so orthogonal polynomials over them are computed here once; a row only
    projects its channels on them.
    """
    free = sorted({c for lo, hi in line_free for c in range(max(lo, 0), min(hi, n - 1) + 1)})
    if len(free) <= order:
        raise ValueError("fewer line-free channels than coefficients")
    # three-term recurrence over x scaled to [-1, 1]; rows of `basis` are values at all channels
    scale = [2.0 * c / max(n - 1, 1) - 1.0 for c in range(n)]
    basis: list[list[float]] = []
    for k in range(order + 1):
        p = [1.0] * n if k == 0 else [s * b for s, b in zip(scale, basis[-1])]
        for _ in range(2):  # twice is enough for rounding
            for b in basis:
                share = sum(p[c] * b[c] for c in free)
                p = [x - share * y for x, y in zip(p, b)]
        size = sum(p[c] * p[c] for c in free) ** 0.5
        basis.append([x / size for x in p])
    rows = F.array(*(F.array(*map(F.lit, (b[c] if c in set(free) else 0.0 for c in range(n)))) for b in basis))
    columns = F.array(*(F.array(*map(F.lit, (b[c] for b in basis))) for c in range(n)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(rows, lambda b: dot(b, v))
    return held(shares, lambda s: F.transform(v, lambda y, i: y.cast("double") - dot(s, F.get(columns, i))))


def regrid(
    df: DataFrame, keys: list[str], chan_freq: Column, start: float, step: float, count: int, spectrum: str = "spectrum", regular: bool = False
) -> DataFrame:
    """Linear interpolation onto `count` channels from `start`; null beyond the spectrum's own channels (ascending chan_freq).

    regular: the channels are equally spaced, and a channel is found by arithmetic instead of by a search of all.
    """

    def spread(f_: Column) -> Column:
        """f_: the channels' frequencies, with their spacing and number, computed once a row."""
        f0, n = f_["f"], f_["n"]

        def at(i: Column) -> Column:
            f = F.lit(start) + i * step
            if regular:
                guess = F.greatest(F.least(F.floor(F.try_divide(f - F.get(f0, F.lit(0)), f_["w"])), n.cast("long")), F.lit(-1)).cast("int")
                # rounding may put a channel's own frequency one too low or too high
                k = F.when(F.get(f0, guess + 1) <= f, guess + 1).when(F.get(f0, guess) > f, guess - 1).otherwise(F.coalesce(guess, F.lit(0)))
            else:
                k = F.size(F.filter(f0, lambda x: x <= f)) - 1
            return held(k, lambda k: between(f, k))

        def between(f: Column, k: Column) -> Column:
            a, b = F.get(f0, k), F.get(f0, k + 1)
            x, y = F.get(spectrum, k), F.get(spectrum, k + 1)
            return F.when(a == f, x.cast("double")).when(k >= 0, x + (y - x) * (f - a) / (b - a))

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)

    first, last = F.get(chan_freq, F.lit(0)), F.get(chan_freq, F.size(chan_freq) - 1)
    grid = F.struct(chan_freq.alias("f"), F.try_divide(last - first, F.size(chan_freq) - 1).alias("w"), F.size(chan_freq).alias("n"))
    return df.select(*keys, held(grid, spread).alias(spectrum))


def cvel(df: DataFrame, keys: list[str], velocity_step: float, velocity_start: float, count: int, rest: float, first: float, width: float, spectrum: str = "v") -> DataFrame:
    """Spectra of regular channels (first frequency and width) onto channels of radio velocity, ascending in velocity."""
    c = 299_792_458.0
    f0, df_ = rest * (1 - velocity_start / c), -rest * velocity_step / c
    freq = F.transform(spectrum, lambda _, i: F.lit(first) + i * width)
    if df_ > 0:
        return regrid(df, keys, freq, f0, df_, count, spectrum, regular=True)
    # descending frequencies: the same channels read from the other end
    up = regrid(df, keys, freq, f0 + df_ * (count - 1), -df_, count, spectrum, regular=True)
    return up.withColumn(spectrum, F.reverse(spectrum))


def combine_windows(df: DataFrame, keys: list[str], freq: str, value: str, weight: str, start: float, step: float, count: int) -> DataFrame:
    """Several spectral windows as one: samples (a row a channel) go to the nearest channel of the new grid, weighted."""
    chan = F.round((F.col(freq) - start) / step).cast("int")
    d = df.withColumn("chan", chan).where((F.col("chan") >= 0) & (F.col("chan") < count))
    return d.groupBy(*keys, "chan").agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"), F.sum(weight).alias("weight"))


def scaled_between(v: Column, factors: list[tuple[float, float]]) -> Column:
    """Spectra times a factor known at some channels (an atmosphere's transmission, say), linear between these and held beyond."""
    nodes = sorted(factors)

    def at(x: Column, i: Column) -> Column:
        f = F.lit(float(nodes[0][1]))
        for (a, p), (b, q) in zip(nodes, nodes[1:]):
            f = F.when(i > a, F.when(i >= b, F.lit(float(q))).otherwise(p + (q - p) * (i - a) / (b - a))).otherwise(f)
        return x * f

    return F.transform(v, at)
