"""Images as rows of pixels (x, y, ..., value, mask): regions, masks, re-shaping, smoothing, statistics."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def box(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    return x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))


def centre_box(x: Column, y: Column, cx: float, cy: float, w: float, h: float) -> Column:
    return box(x, y, cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def _turned(x: Column, y: Column, cx: float, cy: float, angle: float) -> tuple[Column, Column]:
    c, s = math.cos(angle), math.sin(angle)
    return (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s


def rotated_box(x: Column, y: Column, cx: float, cy: float, w: float, h: float, angle: float) -> Column:
    a, b = _turned(x, y, cx, cy, angle)
    return (F.abs(a) <= w / 2) & (F.abs(b) <= h / 2)


def circle(x: Column, y: Column, cx: float, cy: float, r: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def annulus(x: Column, y: Column, cx: float, cy: float, inner: float, outer: float) -> Column:
    d = (x - cx) * (x - cx) + (y - cy) * (y - cy)
    return (d >= inner * inner) & (d <= outer * outer)


def ellipse(x: Column, y: Column, cx: float, cy: float, a: float, b: float, angle: float = 0.0) -> Column:
    p, q = _turned(x, y, cx, cy, angle)
    return (p / a) * (p / a) + (q / b) * (q / b) <= 1


def polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """By the parity of edges to the right; a pixel on a left or lower edge is inside."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossed = crossed + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


def polyline(x: Column, y: Column, points: list[tuple[float, float]], width: float) -> Column:
    """Within half a width of a run of segments."""
    tests = []
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2 or 1e-30
        t = F.least(F.greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d2, F.lit(0.0)), F.lit(1.0))
        tests.append(F.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1))) <= width / 2)
    return reduce(lambda a, b: a | b, tests)


def parse_regions(text: str, x: Column, y: Column) -> Column:
    """Region lines in order: `shape [numbers]`, a leading - takes away; # begins a comment. Pixels; angles in degrees.
    Lines may be followed by a width: `line [[0, 0], [9, 9]], linewidth=3`."""
    found = F.lit(False)
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        sign, line = ("-", line[1:]) if line[0] == "-" else ("+", line.lstrip("+"))
        m = re.fullmatch(r"\s*(\w+)\s*\[(.*?)\]\s*(?:,\s*linewidth\s*=\s*([\d.]+))?\s*", line)
        if not m:
            raise ValueError(f"not a region: {line!r}")
        n = [float(v) for v in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", m[2])]
        pairs, width = list(zip(n[::2], n[1::2])), float(m[3] or 1)
        shape = m[1].lower()
        test = {
            "box": lambda: box(x, y, *n), "centerbox": lambda: centre_box(x, y, *n), "rotbox": lambda: rotated_box(x, y, *n[:4], math.radians(n[4])), "circle": lambda: circle(x, y, *n),
            "annulus": lambda: annulus(x, y, *n), "ellipse": lambda: ellipse(x, y, *n[:4], math.radians(n[4]) if len(n) > 4 else 0.0), "poly": lambda: polygon(x, y, pairs),
            "polyline": lambda: polyline(x, y, pairs, width), "line": lambda: polyline(x, y, pairs, width), "vector": lambda: polyline(x, y, pairs, width),
        }
        if shape in ("symbol", "text"):  # annotations select nothing
            continue
        if shape not in test:
            raise ValueError(f"unknown shape {shape!r}")
        found = found | test[shape]() if sign == "+" else found & ~test[shape]()
    return found


def crop(df: DataFrame, axes: list[str], mask: str) -> DataFrame:
    """Without the fully masked edges."""
    good = df.where(F.col(mask)).agg(*(f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))))
    j = df.crossJoin(F.broadcast(good))  # one row
    return j.where(reduce(lambda p, q: p & q, (F.col(a).between(F.col(f"_lo{a}"), F.col(f"_hi{a}")) for a in axes))).select(*df.columns)


def subimage(df: DataFrame, axes: list[str], region: Column, mask: DataFrame | None = None, stretch: bool = False, drop_degenerate: bool = False, keep_axes: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of a region, counted from its lower corner.

    mask: (axes, good) of another image; with stretch it may lack axes, and holds for all their pixels. drop_degenerate:
    axes of one pixel go, but for keep_axes; a job finds their lengths.
    """
    d = df.where(region)
    if mask is not None:
        on = [a for a in axes if a in mask.columns]
        if len(on) < len(axes) and not stretch:
            raise ValueError("the mask lacks axes of the image")
        d = d.join(mask.where("good").select(*on), on, "left_semi")
    low = d.agg(*(F.min(a).alias(f"_{a}") for a in axes))
    j = d.crossJoin(F.broadcast(low))  # one row
    out = j.select(*((F.col(a) - F.col(f"_{a}")).alias(a) if a in axes else F.col(a) for a in df.columns))
    if drop_degenerate:
        top = d.agg(*((F.max(a) - F.min(a)).alias(a) for a in axes)).first()
        out = out.drop(*(a for a in axes if top[a] == 0 and a not in keep_axes))
    return out


def transpose(df: DataFrame, axes: list[str], order: str, shape: dict[str, int]) -> DataFrame:
    """Axis i of the result is axis order[i]; a minus sign before the order reverses the first, before a digit that axis."""
    digits = re.findall(r"-?\d", order)
    if sorted(int(d.lstrip("-")) for d in digits) != list(range(len(axes))):
        raise ValueError(f"{order!r} does not order {len(axes)} axes")
    out = []
    for to, d in zip(axes, digits):
        source = axes[int(d.lstrip("-"))]
        out.append((shape[source] - 1 - F.col(source) if d[0] == "-" else F.col(source)).alias(to))
    return df.select(*out, *(c for c in df.columns if c not in axes))


def rebin(df: DataFrame, factors: dict[str, int], shape: dict[str, int], keys: list[str], value: str, mask: str | None = None, crop_edges: bool = True) -> DataFrame:
    """Means of good pixels over blocks; with crop_edges incomplete blocks are left out, else kept."""
    if all(f == 1 for f in factors.values()):
        raise ValueError("some factor is above one")
    if factors.get("stokes", 1) != 1:
        raise ValueError("polarizations are not binned")
    d = df
    if crop_edges:
        d = d.where(reduce(lambda p, q: p & q, (F.col(a) < shape[a] // f * f for a, f in factors.items())))
    v = F.when(F.col(mask), F.col(value)) if mask else F.col(value)
    return d.groupBy(*keys, *(F.floor(F.col(a) / f).cast("int").alias(a) for a, f in factors.items())).agg(F.avg(v).alias(value), F.count(v).alias("npix"))


def concat(images: list[DataFrame], axis: str, lengths: list[int]) -> DataFrame:
    at, out = 0, []
    for df, n in zip(images, lengths):
        out.append(df.withColumn(axis, F.col(axis) + at))
        at += n
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def pad(df: DataFrame, width: int) -> DataFrame:
    """Shifts x and y by a margin; the margin itself is empty in a sparse image."""
    return df.withColumn("x", F.col("x") + width).withColumn("y", F.col("y") + width)


def replace_masked(value: Column, mask: Column, by: Column) -> Column:
    return F.when(mask, value).otherwise(by)


def smooth(df: DataFrame, kernel: dict[tuple[int, int], float], keys: list[str], value: str = "value") -> DataFrame:
    """Convolution by scattering: each pixel gives kernel shares to its neighbours, which are summed where they meet.

    The kernel is a literal, so the only shuffle is the final sum, combined before it.
    """
    shares = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(k)).alias("k")) for (i, j), k in kernel.items()))
    e = df.select(*keys, "x", "y", F.col(value).alias("_v"), F.explode(shares).alias("_k"))
    e = e.select(*keys, (F.col("x") + F.col("_k.i")).alias("x"), (F.col("y") + F.col("_k.j")).alias("y"), (F.col("_v") * F.col("_k.k")).alias("_v"))
    return e.groupBy(*keys, "x", "y").agg(F.sum("_v").alias(value))


def gaussian_kernel(fwhm: float, reach: int) -> dict[tuple[int, int], float]:
    k = {(i, j): math.exp(-4 * math.log(2) * (i * i + j * j) / fwhm**2) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}
    total = sum(k.values())
    return {p: v / total for p, v in k.items()}


def statistic_image(df: DataFrame, step: int, half: int, keys: list[str], value: Column) -> DataFrame:
    """A statistic in boxes about grid points: a pixel is sent to the few grid points whose boxes hold it."""
    at = lambda c: F.sequence(F.ceil((F.col(c) - half) / step).cast("int"), F.floor((F.col(c) + half) / step).cast("int"))
    ok = lambda c: F.ceil((F.col(c) - half) / step) <= F.floor((F.col(c) + half) / step)
    e = df.where(ok("x") & ok("y")).withColumn("gx", F.explode(at("x"))).withColumn("gy", F.explode(at("y"))).where("gx >= 0 and gy >= 0")
    return e.groupBy(*keys, (F.col("gx") * step).alias("x"), (F.col("gy") * step).alias("y")).agg(value.alias("statistic"), F.count("*").alias("npts"))


def sources(df: DataFrame, keys: list[str], cutoff: float, most: int) -> DataFrame:
    """The brightest local maxima of 3 by 3 pixels above a cutoff, of an image of one row a pixel.

    A pixel's value and its neighbours' come from one reading: sums computed twice may differ in their last bits, and a
    maximum would not be the maximum of its own neighbourhood.
    """
    spread = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    e = df.select(*keys, "x", "y", "value", F.explode(spread).alias("o"))
    own = F.when((F.col("o.i") == 0) & (F.col("o.j") == 0), F.col("value"))
    top = e.groupBy(*keys, (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).agg(F.max(own).alias("own"), F.max("value").alias("near"))
    found = top.where((F.col("own") >= F.col("near")) & (F.col("own") > cutoff)).select(*keys, "x", "y", F.col("own").alias("value"))
    return found.orderBy(F.desc("value"), *keys, "x", "y").limit(most)


def pv_slice(df: DataFrame, start: tuple[float, float], end: tuple[float, float], width: float, chan: str, value: str) -> DataFrame:
    """Mean value per step along a straight cut of a given width, and channel."""
    length = math.hypot(end[0] - start[0], end[1] - start[1])
    ux, uy = (end[0] - start[0]) / length, (end[1] - start[1]) / length
    along = (F.col("x") - start[0]) * ux + (F.col("y") - start[1]) * uy
    across = (F.col("y") - start[1]) * ux - (F.col("x") - start[0]) * uy
    d = df.where((F.abs(across) <= width / 2) & (along >= 0) & (along <= length))
    return d.groupBy(F.floor(along).cast("int").alias("offset"), chan).agg(F.avg(value).alias("value"), F.count("*").alias("npts"))


def two_point(df: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """Autocorrelation at lags 0 to reach along x and y: each pixel meets those at a lag by an equi-join."""
    lags = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(reach + 1) for j in range(reach + 1)))
    a = df.select(*keys, "x", "y", F.col(value).alias("_a"), F.explode(lags).alias("lag"))
    a = a.select(*keys, (F.col("x") + F.col("lag.i")).alias("x"), (F.col("y") + F.col("lag.j")).alias("y"), "_a", F.col("lag.i").alias("lx"), F.col("lag.j").alias("ly"))
    return a.join(df.select(*keys, "x", "y", F.col(value).alias("_b")), [*keys, "x", "y"]).groupBy(*keys, "lx", "ly").agg(F.avg(F.col("_a") * F.col("_b")).alias("corr"), F.count("*").alias("npairs"))


def mosaic(images: list[DataFrame], keys: list[str]) -> DataFrame:
    """Weighted mean of overlapping images (columns value, weight)."""
    u = reduce(lambda a, b: a.unionByName(b), images)
    return u.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))


def primary_beam_correct(image: DataFrame, beam: DataFrame, keys: list[str], cutoff: float, mode: str = "divide") -> DataFrame:
    b = beam.select(*keys, F.col("value").alias("_b"))
    v = F.col("value") / F.col("_b") if mode == "divide" else F.col("value") * F.col("_b")
    return image.join(b, keys).withColumn("value", F.when(F.col("_b") >= cutoff, v)).drop("_b")


def peak_fit(df: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """Peak of a profile with a parabola through it and its neighbours."""
    w = Window.partitionBy(*keys).orderBy(axis)
    d = df.withColumn("_a", F.lag(value).over(w)).withColumn("_c", F.lead(value).over(w))
    p = d.groupBy(*keys).agg(F.max_by(F.struct(axis, value, "_a", "_c"), F.struct(F.col(value), -F.col(axis))).alias("p"))
    a, b, c = F.col("p._a"), F.col(f"p.{value}"), F.col("p._c")
    s = F.when(a.isNull() | c.isNull() | (a - 2 * b + c == 0), 0.0).otherwise(0.5 * (a - c) / (a - 2 * b + c))
    return p.select(*keys, (F.col(f"p.{axis}") + s).alias("position"), F.coalesce(b - 0.25 * (a - c) * s, b).alias("peak"))


# --- composed regions, expressions, masks -------------------------------------------------------------------------
def compose(axes: dict[str, int], box_spec: str = "", chans: str = "", stokes_spec: str = "", region: str = "", control: str = "all") -> Column:
    """One predicate of a box list `x1,y1,x2,y2,...`, channels, polarizations and region lines; what is blank selects all.

    axes: the number of pixels of each axis that the image has (x, y, chan, stokes); with control `first` a blank
    polarization is the first one.
    """
    tests = [F.lit(True)]
    if box_spec.strip():
        n = [float(v) for v in re.split(r"[,\s]+", box_spec.strip())]
        if len(n) % 4:
            raise ValueError(f"not boxes: {box_spec!r}")
        tests.append(reduce(lambda a, b: a | b, (box(F.col("x"), F.col("y"), *n[i : i + 4]) for i in range(0, len(n), 4))))
    if chans.strip():
        from .select import channels

        tests.append(channels("chan", chans, axes["chan"]))
    if stokes_spec.strip():
        from .select import parse_stokes

        tests.append(F.col("stokes").isin(parse_stokes(stokes_spec)))
    elif control == "first" and "stokes" in axes:
        tests.append(F.col("stokes") == F.lit("I"))
    if region.strip():
        tests.append(parse_regions(region, F.col("x"), F.col("y")))
    return reduce(lambda a, b: a & b, tests)


def calc(images: dict[str, DataFrame], keys: list[str], expression: str, value: str = "value") -> DataFrame:
    """An expression of images by their names, pixel by pixel; a pixel that one of them lacks is left out."""
    found = [df.select(*keys, F.col(value).alias(name)) for name, df in images.items()]
    j = reduce(lambda a, b: a.join(b, keys), found)
    return j.select(*keys, F.expr(expression).alias(value))


def with_mask(df: DataFrame, test: str, name: str = "mask") -> DataFrame:
    """A mask by an expression of the pixel's columns; pixels for which it is unknown are bad."""
    return df.withColumn(name, F.coalesce(F.expr(test), F.lit(False)))


def mask_image(df: DataFrame, mask: str = "mask") -> DataFrame:
    """A mask as an image of ones and zeros."""
    return df.withColumn("value", F.col(mask).cast("double"))


# --- geometry -----------------------------------------------------------------------------------------------------
def _bilinear(df: DataFrame, keys: list[str], x: Column, y: Column, value: str) -> DataFrame:
    """Values at fractional places (x, y) of pixels of integer grids gx, gy: each place asks four pixels by an equi-join."""
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    d = df.withColumn("_x", x).withColumn("_y", y)
    e = d.withColumn("_fx", F.floor("_x").cast("int")).withColumn("_fy", F.floor("_y").cast("int")).withColumn("_c", F.explode(corners))
    wx = F.when(F.col("_c.i") == 1, F.col("_x") - F.col("_fx")).otherwise(1 - (F.col("_x") - F.col("_fx")))
    wy = F.when(F.col("_c.j") == 1, F.col("_y") - F.col("_fy")).otherwise(1 - (F.col("_y") - F.col("_fy")))
    return e.select(*keys, "x", "y", (F.col("_fx") + F.col("_c.i")).alias("sx"), (F.col("_fy") + F.col("_c.j")).alias("sy"), (wx * wy).alias("w"))


def resample(df: DataFrame, keys: list[str], targets: DataFrame, x: Column, y: Column, value: str = "value") -> DataFrame:
    """Bilinear values of an image at the places (x, y) that a new image's pixels (keys, x, y) have in it. Pixels that need
    one that is not there are left out."""
    asked = _bilinear(targets, keys, x, y, value).where("w > 0")
    src = df.select(*keys, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(value).alias("_v"))
    got = asked.join(src, [*keys, "sx", "sy"]).groupBy(*keys, "x", "y").agg(F.sum(F.col("w") * F.col("_v")).alias(value), F.sum("w").alias("_w"))
    return got.where("_w > 0.999999").drop("_w")


def rotate(df: DataFrame, keys: list[str], angle: float, cx: float, cy: float, value: str = "value") -> DataFrame:
    """Turned about a centre by an angle (radians, x towards y), on the same pixels."""
    c, s = math.cos(angle), math.sin(angle)
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return resample(df, keys, df.select(*keys, "x", "y"), cx + dx * c + dy * s, cy + dy * c - dx * s, value)


def regrid(df: DataFrame, keys: list[str], nx: int, ny: int, x0: float, y0: float, step_x: float, step_y: float, value: str = "value") -> DataFrame:
    """Onto nx by ny pixels whose pixel (i, j) lies at (x0 + i step_x, y0 + j step_y) of the image."""
    spark = df.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("x"), F.floor(F.col("id") / nx).cast("int").alias("y"))
    planes = df.select(*keys).distinct()
    targets = planes.crossJoin(F.broadcast(grid)) if keys else grid  # the new image's pixels of every plane
    return resample(df, keys, targets, x0 + F.col("x") * step_x, y0 + F.col("y") * step_y, value)


def interpolated_statistic(stat: DataFrame, keys: list[str], step: int, nx: int, ny: int) -> DataFrame:
    """A statistic image of grid points (x, y multiples of the step) on all pixels between them, bilinear."""
    coarse = stat.select(*keys, (F.col("x") / step).cast("int").alias("x"), (F.col("y") / step).cast("int").alias("y"), F.col("statistic").alias("value"))
    return regrid(coarse, keys, nx, ny, 0.0, 0.0, 1 / step, 1 / step)


def embed(df: DataFrame, keys: list[str], width: int, nx: int, ny: int, by: float = 0.0, value: str = "value") -> DataFrame:
    """An image of nx by ny pixels with a margin of a value round it."""
    spark = df.sparkSession
    wide, high = nx + 2 * width, ny + 2 * width
    grid = spark.range(wide * high).select((F.col("id") % wide).cast("int").alias("x"), F.floor(F.col("id") / wide).cast("int").alias("y"))
    edge = grid.where(~(F.col("x").between(width, nx + width - 1) & F.col("y").between(width, ny + width - 1)))
    planes = df.select(*keys).distinct()
    edge = (planes.crossJoin(F.broadcast(edge)) if keys else edge).withColumn(value, F.lit(by))
    return pad(df.select(*keys, "x", "y", value), width).unionByName(edge)


def transform_planes(df: DataFrame, keys: list[str], nx: int, ny: int, value: str = "value") -> DataFrame:
    """Fourier transform of each plane, its zero frequency in the middle: (keys, x, y, re, im). A plane goes to one Arrow
    task; missing pixels count as zero."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", " if keys else "") + "x int, y int, re double, im double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((ny, nx))
        g[p["y"], p["x"]] = p[value]
        f = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(g)))
        y, x = np.mgrid[:ny, :nx]
        out = pd.DataFrame({k: [p[k].iloc[0]] * (nx * ny) for k in keys}, index=range(nx * ny))
        return out.assign(x=x.reshape(-1).astype("int32"), y=y.reshape(-1).astype("int32"), re=f.real.reshape(-1), im=f.imag.reshape(-1))

    d = df.select(*keys, "x", "y", value)
    return d.groupBy(*keys).applyInPandas(run, schema)


def common_beam(beams: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """A beam (major, minor, angle) that holds all: the largest one if every other fits into it, else a circle of its major axis."""
    from .fit import deconvolve_beam

    big = max(beams, key=lambda b: b[0] * b[1])
    if all(b == big or deconvolve_beam(*big, *b) is not None for b in beams):
        return big
    top = max(b[0] for b in beams)
    return top, top, 0.0


def beam_kernel(target: tuple[float, float, float], beam: tuple[float, float, float], reach: int) -> dict[tuple[int, int], float]:
    """The kernel that makes an image of one beam one of a larger beam; axes in pixels, angles in radians."""
    from .fit import deconvolve_beam

    got = deconvolve_beam(*target, *beam)
    if got is None:
        raise ValueError("the beam does not fit into the target")
    a, b, t = (max(got[0], 1e-6), max(got[1], 1e-6), got[2])
    c, s = math.cos(t), math.sin(t)
    k = {}
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            u, v = (j * c - i * s) / a, (i * c + j * s) / b
            k[(i, j)] = math.exp(-4 * math.log(2) * (u * u + v * v))
    total = sum(k.values())
    return {p: x / total for p, x in k.items()}
