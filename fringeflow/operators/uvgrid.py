"""uv-plane binning, imaging weights, gridding, direct and fast transforms, minor cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def grid(df: DataFrame, u: Column, v: Column, size: float, keys: list[str], re: Column, im: Column, weight: Column) -> DataFrame:
    """Weighted sums per cell and key; combined before the shuffle, so a hot cell is no hot task."""
    return df.groupBy(cell(u, size).alias("iu"), cell(v, size).alias("iv"), *keys).agg(
        (F.sum(re * weight) / F.sum(weight)).alias("re"), (F.sum(im * weight) / F.sum(weight)).alias("im"), F.sum(weight).alias("weight"), F.count("*").alias("n")
    )


def imaging_weights(df: DataFrame, u: str, v: str, weight: str, size: float, mode: str = "briggs", robust: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """natural: the weight; radial: times the uv distance; uniform: over the cell's density; briggs between the two.

    The density table has a row a cell and meets the rows again by an equi-join on the cell.
    """
    keys = keys or []
    w = F.col(weight)
    if mode == "natural":
        return df.withColumn("imaging_weight", w)
    if mode == "radial":
        return df.withColumn("imaging_weight", w * F.hypot(F.col(u), F.col(v)))
    d = df.withColumn("_iu", cell(F.col(u), size)).withColumn("_iv", cell(F.col(v), size))
    density = d.groupBy(*keys, "_iu", "_iv").agg(F.sum(w).alias("_d"))
    if mode == "uniform":
        return d.join(density, [*keys, "_iu", "_iv"]).withColumn("imaging_weight", w / F.col("_d")).drop("_iu", "_iv", "_d")
    mean = density.agg((F.sum(F.col("_d") * F.col("_d")) / F.sum("_d")).alias("_m"))  # one row
    f2 = (5 * 10 ** (-robust)) ** 2 / F.col("_m")
    j = d.join(density, [*keys, "_iu", "_iv"]).crossJoin(F.broadcast(mean))
    return j.withColumn("imaging_weight", w / (1 + F.col("_d") * f2)).drop("_iu", "_iv", "_d", "_m")


def dirty_image(cells: DataFrame, n: int):
    """FFT of a grid of at most n by n cells: the grid's size, not the data's, bounds what the driver holds."""
    import numpy as np

    inside = cells.where((F.abs("iu") < n // 2) & (F.abs("iv") < n // 2))
    z = F.col("weight")
    t = inside.groupBy("iu", "iv").agg(F.sum(F.col("re") * z).alias("re"), F.sum(F.col("im") * z).alias("im")).toArrow()  # a row a cell
    iu, iv = (t[c].to_numpy() for c in ("iu", "iv"))
    v = t["re"].to_numpy() + 1j * t["im"].to_numpy()
    g = np.zeros((n, n), complex)
    np.add.at(g, (iu % n, iv % n), v)
    np.add.at(g, (-iu % n, -iv % n), v.conj())
    return np.fft.fftshift(np.fft.fft2(g).real) / max(1.0, abs(g).sum())


def hogbom(dirty, beam, gain: float = 0.1, rounds: int = 100, threshold: float = 0.0):
    """Components and residual of one plane: the peak's share of the beam is taken away again and again."""
    import numpy as np

    res, out = dirty.copy(), []
    cy, cx = np.unravel_index(np.argmax(beam), beam.shape)
    for _ in range(rounds):
        y, x = np.unravel_index(np.argmax(np.abs(res)), res.shape)
        peak = res[y, x]
        if abs(peak) <= threshold:
            break
        out.append((int(y), int(x), float(gain * peak)))
        res -= gain * peak * np.roll(np.roll(beam, y - cy, 0), x - cx, 1)
    return out, res


def apparent_sensitivity(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((1 / F.sqrt(F.sum(weight))).alias("sensitivity"))


# --- convolutional gridding ---------------------------------------------------------------------------------------
def spheroidal(eta: float) -> float:
    """A tapering function of [-1, 1], close to the prolate spheroidal one of support 6 and order 1 (a Kaiser-Bessel window)."""
    if abs(eta) >= 1:
        return 0.0
    beta, x = 2.34 * 3, 1 - eta * eta

    def bessel(z: float) -> float:
        total = term = 1.0
        for k in range(1, 40):
            term *= (z / 2) ** 2 / k**2
            total += term
        return total

    return bessel(beta * x**0.5) / bessel(beta)


def kernel(kind: str, support: int, oversample: int = 100) -> list[float]:
    """Values of a gridding function at distances 0, 1/oversample, ... up to the support (cells): box, triangle, gaussian or spheroidal."""
    import math

    out = []
    for i in range(support * oversample + 1):
        d = i / oversample
        out.append(
            {"box": 1.0 if d <= 0.5 else 0.0, "triangle": max(0.0, 1 - d), "gaussian": math.exp(-d * d), "spheroidal": spheroidal(d / support)}[kind]
        )
    return out


def w_term(l_: Column, m: Column, w: Column) -> tuple[Column, Column]:
    """The phase factor of non-coplanar baselines at a direction: exp(-2 pi i w (sqrt(1 - l^2 - m^2) - 1))."""
    import math

    phase = -2 * math.pi * w * (F.sqrt(1 - l_ * l_ - m * m) - 1)
    return F.cos(phase), F.sin(phase)


def _touched(df: DataFrame, u: Column, v: Column, size: float, kind: str, support: int, oversample: int) -> DataFrame:
    """A row a sample and cell within the support, with the kernel's value `_k`. The kernel is a literal table."""
    table = F.array(*map(F.lit, kernel(kind, support, oversample)))
    reach = F.array(*(F.lit(i) for i in range(-support, support + 1)))
    d = df.withColumn("_u", u / size).withColumn("_v", v / size)
    d = d.withColumn("_cu", F.round("_u").cast("long")).withColumn("_cv", F.round("_v").cast("long"))
    d = d.withColumn("_i", F.explode(reach)).withColumn("_j", F.explode(reach))
    d = d.withColumn("iu", F.col("_cu") + F.col("_i")).withColumn("iv", F.col("_cv") + F.col("_j"))
    value = lambda x: F.coalesce(F.get(table, F.round(F.abs(x) * oversample).cast("int")), F.lit(0.0))
    d = d.withColumn("_k", value(F.col("iu") - F.col("_u")) * value(F.col("iv") - F.col("_v")))
    return d.where("_k <> 0").drop("_u", "_v", "_cu", "_cv", "_i", "_j")


def grid_convolved(df: DataFrame, u: Column, v: Column, size: float, keys: list[str], re: Column, im: Column, weight: Column, kind: str = "spheroidal", support: int = 3, oversample: int = 100) -> DataFrame:
    """Weighted sums of samples spread over the cells within the kernel's support; combined before the one shuffle."""
    d = _touched(df.withColumn("_a", re).withColumn("_b", im).withColumn("_w", weight), u, v, size, kind, support, oversample)
    k = F.col("_k") * F.col("_w")
    return d.groupBy("iu", "iv", *keys).agg(F.sum(k * F.col("_a")).alias("re"), F.sum(k * F.col("_b")).alias("im"), F.sum(k).alias("weight"))


def degrid(df: DataFrame, row_id: str, u: Column, v: Column, size: float, grid: DataFrame, kind: str = "spheroidal", support: int = 3, oversample: int = 100) -> DataFrame:
    """Values of a grid (iu, iv, re, im) at the samples' places: kernel-weighted means of the cells that are there."""
    d = _touched(df.select(row_id, u.alias("_uu"), v.alias("_vv")), F.col("_uu"), F.col("_vv"), size, kind, support, oversample)
    j = d.join(grid.select("iu", "iv", F.col("re").alias("_a"), F.col("im").alias("_b")), ["iu", "iv"])
    return j.groupBy(row_id).agg((F.sum(F.col("_k") * F.col("_a")) / F.sum("_k")).alias("re"), (F.sum(F.col("_k") * F.col("_b")) / F.sum("_k")).alias("im"))


def filtered_weights(weight: Column, u: Column, v: Column, major: float, minor: float, pa: float) -> Column:
    """A Gaussian taper of imaging weights in the uv plane: half of them are left at `major` and `minor` along its axes."""
    import math

    c, s = math.cos(pa), math.sin(pa)
    a, b = (v * c + u * s) / major, (u * c - v * s) / minor
    return weight * F.exp(-math.log(2) * (a * a + b * b))


def direct_image(df: DataFrame, keys: list[str], n: int, cell_size: float) -> DataFrame:
    """The dirty image by the direct sum: each plane's n by n pixels (l, m at multiples of the cell from the middle) meet its
    samples (u, v, re, im, weight). For few samples or pixels; the sum combines before the shuffle."""
    import math

    at = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    d = df.withColumn("x", at()).withColumn("y", at())
    phase = 2 * math.pi * (F.col("u") * (F.col("x") - n // 2) * cell_size + F.col("v") * (F.col("y") - n // 2) * cell_size)
    value = F.sum(F.col("weight") * (F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase))) / F.sum("weight")
    return d.groupBy(*keys, "x", "y").agg(value.alias("value"))


# --- minor cycles -------------------------------------------------------------------------------------------------
def clark(dirty, beam, gain: float = 0.1, rounds: int = 100, threshold: float = 0.0, patch: int = 5, depth: float = 0.3):
    """Components by minor cycles on a patch of the beam and on the brightest pixels only, after each of which the whole beam
    is taken away by a Fourier product."""
    import numpy as np

    cy, cx = np.unravel_index(np.argmax(beam), beam.shape)
    centred = np.roll(beam, (-cy, -cx), (0, 1))
    transfer = np.fft.fft2(centred)
    model = np.zeros_like(dirty)
    res, left = dirty.copy(), rounds
    while left > 0 and np.abs(res).max() > threshold:
        top = np.abs(res).max()
        some, work = np.abs(res) >= depth * top, res.copy()
        found = np.zeros_like(dirty)
        while left > 0:
            y, x = np.unravel_index(np.argmax(np.where(some, np.abs(work), -1)), work.shape)
            peak = work[y, x]
            if abs(peak) <= max(threshold, depth * top):
                break
            found[y, x] += gain * peak
            for dy in range(-patch, patch + 1):
                for dx in range(-patch, patch + 1):
                    work[(y + dy) % work.shape[0], (x + dx) % work.shape[1]] -= gain * peak * centred[dy, dx]
            left -= 1
        if not found.any():
            break
        model += found
        res = res - np.fft.ifft2(np.fft.fft2(found) * transfer).real
    return model, res


def multiscale(dirty, beam, scales: list[float], gain: float = 0.2, rounds: int = 100, threshold: float = 0.0, small_bias: float = 0.6):
    """Components of several sizes: each round takes the scale whose smoothed residual is brightest, small ones favoured."""
    import numpy as np

    ny, nx = dirty.shape
    y, x = np.meshgrid(np.fft.fftfreq(ny) * ny, np.fft.fftfreq(nx) * nx, indexing="ij")
    shapes = []
    for s in scales:
        g = np.exp(-4 * np.log(2) * (x * x + y * y) / s**2) if s > 0 else ((x == 0) & (y == 0)).astype(float)
        shapes.append(np.fft.fft2(g / g.sum()))
    cy, cx = np.unravel_index(np.argmax(beam), beam.shape)
    transfer = np.fft.fft2(np.roll(beam, (-cy, -cx), (0, 1)))
    res, model = dirty.copy(), np.zeros_like(dirty)
    top = max(scales) or 1.0
    for _ in range(rounds):
        if np.abs(res).max() <= threshold:
            break
        best = None
        for s, f in zip(scales, shapes):
            smooth = np.fft.ifft2(np.fft.fft2(res) * f).real
            norm = np.fft.ifft2(transfer * f * f).real.max()  # a component's own height in its smoothed residual
            at = np.unravel_index(np.argmax(np.abs(smooth)), smooth.shape)
            score = abs(smooth[at]) * (1 - small_bias * s / top)
            if best is None or score > best[0]:
                best = (score, at, smooth[at] / max(norm, 1e-300), f)
        _, at, height, f = best
        one = np.zeros_like(dirty)
        one[at] = gain * height
        part = np.fft.ifft2(np.fft.fft2(one) * f).real
        model += part
        res -= np.fft.ifft2(np.fft.fft2(part) * transfer).real
    return model, res


def entropy(dirty, beam, rounds: int = 200, step: float = 0.2, noise: float = 0.0):
    """A positive model of high entropy whose image fits the dirty one: multiplicative steps along the residual."""
    import numpy as np

    cy, cx = np.unravel_index(np.argmax(beam), beam.shape)
    transfer = np.fft.fft2(np.roll(beam, (-cy, -cx), (0, 1)))
    scale = max(np.abs(dirty).max(), 1e-300)
    model = np.full_like(dirty, scale * 1e-3)
    res = dirty
    for _ in range(rounds):
        res = dirty - np.fft.ifft2(np.fft.fft2(model) * transfer).real
        if np.sqrt((res * res).mean()) <= noise:
            break
        model = np.clip(model * np.exp(np.clip(step * np.fft.ifft2(np.fft.fft2(res) * transfer.conj()).real / scale, -1, 1)), 1e-12 * scale, None)
    return model, res


class Deconvolver:
    """A deconvolution in steps: set up with an algorithm, run cycles up to a limit, restore with a clean beam, correct for
    the primary beam. One plane, held by whoever runs it (a driver, or a task that has a plane)."""

    def __init__(self, dirty, beam, algorithm: str = "hogbom", gain: float = 0.1, niter: int = 100, threshold: float = 0.0, cycle: int = 0, **how):
        if algorithm not in ("hogbom", "clark", "multiscale", "mem"):
            raise ValueError(f"unknown algorithm {algorithm!r}")
        import numpy as np

        self.dirty, self.beam, self.algorithm, self.gain, self.left, self.threshold, self.cycle, self.how = dirty, beam, algorithm, gain, niter, threshold, cycle or niter, how
        self.model, self.residual = np.zeros_like(dirty), dirty.copy()

    def finished(self) -> bool:
        import numpy as np

        return self.left <= 0 or float(np.abs(self.residual).max()) <= self.threshold

    def run_cycle(self) -> None:
        """One minor cycle of at most `cycle` components."""
        n = min(self.cycle, self.left)
        self.left -= n
        if self.algorithm == "hogbom":
            parts, self.residual = hogbom(self.residual, self.beam, self.gain, n, self.threshold)
            for y, x, f in parts:
                self.model[y, x] += f
            return
        if self.algorithm == "clark":
            model, self.residual = clark(self.residual, self.beam, self.gain, n, self.threshold, **self.how)
        elif self.algorithm == "multiscale":
            model, self.residual = multiscale(self.residual, self.beam, gain=self.gain, rounds=n, threshold=self.threshold, **({"scales": [0.0]} | self.how))
        else:
            model, self.residual = entropy(self.residual, self.beam, rounds=n, **self.how)
            self.left = 0
        self.model = self.model + model

    def run(self) -> Deconvolver:
        while not self.finished():
            self.run_cycle()
        return self

    def restore(self, fwhm: float):
        """The model through a round Gaussian of a peak of 1, and the residual."""
        import numpy as np

        ny, nx = self.model.shape
        y, x = np.meshgrid(np.fft.fftfreq(ny) * ny, np.fft.fftfreq(nx) * nx, indexing="ij")
        g = np.exp(-4 * np.log(2) * (x * x + y * y) / fwhm**2)
        return np.fft.ifft2(np.fft.fft2(self.model) * np.fft.fft2(g)).real + self.residual

    @staticmethod
    def corrected(image, pb, cutoff: float = 0.2):
        import numpy as np

        return np.where(pb >= cutoff, image / np.maximum(pb, 1e-300), np.nan)


def clean_planes(df: DataFrame, keys: list[str], nx: int, ny: int, beam_of, fwhm: float, **how) -> DataFrame:
    """Each plane deconvolved by its own task: (keys, x, y, model, residual, restored). beam_of(nx, ny) gives the beam."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", x int, y int, model double, residual double, restored double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((ny, nx))
        g[p["y"], p["x"]] = p["value"]
        d = Deconvolver(g, beam_of(nx, ny), **how).run()
        y, x = np.mgrid[:ny, :nx]
        out = pd.DataFrame({k: [p[k].iloc[0]] * (nx * ny) for k in keys}, index=range(nx * ny))
        cols = {"model": d.model, "residual": d.residual, "restored": d.restore(fwhm)}
        return out.assign(x=x.reshape(-1).astype("int32"), y=y.reshape(-1).astype("int32"), **{k: v.reshape(-1) for k, v in cols.items()})

    return df.select(*keys, "x", "y", "value").groupBy(*keys).applyInPandas(run, schema)


def feather(low: DataFrame, high: DataFrame, keys: list[str], nx: int, ny: int, low_fwhm: float, scale: float = 1.0) -> DataFrame:
    """A low- and a high-resolution image as one: in the Fourier plane the low one as it is plus the high one times one less
    the low beam's transform. A plane of both is one task's work."""
    import numpy as np
    import pandas as pd

    kinds = dict(low.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", x int, y int, value double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        planes = np.zeros((2, ny, nx))
        planes[p["_which"], p["y"], p["x"]] = p["value"]
        fy, fx = np.meshgrid(np.fft.fftfreq(ny), np.fft.fftfreq(nx), indexing="ij")
        taper = np.exp(-((np.pi * low_fwhm) ** 2) * (fx * fx + fy * fy) / (4 * np.log(2)))
        both = scale * np.fft.fft2(planes[0]) + (1 - taper) * np.fft.fft2(planes[1])
        y, x = np.mgrid[:ny, :nx]
        out = pd.DataFrame({k: [p[k].iloc[0]] * (nx * ny) for k in keys}, index=range(nx * ny))
        return out.assign(x=x.reshape(-1).astype("int32"), y=y.reshape(-1).astype("int32"), value=np.fft.ifft2(both).real.reshape(-1))

    u = low.select(*keys, "x", "y", "value", F.lit(0).alias("_which")).unionByName(high.select(*keys, "x", "y", "value", F.lit(1).alias("_which")))
    return u.groupBy(*keys).applyInPandas(run, schema)


def split_sidebands(df: DataFrame, keys: list[str], spectra: str, signal_shifts: list[float], image_shifts: list[float], both: bool = False) -> DataFrame:
    """Signal sideband (and image sideband) of spectra observed at several offsets, an array of spectra a row: the sum of two
    spectra shifted by known channels is solved in the Fourier domain, frequency by frequency, by least squares."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", signal array<double>" + (", image array<double>" if both else "")

    def run(batches):
        for p in batches:
            sig, img = [], []
            for rows in p[spectra]:
                v = np.array([np.asarray(r, float) for r in rows])
                n = v.shape[1]
                t, f = np.fft.fft(v, axis=1), np.fft.fftfreq(n)
                out = np.zeros((2, n), complex)
                for k in range(n):
                    m = np.stack([np.exp(-2j * np.pi * f[k] * np.array(s)) for s in (signal_shifts, image_shifts)], 1)
                    out[:, k] = np.linalg.lstsq(m, t[:, k], rcond=1e-6)[0]
                a, b = np.fft.ifft(out, axis=1).real
                sig.append(a)
                img.append(b)
            q = p[keys].assign(signal=sig)
            yield q.assign(image=img) if both else q

    return df.mapInPandas(run, schema)
