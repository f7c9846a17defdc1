"""Fits per group: closed forms as aggregates, iterative ones as Arrow functions on one spectrum or series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_fit(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Least-squares line, by sums that combine before the shuffle."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def spectral_index(df: DataFrame, keys: list[str], freq: Column, flux: Column) -> DataFrame:
    """Power-law index: slope of ln flux against ln frequency, positive values only."""
    return line_fit(df.where((flux > 0) & (freq > 0)), keys, F.log(freq), F.log(flux)).withColumnRenamed("slope", "alpha")


def rotation_measure(df: DataFrame, keys: list[str], angle: Column, wavelength: Column) -> DataFrame:
    """Slope of the (unwrapped) polarization angle against the squared wavelength."""
    return line_fit(df, keys, wavelength * wavelength, angle).withColumnRenamed("slope", "rm").withColumnRenamed("intercept", "pa0")


def goodness(df: DataFrame, keys: list[str], chi2: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(chi2).alias("average"), F.min(chi2).alias("min"), F.max(chi2).alias("max"))


def subtract_polynomial(df: DataFrame, spectrum: str, order: int, line_free: list[tuple[int, int]]) -> DataFrame:
    """Spectra (array column) minus a polynomial through their line-free channels, a whole batch at a time."""
    import numpy as np
    import pandas as pd

    out = df.schema

    def run(batches):
        for p in batches:
            done = []
            for v in p[spectrum]:
                y = np.asarray(v, float)
                x = np.arange(len(y))
                free = np.zeros(len(y), bool)
                for lo, hi in line_free:
                    free[lo : hi + 1] = True
                done.append(y - np.polyval(np.polyfit(x[free], y[free], order), x) if free.sum() > order else y)
            yield p.assign(**{spectrum: pd.Series(done, index=p.index)})

    return df.mapInPandas(run, out)


def gaussian_fit(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 60) -> DataFrame:
    """One Gaussian plus a constant per group, Levenberg-Marquardt from the profile's peak; a group is one profile."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", height double, centre double, fwhm double, offset double, rms double, converged boolean"

    def model(p, t):
        e = np.exp(-4 * np.log(2) * ((t - p[1]) / p[2]) ** 2)
        j = np.stack((e, p[0] * e * 8 * np.log(2) * (t - p[1]) / p[2] ** 2, p[0] * e * 8 * np.log(2) * (t - p[1]) ** 2 / p[2] ** 3, np.ones_like(t)), 1)
        return p[0] * e + p[3], j

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(x)
        t, v = g[x].to_numpy(float), g[y].to_numpy(float)
        base = np.median(v)
        top = int(np.argmax(np.abs(v - base)))
        area = np.abs(v - base).sum() * (np.ptp(t) / max(len(t) - 1, 1))
        p = np.array([v[top] - base, t[top], max(area / max(abs(v[top] - base), 1e-12) * 0.94, np.ptp(t) / max(len(t) - 1, 1)), base])
        damp, done = 1e-3, False
        f, j = model(p, t)
        cost = ((v - f) ** 2).sum()
        for _ in range(rounds):
            a = j.T @ j
            try:
                step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (v - f))
            except np.linalg.LinAlgError:
                break
            q = p + step
            f2, j2 = model(q, t)
            c2 = ((v - f2) ** 2).sum()
            if c2 < cost:
                done = cost - c2 < 1e-10 * cost
                p, f, j, cost, damp = q, f2, j2, c2, damp / 5
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    done = True
                    break
        row = {k: [g[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"height": [p[0]], "centre": [p[1]], "fwhm": [abs(p[2])], "offset": [p[3]], "rms": [np.sqrt(cost / len(t))], "converged": [done]})

    return df.groupBy(*keys).applyInPandas(run, schema)


def deconvolve_beam(major: float, minor: float, pa: float, b_major: float, b_minor: float, b_pa: float) -> tuple[float, float, float] | None:
    """Gaussian from Gaussian (angles in radians); None for a point source."""

    def moments(a, b, t):
        c, s = math.cos(t), math.sin(t)
        return (a * c) ** 2 + (b * s) ** 2, (a * s) ** 2 + (b * c) ** 2, (a * a - b * b) * s * c

    p, q = moments(major, minor, pa), moments(b_major, b_minor, b_pa)
    x, y, z = (u - w for u, w in zip(p, q))
    mean, diff = (x + y) / 2, math.hypot((x - y) / 2, z)
    if mean - diff < 0:
        return None
    return math.sqrt(mean + diff), math.sqrt(mean - diff), 0.5 * math.atan2(2 * z, x - y)


# --- minimisers ---------------------------------------------------------------------------------------------------
def levenberg_marquardt(model, start, target, rounds: int = 100, tolerance: float = 1e-12):
    """Parameters of least squared residuals, their errors, the residual sum and whether it converged. model(p) gives values
    and their derivatives, one column a parameter."""
    import numpy as np

    p, damp, done = np.array(start, float), 1e-3, False
    f, j = model(p)
    cost = float(((target - f) ** 2).sum())
    for _ in range(rounds):
        a = j.T @ j
        try:
            q = p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-300), j.T @ (target - f))
        except np.linalg.LinAlgError:
            break
        f2, j2 = model(q)
        c2 = float(((target - f2) ** 2).sum())
        if np.isfinite(c2) and c2 <= cost:
            done = cost - c2 <= tolerance * max(cost, 1e-300)
            p, f, j, cost, damp = q, f2, j2, c2, max(damp / 9, 1e-15)
            if done:
                break
        else:
            damp *= 7
            if damp > 1e14:
                done = True
                break
    free = max(len(target) - len(p), 1)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(j.T @ j)) * cost / free, 0))
    return p, errors, cost, done


def metropolis(log_likelihood, start, widths, steps: int = 5000, seed: int = 1):
    """Samples of a posterior by a random walk: (samples, share accepted)."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    p = np.array(start, float)
    now, taken, out = log_likelihood(p), 0, []
    for _ in range(steps):
        q = p + rng.normal(size=len(p)) * widths
        new = log_likelihood(q)
        if np.log(rng.random()) < new - now:
            p, now, taken = q, new, taken + 1
        out.append(p.copy())
    return np.array(out), taken / steps


# --- profiles -----------------------------------------------------------------------------------------------------
def parse_estimates(text: str) -> list[tuple[float, float, float, str]]:
    """Lines `peak, centre, fwhm[, fixed]`, # begins a comment; fixed names parameters by the letters p, c and f."""
    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        parts = [x.strip() for x in line.split(",")]
        fixed = parts[3] if len(parts) > 3 else ""
        if len(parts) not in (3, 4) or set(fixed) - set("pcf"):
            raise ValueError(f"not an estimate: {line!r}")
        out.append((*map(float, parts[:3]), fixed))
    return out


def estimate_components(x, y, most: int, cutoff: float):
    """Starting values of up to `most` Gaussians: again and again the highest point of what is left, as wide as its half height."""
    import numpy as np

    left, out = np.array(y, float) - np.median(y), []
    step = float(np.median(np.diff(x))) if len(x) > 1 else 1.0
    for _ in range(most):
        i = int(np.argmax(np.abs(left)))
        h = left[i]
        if abs(h) <= cutoff:
            break
        lo = hi = i
        while lo > 0 and left[lo - 1] * np.sign(h) > abs(h) / 2:
            lo -= 1
        while hi < len(left) - 1 and left[hi + 1] * np.sign(h) > abs(h) / 2:
            hi += 1
        fwhm = max((hi - lo + 1) * step, step)
        out.append((h, float(x[i]), fwhm))
        left = left - h * np.exp(-4 * np.log(2) * ((x - x[i]) / fwhm) ** 2)
    return out


def profile_model(shape: str, n: int, order: int, x, fixed=()):
    """values and derivatives of n lines of a shape and a polynomial of an order over x, for levenberg_marquardt()."""
    import numpy as np

    def model(p):
        f, cols = np.zeros(len(x)), []
        for k in range(n):
            h, c, w = p[3 * k : 3 * k + 3]
            t = (x - c) / w
            if shape == "gaussian":
                e = np.exp(-4 * np.log(2) * t * t)
                d = (e, h * e * 8 * np.log(2) * t / w, h * e * 8 * np.log(2) * t * t / w)
            else:
                e = 1 / (1 + 4 * t * t)
                d = (e, h * e * e * 8 * t / w, h * e * e * 8 * t * t / w)
            f += h * e
            cols += d
        for k in range(order + 1):
            f += p[3 * n + k] * x**k
            cols.append(x**k)
        j = np.stack(cols, 1)
        j[:, list(fixed)] = 0.0
        return f, j

    return model


def fit_profiles(df: DataFrame, keys: list[str], x: str, y: str, components: int = 1, shape: str = "gaussian", order: int = -1, estimates: list | None = None, cutoff: float = 0.0) -> DataFrame:
    """Lines (gaussian or lorentzian) and a polynomial (order -1: none) through each group's profile, from estimates or from
    its peaks: a row a line, by ascending centre, with errors."""
    import numpy as np
    import pandas as pd

    if shape not in ("gaussian", "lorentzian"):
        raise ValueError(f"unknown shape {shape!r}")
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", component int, peak double, centre double, fwhm double, peak_err double, centre_err double, fwhm_err double, flux double, rms double, converged boolean"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(x)
        t, v = g[x].to_numpy(float), g[y].to_numpy(float)
        start = [e[:3] for e in estimates] if estimates else estimate_components(t, v, components, cutoff)
        n = len(start)
        if not n:
            return pd.DataFrame(columns=[c.strip().split()[0].strip("`") for c in schema.split(",")])
        fixed = [3 * k + "pcf".index(c) for k, e in enumerate(estimates or []) for c in (e[3] if len(e) > 3 else "")]
        base = [float(np.median(v))] + [0.0] * order if order >= 0 else []
        p, err, cost, done = levenberg_marquardt(profile_model(shape, n, order, t, fixed), [*np.ravel(start), *base], v, 50 + 10 * (3 * n + order + 1))
        lines = p[: 3 * n].reshape(n, 3)
        by = np.argsort(lines[:, 1])
        width = np.abs(lines[:, 2])
        area = np.sqrt(np.pi / (4 * np.log(2))) if shape == "gaussian" else np.pi / 2
        row = pd.DataFrame({k: [g[k].iloc[0]] * n for k in keys}, index=range(n))
        e = err[: 3 * n].reshape(n, 3)
        return row.assign(
            component=np.arange(n, dtype="int32"), peak=lines[by, 0], centre=lines[by, 1], fwhm=width[by], peak_err=e[by, 0], centre_err=e[by, 1], fwhm_err=e[by, 2],
            flux=lines[by, 0] * width[by] * area, rms=float(np.sqrt(cost / len(t))), converged=bool(done),
        )

    return df.groupBy(*keys).applyInPandas(run, schema)


# --- images and visibilities --------------------------------------------------------------------------------------
def fit_gaussians_2d(df: DataFrame, keys: list[str], value: str = "value", estimates: tuple | None = None, offset: bool = False) -> DataFrame:
    """One elliptical Gaussian (and a constant) through each plane's pixels: peak, place, axes, angle (radians, from the y
    axis to the negative x axis), flux in units of the value times pixels."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", peak double, x double, y double, major double, minor double, pa double, offset double, flux double, rms double, converged boolean"
    k4 = 4 * np.log(2)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        px, py, v = (g[c].to_numpy(float) for c in ("x", "y", value))
        if estimates:
            start = list(estimates)
        else:
            w = np.maximum(v - np.median(v), 0)
            total = w.sum() or 1.0
            cx, cy = (w * px).sum() / total, (w * py).sum() / total
            sx = 2.35 * np.sqrt(max((w * (px - cx) ** 2).sum() / total, 0.3))
            sy = 2.35 * np.sqrt(max((w * (py - cy) ** 2).sum() / total, 0.3))
            i = int(np.argmax(v))
            start = [v[i], px[i], py[i], sx, sy]
        # exp(-(a dx^2 + 2 b dx dy + c dy^2)): smooth in its parameters however round it is
        p0 = [start[0], start[1], start[2], k4 / start[3] ** 2, 0.0, k4 / start[4] ** 2] + ([float(np.median(v))] if offset else [])

        def model(p):
            dx, dy = px - p[1], py - p[2]
            e = np.exp(-np.clip(p[3] * dx * dx + 2 * p[4] * dx * dy + p[5] * dy * dy, -50, 700))
            h = p[0] * e
            cols = [e, h * (2 * p[3] * dx + 2 * p[4] * dy), h * (2 * p[4] * dx + 2 * p[5] * dy), -h * dx * dx, -2 * h * dx * dy, -h * dy * dy]
            return h + (p[6] if offset else 0.0), np.stack(cols + ([np.ones(len(v))] if offset else []), 1)

        p, _, cost, done = levenberg_marquardt(model, p0, v, 200)
        mean, diff = (p[3] + p[5]) / 2, np.hypot((p[3] - p[5]) / 2, p[4])
        lo, hi = max(mean - diff, 1e-300), max(mean + diff, 1e-300)
        # the long axis lies where the quadratic form is least
        t = 0.5 * np.arctan2(2 * p[4], p[3] - p[5]) + np.pi / 2
        major, minor = np.sqrt(k4 / lo), np.sqrt(k4 / hi)
        row = {k: [g[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {
            "peak": [p[0]], "x": [p[1]], "y": [p[2]], "major": [major], "minor": [minor], "pa": [(t - np.pi / 2) % np.pi], "offset": [p[6] if offset else 0.0], "flux": [p[0] * np.pi / k4 * major * minor],
            "rms": [np.sqrt(cost / len(v))], "converged": [done],
        })

    return df.groupBy(*keys).applyInPandas(run, schema)


def fit_point(vis: DataFrame, keys: list[str], rounds: int = 20) -> DataFrame:
    """A point source (flux, l, m) through visibilities (re, im, u and v in wavelengths, weight): Gauss-Newton whose normal
    equations are sums over all rows, so a round is one grouped aggregate and no group is gathered. Rounds are driven from
    here; the parameters of each key are a short table."""
    from ..functions.columns import Complex

    now = vis.groupBy(*keys).agg((F.sum(F.col("re") * F.col("weight")) / F.sum("weight")).alias("flux")).withColumn("l", F.lit(0.0)).withColumn("m", F.lit(0.0))
    w, u, v = F.col("weight"), F.col("u") * (2 * math.pi), F.col("v") * (2 * math.pi)
    for k in range(rounds):
        if k == 0:  # from the centre: the phases' slope gives the place
            ph = F.atan2("im", "re")
            s = vis.groupBy(*keys).agg(*(F.sum(w * a * b).alias(n) for n, a, b in (("uu", u, u), ("uv", u, v), ("vv", v, v), ("up", u, ph), ("vp", v, ph))), F.avg(F.hypot("re", "im")).alias("flux"))
            d = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
            now = s.select(*keys, "flux", (-(F.col("up") * F.col("vv") - F.col("vp") * F.col("uv")) / d).alias("l"), (-(F.col("vp") * F.col("uu") - F.col("up") * F.col("uv")) / d).alias("m"))
        rows = [r.asDict() for r in now.collect()]
        now = vis.sparkSession.createDataFrame(rows, now.schema)
        j = vis.join(F.broadcast(now), keys)  # a row a key
        e = Complex.polar(F.lit(1.0), -(u * F.col("l") + v * F.col("m")))
        f = F.col("flux")
        r = Complex(F.col("re"), F.col("im")) - Complex(f * e.re, f * e.im)
        # derivatives by flux, l and m
        grad = [e, Complex(f * u * e.im, -f * u * e.re), Complex(f * v * e.im, -f * v * e.re)]
        dot = lambda a, b: F.sum(w * (a.re * b.re + a.im * b.im))
        sums = [dot(grad[a], grad[b]).alias(f"n{a}{b}") for a in range(3) for b in range(a, 3)] + [dot(grad[a], r).alias(f"r{a}") for a in range(3)]
        got = {tuple(x[c] for c in keys): x for x in j.groupBy(*keys).agg(*sums, F.sum(w * (r.re * r.re + r.im * r.im)).alias("chi2"), F.count("*").alias("n")).collect()}
        import numpy as np

        new, moved = [], 0.0
        for row in rows:
            x = got[tuple(row[c] for c in keys)]
            n = np.array([[x[f"n{min(a, b)}{max(a, b)}"] for b in range(3)] for a in range(3)])
            step = np.linalg.lstsq(n, np.array([x[f"r{a}"] for a in range(3)]), rcond=None)[0]
            moved = max(moved, float(np.abs(step / np.array([max(abs(row["flux"]), 1e-300), 1.0, 1.0])).max()))
            new.append(row | {c: float(row[c] + x) for c, x in zip(("flux", "l", "m"), step)})
        now = vis.sparkSession.createDataFrame(new, now.schema)
        if moved < 1e-12:
            break
    return now


def rotation_measure_fit(df: DataFrame, keys: list[str], angle: Column, wavelength: Column, error: Column | None = None) -> DataFrame:
    """Rotation measure and angle at zero with errors, reduced chi squared and the turns between the longest and the shortest
    wavelength; weighted sums that combine before the shuffle."""
    w = 1 / (error * error) if error is not None else F.lit(1.0)
    x, y = wavelength * wavelength, angle
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("_s"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"), F.sum(w * x * x).alias("_xx"), F.sum(w * x * y).alias("_xy"), F.sum(w * y * y).alias("_yy"),
        (F.max(x) - F.min(x)).alias("_span"),
    )
    s, sx, sy, sxx, sxy, syy = (F.col("_" + c) for c in ("s", "x", "y", "xx", "xy", "yy"))
    d = s * sxx - sx * sx
    g = g.withColumn("rm", (s * sxy - sx * sy) / d).withColumn("pa0", (sy - F.col("rm") * sx) / s)
    chi2 = syy - 2 * F.col("rm") * sxy - 2 * F.col("pa0") * sy + F.col("rm") * F.col("rm") * sxx + 2 * F.col("rm") * F.col("pa0") * sx + F.col("pa0") * F.col("pa0") * s
    return g.select(
        *keys, "rm", F.sqrt(s / d).alias("rm_err"), "pa0", F.sqrt(sxx / d).alias("pa0_err"), F.try_divide(F.greatest(chi2, F.lit(0.0)), F.col("n") - 2).alias("redchi2"),
        F.floor(F.abs(F.col("rm")) * F.col("_span") / math.pi).cast("int").alias("nturns"),
    )


# --- single-dish baselines ----------------------------------------------------------------------------------------
def parse_baselines(text: str) -> dict[int, tuple[str, int, float, int]]:
    """Lines `row, function, order, clip, rounds` (poly or chebyshev) by row; # begins a comment."""
    out = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            row, kind, order, cut, rounds = (x.strip() for x in line.split(","))
            if kind not in ("poly", "chebyshev"):
                raise ValueError(f"unknown function {kind!r}")
            out[int(row)] = (kind, int(order), float(cut), int(rounds))
    return out


def find_lines(v, cut: float = 5.0, edge: int = 0):
    """Channels that stand out of the median by so many deviations, with their neighbours: a boolean array."""
    import numpy as np

    v = np.asarray(v, float)
    d = np.abs(v - np.median(v))
    hit = d > cut * 1.4826 * np.median(d)
    out = hit.copy()
    out[1:] |= hit[:-1]
    out[:-1] |= hit[1:]
    if edge:
        out[:edge] = out[-edge:] = True
    return out


def subtract_baselines(df: DataFrame, spectrum: str, order: int, cut: float = 3.0, rounds: int = 3, find: bool = False) -> DataFrame:
    """Spectra less a polynomial through their channels, of which those beyond `cut` deviations of the residuals are left out
    round by round; find: lines are looked for first. A spectrum at a time, in batches."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for p in batches:
            done = []
            for v in p[spectrum]:
                y = np.asarray(v, float)
                x = np.linspace(-1, 1, len(y))
                good = ~find_lines(y) if find else np.ones(len(y), bool)
                base = np.zeros(len(y))
                for _ in range(rounds + 1):
                    if good.sum() <= order:
                        break
                    base = np.polynomial.chebyshev.chebval(x, np.polynomial.chebyshev.chebfit(x[good], y[good], order))
                    r = y - base
                    keep = good & (np.abs(r) <= cut * (np.std(r[good]) or np.inf))
                    if keep.sum() == good.sum():
                        break
                    good = keep
                done.append(y - base)
            yield p.assign(**{spectrum: pd.Series(done, index=p.index)})

    return df.mapInPandas(run, df.schema)
