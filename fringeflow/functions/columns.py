"""Column builders: complex numbers, polarization, directions, Doppler, units, functionals. All stay inside Catalyst."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

C_M_S = 299_792_458.0
XMADM = 1.482602218505602  # 1 / quantile(3/4) of the normal distribution


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class Complex:
    """A complex number as two double columns."""

    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Complex) -> Complex:
        d = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / d, (self.im * o.re - self.re * o.im) / d)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def amp(self) -> Column:
        return F.hypot(self.re, self.im)

    def phase(self) -> Column:
        return F.atan2(self.im, self.re)

    @staticmethod
    def polar(amp: Column, phase: Column) -> Complex:
        return Complex(amp * F.cos(phase), amp * F.sin(phase))


def phase_shift(v: Complex, u: Column, w: Column, dx: float, dy: float, freq: Column) -> Complex:
    """Rotates v by -2 pi / c (u dx + w dy) freq."""
    return v * Complex.polar(F.lit(1.0), (u * dx + w * dy) * freq * (-2 * math.pi / C_M_S))


def jones_apply(kind: str, j: list[Complex], v: list[Complex]) -> list[Complex]:
    """A 2x2 Jones matrix on (XX, XY, YX, YY), from the left: general (4 terms), diagonal (2) or scalar (1)."""
    if kind == "scalar":
        return [j[0] * x for x in v]
    if kind == "diagonal":
        return [j[0] * v[0], j[0] * v[1], j[1] * v[2], j[1] * v[3]]
    if kind != "general":
        raise ValueError(f"unknown Jones type {kind!r}")
    return [j[0] * v[0] + j[1] * v[2], j[0] * v[1] + j[1] * v[3], j[2] * v[0] + j[3] * v[2], j[2] * v[1] + j[3] * v[3]]


def stokes(xx: Column, xy: Complex, yx: Complex, yy: Column) -> dict[str, Column]:
    """Stokes parameters of linear-feed correlations."""
    return {"I": (xx + yy) / 2, "Q": (xx - yy) / 2, "U": (xy.re + yx.re) / 2, "V": (xy.im - yx.im) / 2}


def linear_polarization(q: Column, u: Column, sigma: float = 0.0) -> Column:
    """Linearly polarized intensity, debiased; null below the noise."""
    p = q * q + u * u - F.lit(sigma * sigma)
    return F.when(p >= 0, F.sqrt(p))


def total_polarization(q: Column, u: Column, v: Column, sigma: float = 0.0) -> Column:
    p = q * q + u * u + v * v - F.lit(sigma * sigma)
    return F.when(p >= 0, F.sqrt(p))


def polarization_angle(q: Column, u: Column) -> Column:
    """Degrees."""
    return F.degrees(F.atan2(u, q)) / 2


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two directions, radians, by the well-conditioned form."""
    d = lon2 - lon1
    a = F.cos(lat2) * F.sin(d)
    b = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)
    return F.atan2(F.hypot(a, b), F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(d))


def position_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d = lon2 - lon1
    return F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))


def shift_direction(lon: Column, lat: Column, offset: Column, angle: Column) -> tuple[Column, Column]:
    """The direction at a separation and position angle from another."""
    s = F.sin(lat) * F.cos(offset) + F.cos(lat) * F.sin(offset) * F.cos(angle)
    return lon + F.atan2(F.sin(offset) * F.sin(angle), F.cos(lat) * F.cos(offset) - F.sin(lat) * F.sin(offset) * F.cos(angle)), F.asin(s)


def orthographic(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Sine projection about a centre, radians."""
    d = lon - lon0
    return F.cos(lat) * F.sin(d), F.sin(lat) * math.cos(lat0) - F.cos(lat) * math.sin(lat0) * F.cos(d)


def elevation(hour_angle: Column, dec: Column, latitude: float) -> Column:
    return F.asin(F.sin(dec) * math.sin(latitude) + F.cos(dec) * math.cos(latitude) * F.cos(hour_angle))


_DOPPLER = ("radio", "optical", "relativistic", "z", "beta", "gamma", "ratio")


def min_match(name: str, known) -> str:
    """The one of the known names that starts with `name`, upper and lower case alike."""
    found = [k for k in known if k.lower() == name.lower()] or [k for k in known if k.lower().startswith(name.lower())]
    if len(found) != 1:
        raise ValueError(f"{name!r} names {'none' if not found else 'several'} of {', '.join(known)}")
    return found[0]


def velocity(freq: Column, rest: float, kind: str = "radio") -> Column:
    """Velocity in m/s (or the plain ratio measures) of a frequency against a rest frequency."""
    r = freq / F.lit(rest)
    kind = min_match(kind, _DOPPLER)
    beta = (1 - r * r) / (1 + r * r)
    return {
        "radio": (1 - r) * C_M_S, "optical": (1 / r - 1) * C_M_S, "relativistic": beta * C_M_S, "z": 1 / r - 1,
        "beta": beta, "gamma": 1 / F.sqrt(1 - beta * beta), "ratio": r,
    }[kind]


def frequency(v: Column, rest: float, kind: str = "radio") -> Column:
    """The inverse of velocity() for the three velocity definitions."""
    b = v / C_M_S
    kind = min_match(kind, _DOPPLER[:3])
    return rest * {"radio": 1 - b, "optical": 1 / (1 + b), "relativistic": F.sqrt((1 - b) / (1 + b))}[kind]


def gaussian1d(x: Column, height: float, centre: float, fwhm: float) -> Column:
    return height * F.exp(-4 * math.log(2) * F.pow((x - centre) / fwhm, 2))


def gaussian2d(x: Column, y: Column, height: float, cx: float, cy: float, major: float, minor: float, pa: float) -> Column:
    """pa in radians, from the y axis to the negative x axis."""
    c, s = math.cos(pa), math.sin(pa)
    a = ((y - cy) * c - (x - cx) * s) / major
    b = ((x - cx) * c + (y - cy) * s) / minor
    return height * F.exp(-4 * math.log(2) * (a * a + b * b))


def lorentzian(x: Column, height: float, centre: float, fwhm: float) -> Column:
    return height / (1 + 4 * F.pow((x - centre) / fwhm, 2))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def power_log_polynomial(x: Column, coefficients: list[float]) -> Column:
    """c0 * x ** (c1 + c2 ln x + c3 ln(x)**2 ...)."""
    return coefficients[0] * F.pow(x, polynomial(F.log(x), list(coefficients[1:]) or [0.0]))


def log_transformed_polynomial(x: Column, coefficients: list[float]) -> Column:
    """ln of the power log polynomial: c0 + c1 ln x + c2 ln(x)**2 ..."""
    return polynomial(F.log(x), coefficients)


def primary_beam(kind: str, r: Column, scale: float, coefficients: list[float] | None = None) -> Column:
    """Power pattern at a distance: gaussian and airy take the half-power width as scale, the others x = r / scale."""
    x = r / F.lit(scale)
    c = coefficients or []
    if kind == "gaussian":
        return F.exp(-4 * math.log(2) * x * x)
    if kind == "poly":
        return polynomial(x * x, c)
    if kind == "inverse_poly":
        return 1 / polynomial(x * x, c)
    if kind == "cos_poly":
        return F.pow(polynomial(F.cos(x), c), 2)
    if kind == "airy":
        z = x * (2 * 1.61633995)
        # series of 2 J1(z) / z, good to 1e-9 for z < 8: beyond the first sidelobes
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, 22):
            term = term * (-(z * z) / (4.0 * k * (k + 1)))
            total = total + term
        return total * total
    raise ValueError(f"unknown beam {kind!r}")


def flux_from_peak(peak: Column, major: Column, minor: Column, beam_major: float, beam_minor: float) -> Column:
    """Integrated flux density of a Gaussian of that peak and size in an image with that beam."""
    return peak * major * minor / (beam_major * beam_minor)


def peak_from_flux(flux: Column, major: Column, minor: Column, beam_major: float, beam_minor: float) -> Column:
    return flux * (beam_major * beam_minor) / (major * minor)


def weight_of_sigma(sigma: Column) -> Column:
    """1 / sigma**2, or 0 where sigma is not a positive single-precision number."""
    return F.when(sigma > 1.1754943508222875e-38, 1 / (sigma * sigma)).otherwise(F.lit(0.0))


def sigma_of_weight(weight: Column) -> Column:
    return F.when(weight > 0, 1 / F.sqrt(weight)).otherwise(F.lit(-1.0))


def hms(radians: Column) -> Column:
    """HH:MM:SS.ss of an angle."""
    s = F.pmod(F.round(F.degrees(radians) / 15 * 360000).cast("long"), F.lit(24 * 360000))
    return F.format_string("%02d:%02d:%02d.%02d", F.expr("0") + (s / 360000).cast("int"), (s % 360000 / 6000).cast("int"), (s % 6000 / 100).cast("int"), (s % 100).cast("int"))


def dms(radians: Column) -> Column:
    """+DD.MM.SS.s of an angle."""
    s = F.round(F.abs(F.degrees(radians)) * 36000).cast("long")
    return F.format_string(
        "%s%02d.%02d.%02d.%01d", F.when(radians < 0, "-").otherwise("+"), (s / 36000).cast("int"), (s % 36000 / 600).cast("int"), (s % 600 / 10).cast("int"), (s % 10).cast("int")
    )


# --- more directions, constants, media ----------------------------------------------------------------------------
# fixed values: constants in SI units
CONSTANTS = {
    "c": 299_792_458.0, "h": 6.62607015e-34, "k": 1.380649e-23, "e": 1.602176634e-19, "G": 6.6743e-11, "m_e": 9.1093837015e-31, "m_p": 1.67262192369e-27, "N_A": 6.02214076e23,
    "sigma": 5.670374419e-8, "au": 149_597_870_700.0, "pc": 3.0856775814913673e16, "ly": 9.4607304725808e15, "M_sun": 1.98847e30, "R_sun": 6.957e8, "L_sun": 3.828e26, "R_earth": 6.3781e6, "jy": 1e-26,
}


def constant(name: str) -> Column:
    return F.lit(CONSTANTS[name])


# fixed values: the matrix from equatorial (J2000) to galactic coordinates
_GALACTIC = ((-0.0548755604, -0.8734370902, -0.4838350155), (0.4941094279, -0.4448296300, 0.7469822445), (-0.8676661490, -0.1980763734, 0.4559837762))
_OBLIQUITY = math.radians(23.4392911)


def rotated(lon: Column, lat: Column, matrix) -> tuple[Column, Column]:
    """A direction in another frame, by a matrix of direction cosines."""
    v = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    x, y, z = (sum((a * b for a, b in zip(row, v)), F.lit(0.0)) for row in matrix)
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)))


def to_frame(lon: Column, lat: Column, source: str, target: str) -> tuple[Column, Column]:
    """Between J2000, GALACTIC and ECLIPTIC directions, radians."""
    c, s = math.cos(_OBLIQUITY), math.sin(_OBLIQUITY)
    known = {"J2000": ((1, 0, 0), (0, 1, 0), (0, 0, 1)), "GALACTIC": _GALACTIC, "ECLIPTIC": ((1, 0, 0), (0, c, s), (0, -s, c))}
    for name in (source, target):
        if name not in known:
            raise ValueError(f"unknown frame {name!r}")
    back = tuple(zip(*known[source]))
    return rotated(*rotated(lon, lat, back), known[target])


def azimuth(hour_angle: Column, dec: Column, latitude: float) -> Column:
    """From north through east, radians. A hair west of north is a whole turn: pmod would make it 0."""
    a = F.atan2(-F.sin(hour_angle) * F.cos(dec), F.sin(dec) * math.cos(latitude) - F.cos(dec) * F.cos(hour_angle) * math.sin(latitude))
    return a - F.floor(a / (2 * math.pi)) * (2 * math.pi)


def project(kind: str, lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Offsets of a direction in a projection about a centre: SIN, TAN, ARC, STG, SFL (sine of latitude) or CAR, radians."""
    d = lon - lon0
    x, y = orthographic(lon, lat, lon0, lat0)
    z = F.sin(lat) * math.sin(lat0) + F.cos(lat) * math.cos(lat0) * F.cos(d)
    if kind == "SIN":
        return x, y
    if kind == "TAN":
        return x / z, y / z
    if kind == "STG":
        return 2 * x / (1 + z), 2 * y / (1 + z)
    if kind == "ARC":
        r = F.hypot(x, y)
        f = F.when(r > 0, F.atan2(r, z) / r).otherwise(1.0)
        return x * f, y * f
    if kind == "SFL":
        return d * F.cos(lat), lat - lat0
    if kind == "CAR":
        return d, lat - lat0
    raise ValueError(f"unknown projection {kind!r}")


def multiplet(x: Column, height: float, centre: float, fwhm: float, others: list[tuple[float, float, float]]) -> Column:
    """Gaussians tied to a first one: (ratio of heights, offset of centres, ratio of widths) each."""
    out = gaussian1d(x, height, centre, fwhm)
    for ratio, offset, width in others:
        out = out + gaussian1d(x, height * ratio, centre + offset, fwhm * width)
    return out


def compiled(expression: str, x: str, parameters: dict[str, float]) -> Column:
    """A function given as text: an SQL expression of `x`, which stands for a column, and of named parameters."""
    values = {"x": f"`{x}`"} | {k: f"({float(v)!r}D)" for k, v in parameters.items()}
    return F.expr(re.sub(r"\b(" + "|".join(map(re.escape, values)) + r")\b(?!\s*\()", lambda m: values[m[1]], expression))


def water_vapour_pressure(temperature: Column, humidity: Column) -> Column:
    """Partial pressure in hPa over water, from kelvin and per cent (Magnus formula)."""
    t = temperature - 273.15
    return humidity / 100 * 6.112 * F.exp(17.62 * t / (243.12 + t))


def refractivity(pressure: Column, temperature: Column, vapour: Column) -> Column:
    """N units at radio wavelengths from hPa and kelvin (Smith and Weintraub)."""
    return 77.6 * (pressure - vapour) / temperature + 64.8 * vapour / temperature + 3.776e5 * vapour / (temperature * temperature)


def precipitable_water(vapour: Column, temperature: Column, scale_height: float = 2000.0) -> Column:
    """Millimetres of water above a place whose vapour falls off over a scale height (m)."""
    return vapour * 100 / (461.5 * temperature) * scale_height


def transmission(opacity: Column, elevation_angle: Column) -> Column:
    """Share of a signal that passes a flat atmosphere of a zenith opacity."""
    return F.exp(-opacity / F.sin(elevation_angle))


# --- frames of velocity, ephemerides ------------------------------------------------------------------------------
# fixed values: the sun's motion against the local standard of rest, m/s towards a J2000 direction (radians)
SUN_MOTION = 20_000.0
SUN_APEX = (math.radians(270.9595417), math.radians(30.0046667))


def rest_velocity(lon: Column, lat: Column) -> Column:
    """How fast a direction recedes from the local standard of rest less how fast it recedes from the sun, m/s."""
    a, d = SUN_APEX
    return SUN_MOTION * (F.sin(lat) * math.sin(d) + F.cos(lat) * math.cos(d) * F.cos(lon - a))


def reframed(freq: Column, speed: Column) -> Column:
    """A frequency in a frame that recedes from its source faster by a speed (m/s), relativistic."""
    b = speed / C_M_S
    return freq * F.sqrt((1 - b) / (1 + b))


def geocentric(ra: Column, dec: Column, distance: Column, sidereal: Column, latitude: float, radius: float) -> tuple[Column, Column]:
    """The direction from the earth's centre of a body seen from a place on it: radians, distance and radius in the same unit."""
    c, s = radius * math.cos(latitude), radius * math.sin(latitude)
    x = distance * F.cos(dec) * F.cos(ra) + c * F.cos(sidereal)
    y = distance * F.cos(dec) * F.sin(ra) + c * F.sin(sidereal)
    z = distance * F.sin(dec) + s
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.atan2(z, F.hypot(x, y))


def faraday_rotation(electrons: Column, field: Column, freq: Column) -> Column:
    """Turn of a polarization angle (radians) by a column of electrons (1e16 m^-2) in a field along the sight (tesla)."""
    return 2.631e-13 * electrons * 1e16 * field * F.pow(C_M_S / freq, 2)
