"""Quantities: a number with a unit, parsed at the edge; columns hold doubles of a known unit."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column

# fixed values: powers of (m, kg, s, A, K, rad) and the factor to these base units
_BASE = {
    "m": (1, (1, 0, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0, 0)), "s": (1, (0, 0, 1, 0, 0, 0)), "A": (1, (0, 0, 0, 1, 0, 0)),
    "K": (1, (0, 0, 0, 0, 1, 0)), "rad": (1, (0, 0, 0, 0, 0, 1)), "Hz": (1, (0, 0, -1, 0, 0, 0)), "N": (1, (1, 1, -2, 0, 0, 0)),
    "J": (1, (2, 1, -2, 0, 0, 0)), "W": (1, (2, 1, -3, 0, 0, 0)), "Pa": (1, (-1, 1, -2, 0, 0, 0)), "V": (1, (2, 1, -3, -1, 0, 0)),
    "Jy": (1e-26, (0, 1, -2, 0, 0, 0)), "deg": (math.pi / 180, (0, 0, 0, 0, 0, 1)), "arcmin": (math.pi / 10800, (0, 0, 0, 0, 0, 1)),
    "arcsec": (math.pi / 648000, (0, 0, 0, 0, 0, 1)), "min": (60, (0, 0, 1, 0, 0, 0)), "h": (3600, (0, 0, 1, 0, 0, 0)), "d": (86400, (0, 0, 1, 0, 0, 0)),
    "a": (365.25 * 86400, (0, 0, 1, 0, 0, 0)), "pc": (3.0856775814913673e16, (1, 0, 0, 0, 0, 0)), "AU": (149597870700.0, (1, 0, 0, 0, 0, 0)),
}
_PREFIX = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 10.0, "d": 0.1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18}
_PART = re.compile(r"([./]?)\s*([A-Za-z]+)(-?\d*)")


def unit(text: str) -> tuple[float, tuple[int, ...]]:
    """Factor and dimensions of a unit such as km/s, kg.m2 or mJy."""
    factor, dims, at = 1.0, [0] * 6, 0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        power = int(m[3] or 1) * (-1 if m[1] == "/" else 1)
        f, d = _one(m[2])
        factor *= f**power
        dims = [a + b * power for a, b in zip(dims, d)]
    if at != len(text):
        raise ValueError(f"illegal unit {text!r}")
    return factor, tuple(dims)


def _one(name: str) -> tuple[float, tuple[int, ...]]:
    if name in _BASE:
        return _BASE[name]
    for p in sorted(_PREFIX, key=len, reverse=True):
        if name.startswith(p) and name[len(p) :] in _BASE:
            f, d = _BASE[name[len(p) :]]
            return f * _PREFIX[p], d
    raise ValueError(f"illegal unit {name!r}")


def parse(text: str) -> tuple[float, str]:
    m = re.fullmatch(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(.*?)\s*", text)
    if not m:
        raise ValueError(f"no quantity: {text!r}")
    unit(m[2])
    return float(m[1]), m[2]


def factor(source: str, target: str) -> float:
    (a, d), (b, e) = unit(source), unit(target)
    if d != e:
        raise ValueError(f"{source!r} does not convert to {target!r}")
    return a / b


def convert(column: Column, source: str, target: str) -> Column:
    return column * factor(source, target)


def compare(a: str, b: str) -> bool:
    """Do two quantities have the same dimensions?"""
    return unit(parse(a)[1])[1] == unit(parse(b)[1])[1]
