"""Line catalogue search: a chain of optional clauses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: kinds of objects that a catalogue marks, each a boolean column
OBJECTS = ("top20", "planetary_atmosphere", "hot_cores", "dark_clouds", "diffuse_clouds", "comets", "agb_ppn_pn", "extragalactic")


def astronomical(lines: DataFrame, *kinds: str) -> DataFrame:
    """Lines seen in any of these kinds of objects."""
    if unknown := [k for k in kinds if k not in OBJECTS]:
        raise ValueError(f"unknown kinds {', '.join(unknown)}")
    return lines.where(reduce(lambda a, b: a | b, (F.col(k) for k in kinds), F.lit(False))) if kinds else lines


def with_species(lines: DataFrame, species: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Lines with their species' columns; lines of unknown species stay."""
    return lines.join(species.select(key, *columns), key, "left")


def records(lines: DataFrame, most: int = 10_000) -> list[dict]:
    """Up to `most` lines as records, in order of frequency: for a listing, not for a table."""
    return [r.asDict() for r in lines.orderBy("frequency").limit(most).collect()]


def search(
    lines: DataFrame, frequency: tuple[float, float] | None = None, species: list[str] | None = None, chemnames: list[str] | None = None, recommended: bool = False,
    qns: list[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None, rrl: str = "include", like: dict[str, str] | None = None,
    any_of: list[str] | None = None, order: list[str] | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Rows that pass all clauses given. A range with -1 at both ends is unset; rrl keeps, drops or keeps only
    recombination lines; any_of lists boolean columns of which one must hold. The chain is ANDed and pushed to the scan."""
    if frequency is not None:
        if len(frequency) != 2:
            raise ValueError("a frequency range has two ends")
        lines = lines.where(F.col("frequency").between(*frequency))
    for column, values in (("species", species), ("chemname", chemnames), ("qns", qns)):
        if values:
            lines = lines.where(F.col(column).isin(values))
    for column, pattern in (like or {}).items():
        lines = lines.where(F.col(column).like(pattern))
    if recommended:
        lines = lines.where("recommended")
    for column, (lo, hi) in (ranges or {}).items():
        if (lo, hi) != (-1, -1):
            lines = lines.where(F.col(column).between(lo, hi))
    if rrl != "include":
        is_rrl = F.col("species").rlike("[&]")
        lines = lines.where(is_rrl if rrl == "only" else ~is_rrl)
    if any_of:
        lines = lines.where(reduce(lambda a, b: a | b, (F.col(c) for c in any_of)))
    if order:
        lines = lines.orderBy(*order)
    if offset:
        lines = lines.offset(offset)
    return lines.limit(limit) if limit is not None else lines
