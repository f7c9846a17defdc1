"""FITS tables and random groups: visibilities as UVFITS and FITS-IDI, image planes as files.

Files are read whole by one task each (`binaryFile`), which any store that Spark reads can serve, and decoded in bulk.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fits import BLOCK, CARD, encode_image, parse_header

# fixed values: letters of FITS binary table columns, and numpy's big-endian types
LETTERS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _cards(rows: list[tuple[str, object]]) -> bytes:
    def shown(v: object) -> str:
        if isinstance(v, bool):
            return f"{'T' if v else 'F':>20}"
        return f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"

    head = "".join(f"{k:<8}= {shown(v)}".ljust(CARD) for k, v in rows) + "END".ljust(CARD)
    return head.encode().ljust(-(-len(head) // BLOCK) * BLOCK)


def _padded(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


EMPTY_PRIMARY = _cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])


def encode_table(name: str, columns: dict[str, np.ndarray], cards: dict | None = None) -> bytes:
    """A binary table extension; a column is a vector a row or, with two axes, an array a row."""
    kinds = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}
    n = len(next(iter(columns.values())))
    fields, forms = [], []
    for k, v in columns.items():
        letter = kinds[v.dtype.str[1:]]
        width = int(np.prod(v.shape[1:], dtype=int))
        fields.append((k, LETTERS[letter], v.shape[1:]))
        forms.append(f"{width}{letter}")
    rows = np.zeros(n, np.dtype(fields))
    for k, v in columns.items():
        rows[k] = v
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(fields)), ("EXTNAME", name)]
    for i, (k, form) in enumerate(zip(columns, forms), 1):
        head += [(f"TTYPE{i}", k), (f"TFORM{i}", form)]
    return _cards(head + list((cards or {}).items())) + _padded(rows.tobytes())


def units(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header and data of every unit of a file."""
    at = 0
    while at < len(raw):
        header, start = parse_header(raw[at:])
        dims = [header[f"NAXIS{i + 1}"] for i in range(header.get("NAXIS", 0))]
        if header.get("GROUPS") and dims and dims[0] == 0:
            dims = dims[1:]
        n = int(np.prod(dims, dtype=np.int64)) if dims else 0
        size = abs(header["BITPIX"]) // 8 * header.get("GCOUNT", 1) * (header.get("PCOUNT", 0) + n)
        yield header, raw[at + start : at + start + size]
        at += start + -(-size // BLOCK) * BLOCK


def decode_table(header: dict, data: bytes) -> np.ndarray:
    fields = []
    for i in range(1, header["TFIELDS"] + 1):
        form = header[f"TFORM{i}"].strip()
        letter, width = form[-1], int(form[:-1] or 1)
        kind = f"S{width}" if letter == "A" else LETTERS[letter]
        fields.append((header[f"TTYPE{i}"].strip(), kind) if letter == "A" or width == 1 else (header[f"TTYPE{i}"].strip(), kind, (width,)))
    return np.frombuffer(data, np.dtype(fields), header["NAXIS2"])


def encode_uvfits(u, v, w, baseline, date, re, im, weight, cards: dict | None = None) -> bytes:
    """Random groups of single-precision visibilities: arrays (n,) of parameters, and (n, channels) of data; times in days of two terms."""
    n, channels = np.shape(re)
    whole = np.floor(date)
    params = np.stack([u, v, w, baseline, whole, date - whole], 1).astype(">f4")
    values = np.stack([re, im, weight], -1).astype(">f4").reshape(n, -1)
    head = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 4), ("NAXIS1", 0), ("NAXIS2", 3), ("NAXIS3", 1), ("NAXIS4", channels), ("GROUPS", True), ("PCOUNT", 6), ("GCOUNT", n)]
    head += [("CTYPE2", "COMPLEX"), ("CTYPE3", "STOKES"), ("CTYPE4", "FREQ")]
    for i, name in enumerate(("UU", "VV", "WW", "BASELINE", "DATE", "DATE"), 1):
        head += [(f"PTYPE{i}", name), (f"PSCAL{i}", 1.0), (f"PZERO{i}", 0.0)]
    return _cards(head + list((cards or {}).items())) + _padded(np.concatenate((params, values), 1).astype(">f4").tobytes())


UV_SCHEMA = "file string, u double, v double, w double, ant1 int, ant2 int, date double, chan int, re double, im double, weight double"


def decode_uvfits(raw: bytes) -> pd.DataFrame:
    """A row a group and channel. Baselines are 256 * first antenna + second; parameters of one name are summed."""
    header, data = next(units(raw))
    count, params = header["GCOUNT"], header["PCOUNT"]
    channels = header["NAXIS4"]
    rows = np.frombuffer(data, ">f4").reshape(count, -1).astype(float)
    named: dict[str, np.ndarray] = {}
    for i in range(params):
        name = header[f"PTYPE{i + 1}"].strip().split("-")[0]
        value = rows[:, i] * header.get(f"PSCAL{i + 1}", 1.0) + header.get(f"PZERO{i + 1}", 0.0)
        named[name] = named[name] + value if name in named else value
    vis = rows[:, params:].reshape(count, channels, -1, 3)[:, :, 0]
    baseline = np.round(named["BASELINE"]).astype(int)
    each = lambda x: np.repeat(x, channels)
    return pd.DataFrame({
        "u": each(named["UU"]), "v": each(named["VV"]), "w": each(named["WW"]), "ant1": each(baseline // 256), "ant2": each(baseline % 256), "date": each(named["DATE"]),
        "chan": np.tile(np.arange(channels), count), "re": vis[..., 0].reshape(-1), "im": vis[..., 1].reshape(-1), "weight": vis[..., 2].reshape(-1),
    })


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")


def read_uvfits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Visibilities of UVFITS files, one task a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, raw in zip(frame["file"], frame["content"]):
                yield decode_uvfits(bytes(raw)).assign(file=f)[[c.strip().split()[0] for c in UV_SCHEMA.split(",")]].astype({"ant1": "int32", "ant2": "int32", "chan": "int32"})

    return _files(spark, paths).mapInPandas(run, UV_SCHEMA)


def read_table(spark: SparkSession, paths: str | list[str], name: str, schema: str) -> DataFrame:
    """A binary table of FITS files (as FITS-IDI keeps its visibilities), the columns of the schema, with the file's name."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, raw in zip(frame["file"], frame["content"]):
                for header, data in units(bytes(raw)):
                    if header.get("EXTNAME", "").strip() != name:
                        continue
                    t = decode_table(header, data)
                    yield pd.DataFrame({c: list(t[c].astype(float)) if t[c].ndim > 1 else t[c].astype(t[c].dtype.newbyteorder("=")) for c in columns}).assign(file=f)

    return _files(spark, paths).mapInPandas(run, f"{schema}, file string")


def list_fits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, unit, key, value) of every header of the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, raw in zip(frame["file"], frame["content"]):
                for i, (header, _) in enumerate(units(bytes(raw))):
                    yield pd.DataFrame([(f, i, k, str(v)) for k, v in header.items()], columns=["file", "unit", "key", "value"])

    return _files(spark, paths).mapInPandas(run, "file string, unit int, key string, value string")


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """Writes a file through the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def export_planes(image: DataFrame, path: str, shape: tuple[int, int], plane: str = "chan", value: str = "value", cards: dict | None = None) -> list[str]:
    """One FITS file a plane, pixels that are not there as NaN. A plane is made by one task and handed on by the driver,
    which holds one at a time."""
    nx, ny = shape

    def encode(p: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((ny, nx), np.nan)
        ok = p["x"].between(0, nx - 1) & p["y"].between(0, ny - 1)
        grid[p["y"][ok], p["x"][ok]] = p[value][ok]
        return pd.DataFrame({"plane": [str(p[plane].iloc[0])], "raw": [encode_image(grid.reshape(-1).tolist(), [nx, ny], cards)]})

    out = []
    for r in image.select("x", "y", plane, value).groupBy(plane).applyInPandas(encode, "plane string, raw binary").toLocalIterator():
        out.append(f"{path}/{r['plane']}.fits")
        write_bytes(image.sparkSession, out[-1], bytes(r["raw"]))
    return sorted(out)


def read_planes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, x, y, value) of image files, NaN pixels left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f, raw in zip(frame["file"], frame["content"]):
                header, data = next(units(bytes(raw)))
                kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[header["BITPIX"]]
                grid = np.frombuffer(data, kind).astype(float).reshape(header.get("NAXIS2", 1), header["NAXIS1"]) * header.get("BSCALE", 1) + header.get("BZERO", 0)
                y, x = np.nonzero(~np.isnan(grid))
                yield pd.DataFrame({"file": f, "x": x.astype("int32"), "y": y.astype("int32"), "value": grid[y, x]})

    return _files(spark, paths).mapInPandas(run, "file string, x int, y int, value double")


