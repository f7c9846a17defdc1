"""FITS images as a Python data source: `spark.read.format("fitsimage").load(path)` and the writer for small planes."""

from __future__ import annotations

import math
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CARD, BLOCK = 80, 2880
KINDS = {8: ("B", 1), 16: ("h", 2), 32: ("i", 4), 64: ("q", 8), -32: ("f", 4), -64: ("d", 8)}


def parse_header(raw: bytes) -> tuple[dict, int]:
    """Keywords and the offset of the data."""
    header, at = {}, 0
    while True:
        card = raw[at : at + CARD].decode("ascii", "replace")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            return header, -(-at // BLOCK) * BLOCK
        if card[8:10] == "= ":
            value = card[10:].split("/")[0].strip() if "'" not in card else card[10:].split("'")[1].strip()
            if "'" in card:
                header[key] = value
            elif value in "TF":
                header[key] = value == "T"
            else:
                header[key] = float(value) if any(c in value for c in ".EeDd") else int(value)
        if at >= len(raw):
            raise ValueError("no END card")


def encode_image(values: list[float], shape: list[int], cards: dict | None = None) -> bytes:
    """A primary image of doubles, the first axis running fastest."""
    rows = [("SIMPLE", "T"), ("BITPIX", "-64"), ("NAXIS", str(len(shape)))] + [(f"NAXIS{i + 1}", str(n)) for i, n in enumerate(shape)]
    rows += [(k, f"'{v}'" if isinstance(v, str) else str(v)) for k, v in (cards or {}).items()]
    head = "".join(f"{k:<8}= {v:>20}".ljust(CARD) for k, v in rows) + "END".ljust(CARD)
    data = struct.pack(f">{len(values)}d", *values)
    return head.encode().ljust(-(-len(head) // BLOCK) * BLOCK) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    """Each task reads its own run of pixels; the file has to be on a path that all executors see."""

    def __init__(self, path: str, slices: int):
        self.path, self.slices = path.removeprefix("file://"), slices
        with open(self.path, "rb") as f:
            raw = f.read(BLOCK)
            while b"END".ljust(8) not in raw[-BLOCK:] and len(raw) < 100 * BLOCK:
                raw += f.read(BLOCK)
        self.header, self.start = parse_header(raw)
        self.shape = [self.header[f"NAXIS{i + 1}"] for i in range(self.header["NAXIS"])]

    def partitions(self):
        n = math.prod(self.shape)
        step = max(1, -(-n // self.slices))
        return [_Slice(a, min(a + step, n)) for a in range(0, n, step)]

    def read(self, partition):
        kind, size = KINDS[self.header["BITPIX"]]
        scale, zero = self.header.get("BSCALE", 1), self.header.get("BZERO", 0)
        with open(self.path, "rb") as f:
            f.seek(self.start + partition.lo * size)
            raw = f.read((partition.hi - partition.lo) * size)
        shape = (self.shape + [1, 1, 1, 1])[:4]
        for i, v in enumerate(struct.unpack(f">{partition.hi - partition.lo}{kind}", raw), partition.lo):
            at = []
            for n in shape:
                at.append(i % n)
                i //= n
            yield (*at, float(v) * scale + zero, v == v)


class FitsImage(DataSource):
    @classmethod
    def name(cls):
        return "fitsimage"

    def schema(self):
        return "x int, y int, chan int, stokes int, value double, mask boolean"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("slices", "8")))
