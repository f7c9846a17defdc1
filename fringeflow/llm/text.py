"""Vectorised words, hashes and shingles over the raw UTF-8 buffers of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A-Z are lower-cased; other bytes stay as they are.
A word's 64-bit hash takes its bytes eight at a time, each eight mixed before the next ones enter, so there is no
algebra between a word and its hash that makes families of words collide; what is left are chance collisions, of odds
n ** 2 / 2 ** 65 among n different words. Words of up to SHORT bytes are hashed in bulk, longer ones by BLAKE2.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20  # bytes of text handled at once: keeps the 8-byte work arrays small
SHORT = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] = FOLD[97:123]
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64, n, dtype=U) | U(1)


COMBINE = _random(64, 77)
LENGTH, ROUND = _random(2, 20240611)


def tidily(run: Callable) -> Callable:
    """A map over batches that hands freed memory back to the system when its task ends, as workers live on."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, offs = buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, min(n, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of every word, and the number of words of every text."""
    n, texts = len(data), len(offs) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(texts, np.int64)
    blank = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[0] = after[-1] = True
    filled = offs[:-1] < offs[1:]
    before[offs[:-1][filled]] = True
    after[offs[1:][filled] - 1] = True
    np.logical_not(blank, out=blank)
    start, last = np.flatnonzero(blank & before), np.flatnonzero(blank & after)
    return start, last + 1, np.diff(np.searchsorted(start, offs))


class Bytes:
    """Bytes, lower-cased or as they are, of which any eight can be read as one number."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        self.data = np.zeros(len(data) + 8, np.uint8)
        self.data[: len(data)] = FOLD[data] if fold else data
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.data.data, 0, (1,))

    def lane(self, start: np.ndarray, n: np.ndarray, j: int) -> np.ndarray:
        """The j-th eight bytes of spans of n bytes, zeros beyond their ends."""
        return self.eights[start + 8 * j] & MASK[np.clip(n - 8 * j, 0, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end), none of them empty."""
        n = end - start
        h = (n.astype(U) * LENGTH) ^ self.lane(start, n, 0)
        h *= ROUND
        h ^= h >> U(32)
        for j in range(1, SHORT // 8):
            at = np.flatnonzero(n > 8 * j)
            if not len(at):
                break
            x = h[at] ^ self.lane(start[at], n[at], j)
            x *= ROUND
            x ^= x >> U(32)
            h[at] = x
        for i in np.flatnonzero(n > SHORT).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte of every word, and the number of words of every text."""
    start, end, counts = bounds(data, offs)
    if not len(start):
        return np.zeros(0, U), start, end, counts
    return Bytes(data).hashes(start, end), start, end, counts


def owner(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


def grams(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and their number.

    A text of 1 to k-1 words has one shingle, its whole sequence; a text without words has none.
    """
    ends = np.cumsum(counts)
    long = counts >= k
    out_counts = np.where(long, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(out_counts.sum()), U)
    if long.any():
        m = len(h) - k + 1
        s = np.repeat(COMBINE[63:] * U(k), m)
        for j in range(k):
            s += h[j : j + m] * COMBINE[j]
        own = owner(counts)
        out[np.repeat(long, out_counts)] = mix(s)[own[:m] == own[k - 1 :]]
    at = np.cumsum(out_counts) - 1
    for i in np.flatnonzero((counts > 0) & ~long):
        w = h[ends[i] - counts[i] : ends[i]]
        s = COMBINE[63:] * U(len(w)) + (w * COMBINE[: len(w)]).sum(dtype=U, keepdims=True)
        out[at[i]] = mix(s)[0]
    return out, out_counts


def sets(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, and their number."""
    if not len(tokens):
        return tokens, counts
    ends = np.cumsum(counts)
    lo = 0
    tokens = tokens.copy()
    for hi in ends.tolist():
        tokens[lo:hi].sort()
        lo = hi
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[(ends - counts)[counts > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return tokens[keep], kept[ends] - kept[ends - counts]


def set_key(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's set of tokens; order does not matter."""
    key, check = np.zeros(len(counts), U), np.zeros(len(counts), U)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        key[some] = np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), starts)
        check[some] = np.add.reduceat(tokens, starts)
    return mix(key + counts.astype(U)), mix(check)
