"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, so punctuation and line breaks do not hide a
passage. A window of a document has as many words as the benchmark items it is held against. Windows that share no
five-word shingle with any item of their size have similarity zero and are skipped unhashed. The others get a 128-bit
SimHash of their pairs of adjacent words, and the index finds the items of that size whose fingerprints lie within
RADIUS: the 128 bits are BLOCKS blocks of 16, and of two fingerprints at most RADIUS apart one block at least is at most
NEAR_ITEM + NEAR_WINDOW apart (pigeonhole). Items stand in a block's table under all values within NEAR_ITEM bits of
their own, windows look up all values within NEAR_WINDOW bits of theirs, so none within RADIUS is missed, and of items
with unlike texts about one in twelve meets a window. Those within RADIUS are verified: the weighted or the plain Jaccard
similarity of the two multisets of shingles must reach the threshold; the greater one is told. A shingle weighs one over
the number of items of the whole benchmark that hold it; what the item does not hold weighs the mean of what it holds.

Of passages right at a threshold of 0.75, 99 in 100 lie within RADIUS (tests/llm measures it); unedited copies lie at 0.
Items of fewer than five words are one shingle and are looked up as they are.

Documents are only mapped, never shuffled or gathered. Up to SLICE items are broadcast at once, some 7 kB each. A larger
benchmark is searched slice by slice, and only in the documents that a filter of all items' shingles lets through. Ties:
of equally similar windows the first one is told.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import text as T
from .toxicity import _LETTERS

U = np.uint64
SHINGLE = 5
BLOCKS = 8  # of 16 bits
NEAR_ITEM, NEAR_WINDOW = 2, 1
RADIUS = BLOCKS * (NEAR_ITEM + NEAR_WINDOW + 1) - 1
SLICE = 4_000  # items broadcast at once
SLOTS = 22  # log2 of the slots of the first look-up of a shingle
FILTER = 27  # log2 of the bits of the filter of a benchmark of many slices: 16 MB, whatever its size
WINDOWS = 512  # looked up at once
BITS = np.arange(64, dtype=U)


def _flips(most: int) -> np.ndarray:
    """All 16-bit numbers of at most so many bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(16), k)], np.uint16)


ITEM_FLIPS, WINDOW_FLIPS = _flips(NEAR_ITEM), _flips(NEAR_WINDOW)


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 128 bits of each pair of adjacent words."""
    pair = T.mix(h[:-1] * T.COMBINE[1] + h[1:] * T.COMBINE[2])
    both = np.stack((pair, T.mix(pair + T.COMBINE[3])), 1)
    return ((both[:, :, None] >> BITS) & U(1)).astype(np.int8).reshape(len(pair), 128) * np.int8(2) - np.int8(1)


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as BLOCKS numbers of 16 bits, of sums of signs."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def _short(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words, as T.grams gives them to texts of m words."""
    k = len(h) - m + 1
    if k <= 0:
        return np.zeros(0, U)
    s = np.repeat(T.COMBINE[63:] * U(m), k)
    for j in range(m):
        s = s + h[j : j + k] * T.COMBINE[j]
    return T.mix(s)


class Items:
    """A slice of the benchmark, made ready for look-ups. `df`: of each item, shingles and how many items hold them, where more than one does."""

    def __init__(self, ids: list[int], texts: list[str], df: list[dict[int, int]]):
        self.ids = np.array(ids, np.int64)
        data, offs = T.buffers(pa.array(texts, pa.string()))
        h, _, _, self.words = T.words(_LETTERS[data], offs)
        g, n = T.grams(h, self.words, SHINGLE)
        ends, word_ends = np.cumsum(n), np.cumsum(self.words)
        own = T.owner(n)
        self.short = sorted({int(m) for m in self.words if 0 < m < SHINGLE})
        # the sizes of items that hold a shingle, and for short items the items themselves
        size = self.words[own]
        pair = np.unique(np.stack((g, size.astype(U)), 1), axis=0) if len(g) else np.zeros((0, 2), U)
        self.key, self.first, self.count = np.unique(pair[:, 0], return_index=True, return_counts=True)
        self.sizes = pair[:, 1].astype(np.int64)
        self.whole: dict[int, list[int]] = {}
        for i in np.flatnonzero((self.words > 0) & (self.words < SHINGLE)).tolist():
            self.whole.setdefault(int(g[ends[i] - 1]), []).append(i)
        self.seen = np.zeros(1 << SLOTS, bool)
        self.seen[(self.key >> U(64 - SLOTS)).astype(np.int64)] = True
        self.prints = np.zeros((len(ids), BLOCKS), np.uint16)
        self.values = []
        for i in range(len(ids)):
            c, k = np.unique(g[ends[i] - n[i] : ends[i]], return_counts=True)
            w = np.array([1 / df[i].get(x, 1) for x in c.view(np.int64).tolist()])
            self.values.append((c, k, w, float((k * w).sum() / max(1, k.sum()))))
            if self.words[i] >= SHINGLE:
                self.prints[i] = _prints(_signs(h[word_ends[i] - self.words[i] : word_ends[i]]).sum(0, dtype=np.int64)[None])[0]
        long = np.flatnonzero(self.words >= SHINGLE)
        self.index = []
        for b in range(BLOCKS):
            code = (self._named(self.words[long])[:, None] | (self.prints[long, b][:, None] ^ ITEM_FLIPS)).reshape(-1)
            order = np.argsort(code, kind="stable")
            self.index.append((code[order], np.repeat(long, len(ITEM_FLIPS))[order].astype(np.int32)))

    @staticmethod
    def _named(words: np.ndarray | int) -> np.ndarray:
        """The upper half of a table's keys: the size, as items of other sizes are not looked for."""
        return (np.asarray(words) & 0xFFFF).astype(np.uint32) << np.uint32(16)

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        at = np.flatnonzero(self.seen[(g >> U(64 - SLOTS)).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.key, g[at]), len(self.key) - 1)
        return at[self.key[k] == g[at]]

    def near(self, prints: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Windows and items of m words within RADIUS, each pair once, and how many pairs the tables gave."""
        met = []
        for b, (codes, items) in enumerate(self.index):
            code = (self._named(m) | (prints[:, b][:, None] ^ WINDOW_FLIPS)).reshape(-1)
            lo = np.searchsorted(codes, code, "left")
            some = np.flatnonzero((lo < len(codes)) & (codes[np.minimum(lo, len(codes) - 1)] == code)) if len(codes) else np.zeros(0, np.int64)
            lo, hi = lo[some], np.searchsorted(codes, code[some], "right")
            n = hi - lo
            window = np.repeat(some // len(WINDOW_FLIPS), n)
            item = items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            met.append(np.unique(window * len(self.ids) + item))
        code = np.unique(np.concatenate(met))
        window, item = code // len(self.ids), code % len(self.ids)
        ok = (_apart(prints[window], self.prints[item]) <= RADIUS) & (self.words[item] == m)
        return window[ok], item[ok], len(code)

    def similarity(self, g: np.ndarray, item: int) -> float:
        c, k = np.unique(g, return_counts=True)
        ic, ik, iw, mean = self.values[item]
        at = np.minimum(np.searchsorted(ic, c), len(ic) - 1)
        met = ic[at] == c
        shared, strange = np.minimum(k[met], ik[at[met]]), int(k[~met].sum())
        most = ik.copy()
        most[at[met]] = np.maximum(k[met], ik[at[met]])
        plain = float(shared.sum()) / (float(most.sum()) + strange)
        weighted = float((shared * iw[at[met]]).sum()) / (float((most * iw).sum()) + strange * mean)
        return max(plain, weighted)

    def search(self, h: np.ndarray, g: np.ndarray, num: int, den: int) -> dict[int, tuple[float, int, int]]:
        """Of one document: item -> (similarity, first word, words) of its best window."""
        best: dict[int, tuple[float, int, int]] = {}

        def offer(item: int, s: float, start: int, m: int) -> None:
            if den * s >= num - 1e-9 and (item not in best or (s, -start) > (best[item][0], -best[item][1])):
                best[item] = (s, start, m)

        for m in self.short:
            r = _short(h, m)
            for p in self.hits(r):
                for i in self.whole.get(int(r[p]), ()):
                    if self.words[i] == m:
                        offer(i, 1.0, int(p), m)
        if len(h) < SHINGLE:
            return best
        at = self.hits(g)
        if not len(at):
            return best
        k = np.searchsorted(self.key, g[at])
        n = self.count[k]
        sizes = self.sizes[np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        place = np.repeat(at, n)
        for m in np.unique(sizes).tolist():
            if m < SHINGLE:
                continue
            size = min(m, len(h)) - SHINGLE + 1  # shingles of a window
            last = len(g) - size
            marks = np.zeros(last + 2, np.int64)
            p = place[sizes == m]
            np.add.at(marks, np.clip(p - size + 1, 0, last), 1)
            np.add.at(marks, np.minimum(p, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            pairs = size + SHINGLE - 2
            lo = 0
            while lo < len(starts):  # runs of windows, so that their sums stay small
                hi = min(lo + WINDOWS, int(np.searchsorted(starts, starts[lo] + 4 * WINDOWS)))
                some = starts[lo:hi]
                lo, a = hi, int(some[0])
                run = np.zeros((int(some[-1]) - a + pairs + 1, 128), np.int32)
                np.cumsum(_signs(h[a : int(some[-1]) + pairs + 1]), 0, dtype=np.int32, out=run[1:])
                window, item, _ = self.near(_prints(run[some - a + pairs] - run[some - a]), m)
                for x, i in zip(window.tolist(), item.tolist()):
                    s = int(some[x])
                    offer(i, self.similarity(g[s : s + size], i), s, min(m, len(h)))
        return best


def _found(part: Items, data: np.ndarray, offs: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, float, int, int]]:
    h, _, _, counts = T.words(_LETTERS[data], offs)
    g, n = T.grams(h, counts, SHINGLE)
    docs = set(np.searchsorted(np.cumsum(n), part.hits(g), "right").tolist())
    if part.short:
        ends = np.cumsum(counts)
        for m in part.short:
            r = part.hits(_short(h, m))
            d = np.searchsorted(ends, r, "right")
            docs.update(d[r + m <= ends[d]].tolist())
    hw, gw = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(n)))
    for d in sorted(docs):
        for i, (s, start, m) in sorted(part.search(h[hw[d] : hw[d + 1]], g[gw[d] : gw[d + 1]], num, den).items()):
            yield d, int(part.ids[i]), s, start, m


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, t, m, g): the distinct shingles of every text, t a hash of it and m its words."""
    for batch in batches:
        for lo, hi, data, offs in T.pieces(batch.column(2)):
            h, _, _, words = T.words(_LETTERS[data], offs)
            g, n = T.sets(*T.grams(h, words, SHINGLE))
            own = T.owner(n)
            took = pa.array(own + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(words[own]), pa.array(g.view(np.int64))], ["item_id", "t", "m", "g"])


class Benchmark:
    """The items, with what the whole benchmark says about their shingles. A null or wordless text is in no document."""

    def __init__(self, benchmark: DataFrame):
        self.spark = benchmark.sparkSession
        self.scratch = Scratch(self.spark, "benchmark")
        items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("t"), "text").distinct()
        items = self.scratch.save(items)
        self.shingles = self.scratch.save(items.mapInArrow(T.tidily(_shingles), "item_id long, t long, m long, g long"))
        often = self.shingles.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
        df = self.shingles.join(often, "g").groupBy("item_id", "t").agg(F.collect_list(F.struct("g", "n")).alias("df"))
        self.items = self.scratch.save(items.join(df, ["item_id", "t"], "left"))
        self.many = self.items.count()

    def slices(self) -> Iterator[Broadcast]:
        """Slice after slice, each held by the driver only while it is made; the first one is there even if it is empty."""
        ids, texts, df, none = [], [], [], True
        for r in self.items.orderBy("item_id", "text").toLocalIterator():
            ids.append(r["item_id"])
            texts.append(r["text"])
            df.append({x["g"]: x["n"] for x in r["df"] or ()})
            if len(ids) == SLICE:
                yield self.spark.sparkContext.broadcast(Items(ids, texts, df))
                ids, texts, df, none = [], [], [], False
        if ids or none:
            yield self.spark.sparkContext.broadcast(Items(ids, texts, df))

    def touched(self, docs: DataFrame, name: str) -> DataFrame:
        """docs, saved, with a column of this name: whether a document may hold a shingle of some item."""
        low = (1 << FILTER) - 1
        bit = self.shingles.select(F.expr(f"g & {low}L").alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w"))
        filled = bit.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
        table = np.zeros(1 << (FILTER - 6), U)
        table[filled["w"].to_numpy()] = filled["m"].to_numpy().view(U)
        short = [r["m"] for r in self.shingles.where(f"m < {SHINGLE}").select("m").distinct().collect()]
        held, at = self.spark.sparkContext.broadcast(table), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = held.value

            def inside(g: np.ndarray) -> np.ndarray:
                b = g & U(low)
                return np.flatnonzero((bits[(b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1))

            for batch in batches:
                flag = np.zeros(batch.num_rows, bool)
                for lo, _, data, offs in T.pieces(batch.column(at)):
                    h, _, _, counts = T.words(_LETTERS[data], offs)
                    g, n = T.grams(h, counts, SHINGLE)
                    flag[lo + np.searchsorted(np.cumsum(n), inside(g), "right")] = True
                    for m in short:  # a run may reach into the next text: that one text too many is searched
                        flag[lo + np.searchsorted(np.cumsum(counts), inside(_short(h, m)), "right")] = True
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag)], [*batch.schema.names, name])

        out = self.scratch.save(docs.mapInArrow(T.tidily(run), docs.select("*", F.lit(True).alias(name)).schema))
        held.destroy()
        return out


def find_passages(docs: DataFrame, benchmark: DataFrame, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every document for every item it holds.

    Documents that hold none have no row; a null or blank text holds none, and neither does any text of an empty
    table or under an empty benchmark. A row that repeats, or an id that does, gives rows for each of its texts. Extra
    columns are not read.
    """
    num, den = threshold
    bench = Benchmark(benchmark)
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if bench.many > SLICE:
        rows = bench.touched(rows, "touched").where("touched").select("doc_id", "text")
    out = None
    for held in bench.slices():

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                found: list[tuple] = []
                for lo, _, data, offs in T.pieces(batch.column(1)):
                    found += [(ids[lo + d], i, s, a, m) for d, i, s, a, m in _found(held.value, data, offs, num, den)]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        part = rows.mapInArrow(T.tidily(run), schema)
        if bench.many > SLICE:  # one slice at a time
            part = bench.scratch.save(part)
            held.destroy()
        out = part if out is None else out.union(part)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item. Null and blank texts stay, and so do repeated rows."""
    num, den = threshold
    bench = Benchmark(benchmark)
    at = docs.columns.index("text")
    name = "_".join(docs.columns) + "_"  # a name that docs does not have
    left, apart = docs, None
    if bench.many > SLICE:
        flagged = bench.touched(docs, name)
        left, apart = flagged.where(F.col(name)).drop(name), flagged.where(~F.col(name)).drop(name)
    for held in bench.slices():

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offs in T.pieces(batch.column(at)):
                    for d, *_ in _found(held.value, data, offs, num, den):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        before, left = left, left.mapInArrow(T.tidily(run), docs.schema)
        if apart is not None:
            left = bench.scratch.save(left)
            bench.scratch.drop(before)
            held.destroy()
    return left if apart is None else apart.unionByName(left)
