"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their sets of word shingles reaches the threshold. Tokens are ordered
by estimated document frequency, rare first. With c = ceil(t * n), the prefix of n - c + l tokens of two linked sets
shares at least l tokens, for any l up to c. Every text picks its own l: a longer prefix costs more postings but
asks more shared tokens of a candidate, and the estimated candidate cost decides. A pair is held to the smaller of
its two l, counted over the tokens that both prefixes of that length hold.

How it stays linear under hot groups:

- Texts with equal sets are one class from the start, in each task before anything is shuffled. A class is named by a
  64-bit hash of its set; a second one, kept beside it, shows where two sets share a name, and gives one of them another.
- Postings travel as packed arrays, a few bytes each, dealt by token. Those of tokens that some 2 ** HOT or more texts
  are estimated to hold are members of a large bucket from the start and are dealt evenly, not by token.
- Small buckets (texts that share a prefix token) yield all their pairs. In a large bucket every text first meets a
  few pivots; verified links merge classes into components, and only texts that are still in different components
  meet more pivots. The last round has no limit, so no link between components can be missed; inside a component
  further links change nothing. A bucket's members are dealt over groups of DEALT, each of which meets all pivots.
- A pair whose parity bitmaps (512 bits, or one for each token) differ in more places than the sets of a link can have
  tokens apart is dropped unread. The others are verified exactly on whole sets, which only the texts in such pairs send; a pivot's
  set is sent once for some thousand members.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import text as T
from .components import components

U = np.uint64
SKETCH = 22  # log2 of the counters of the frequency sketch: 16 MB, and 4 MB as classes, whatever the input
BLOCKS = 64
BITS = (26, 30)  # log2 of the bits of the filter of texts to compare: 8 MB, and up to 128 MB for 2 ** 26 classes and more
HOT = 14
DEALT = 2000
FEW = 500_000  # buckets, of 24 bytes each, up to which their table is broadcast
SMALL = 8  # a bucket of so many texts yields all pairs at once
ROUNDS = (8, 128)  # members of a large bucket that the others meet before the unlimited round
PER_PIVOT = 2000
LANES = 8  # 64-bit words of a set's parity bitmap
LANE_NAMES = [f"s{j}" for j in range(LANES)]
UNSEEN = 0.1  # further texts expected to hold a token whose frequency does not stand out


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -((-num * n) // den)


class Names:
    """Names of classes: the first hash of a set, or the second one where two sets were found to share the first."""

    def __init__(self, bits: int = 64, keys: np.ndarray = np.zeros(0, U), kept: np.ndarray = np.zeros(0, U)):
        self.mask, self.keys, self.kept = U((1 << bits) - 1), keys, kept

    def both(self, tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, check = T.set_key(tok, n)
        return key & self.mask, check

    def __call__(self, tok: np.ndarray, n: np.ndarray) -> np.ndarray:
        key, check = self.both(tok, n)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            key = np.where((self.keys[at] == key) & (self.kept[at] != check), check, key)
        return key


def _digest(shingle: int, names: Names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.uint32)
        seen = np.zeros(0, U)
        columns = ["doc_id", "h", "n", "key", "chk", *LANE_NAMES, "fine", "blk", "blob"]
        for batch in batches:
            ids, col, h64 = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, data, offs in T.pieces(col):
                h, _, _, c = T.words(data, offs)
                tok, n = T.sets(*T.grams(h, c, shingle))
                key, check = names.both(tok, n)
                new = _fresh(check, seen)
                np.add.at(counts, (tok[np.repeat(new, n)] >> U(64 - SKETCH)).astype(np.int64), 1)
                seen = _remember(seen, check[new])
                marks = (pa.array(x) for x in _parity(tok, n))
                told = [ids.slice(lo, hi - lo), h64.slice(lo, hi - lo), pa.array(n), pa.array(key.view(np.int64)), pa.array(check.view(np.int64))]
                rows = [*told, *marks, pa.array(_fine(tok, n), pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, columns)
        if counts.any():
            none = pa.nulls(BLOCKS, pa.int64())
            blobs = pa.array([zlib.compress(p.tobytes(), 1) for p in counts.reshape(BLOCKS, -1)], pa.binary())
            yield pa.RecordBatch.from_arrays([none] * (5 + LANES) + [pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()), blobs], columns)

    return T.tidily(run)


def _parity(tok: np.ndarray, n: np.ndarray) -> np.ndarray:
    """LANES rows of 64-bit words: per set, the parities of its tokens' numbers in 64 * LANES hashed places."""
    width = 64 * LANES
    out = np.zeros((len(n), LANES), np.int64)
    ends = np.cumsum(n)
    for lo in range(0, len(n), 256):
        hi = min(lo + 256, len(n))
        t = tok[ends[lo] - n[lo] : ends[hi - 1]]
        odd = np.bincount(T.owner(n[lo:hi]) * width + (t >> U(11)).astype(np.int64) % width, minlength=(hi - lo) * width) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, LANES)
    return out.T.copy()


def _fine(tok: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """For sets beyond 512 tokens a parity bitmap of as many bits, up to a power of two; shorter ones fold out of it."""
    out: list[bytes | None] = [None] * len(n)
    ends = np.cumsum(n)
    for i in np.flatnonzero(n > 64 * LANES):
        width = 1 << int(n[i] - 1).bit_length()
        odd = np.bincount((tok[ends[i] - n[i] : ends[i]] >> U(11)).astype(np.int64) & (width - 1), minlength=width) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return out


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _fresh(key: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of each key the first, unless this task has met it before."""
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    if len(seen):
        at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
        new &= seen[at] != key
    return new


def _remember(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A task forgets after a million keys: then a copy may be posted twice, which costs time, not links."""
    return np.sort(keys) if len(seen) > 1_000_000 else np.sort(np.concatenate((seen, keys)))


def _sum_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), np.uint32).astype(np.int64) for b in rows["blob"])
    return pd.DataFrame({"blk": [int(rows["blk"].iloc[0])], "blob": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """log2 of the estimated document frequency of each counter's tokens, above what chance puts into a counter."""
    mean = counts.mean()
    extra = counts - mean
    sure = extra > 4 * np.sqrt(mean) + 4
    return np.where(sure, np.log2(np.maximum(extra, 1.0)).astype(np.int64) + 1, 0).astype(np.uint8)


def choose_length(met: np.ndarray, n: int, c: int) -> int:
    """The l of least estimated cost: posting the prefix, then comparing whole sets.

    met: running sum of the further texts that are expected to hold the tokens, in prefix order. Texts that share l
    of the prefix's tokens are at most that sum divided by l.
    """
    base = n - c
    best, least = 1, None
    el, most = 1, min(c, 4 + n // 64)
    while el <= most:
        many = met[base + el - 1]
        cost = base + el + many + many / el * (0.05 * n + 5)
        if least is None or cost < least:
            best, least = el, cost
        el += 1 + el // 4
    return best


def _postings(shingle: int, num: int, den: int, parts: int, classes, names: Names, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = classes.value
        first_part = 7919 * TaskContext.get().partitionId()
        seen = np.zeros(0, U)
        usual: dict[int, int] = {}  # by size, where no token's frequency stands out
        held: list[np.ndarray] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, turn
            if held:
                code, key, n, at, el = (np.concatenate([h[j] for h in held]) for j in range(5))
                level, tok = (code >> U(58)).astype(np.uint8), code & U((1 << 58) - 1)
                often = np.flatnonzero(level >= hot)
                for a in range(0, len(often), 100_000):  # dealt evenly
                    some = often[a : a + 100_000]
                    blob = pack(HOT_KINDS, tok[some], key[some], n[some], at[some], el[some], level[some])
                    turn += 1
                    yield pa.RecordBatch.from_arrays([pa.array([(first_part + turn) % parts], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])
                rest = level < hot
                tok, key, n, at, el = tok[rest], key[rest], n[rest], at[rest], el[rest]
                part = (tok % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part = part[order]
                tok, key, n, at, el = ((tok // U(parts)).astype(np.uint32)[order], key[order], n[order], at[order], el[order])
                ids, first = np.unique(part, return_index=True)
                blobs = [pack(KINDS, tok[a:b], key[a:b], n[a:b], at[a:b], el[a:b]) for a, b in zip(first, [*first[1:], len(part)])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])
            held, size = [], 0

        for batch in batches:
            for _, _, data, offs in T.pieces(batch.column(0)):
                h, _, _, cnt = T.words(data, offs)
                tok, n = T.sets(*T.grams(h, cnt, shingle))
                key = names(tok, n)
                new = _fresh(key, seen) & (n > 0)
                seen = _remember(seen, key[new])
                f = cls[(tok >> U(64 - SKETCH)).astype(np.int64)].astype(U)
                code = (f << U(58)) | (tok >> U(6))
                ends = np.cumsum(n)
                need = _need(n, num, den)
                take = np.zeros(len(tok), bool)
                place = np.zeros(len(tok), np.uint32)
                el = np.ones(len(n), np.uint16)
                for i in np.flatnonzero(new):
                    a, b = int(ends[i] - n[i]), int(ends[i])
                    s = code[a:b]
                    s.sort()
                    size_i, c = b - a, int(need[i])
                    base = size_i - c
                    reach = s[: min(size_i, base + 4 + size_i // 64)]
                    if int(reach[-1] >> U(58)):
                        el[i] = choose_length(np.cumsum(np.maximum(np.exp2((reach >> U(58)).astype(np.float64)) - 1, UNSEEN)), size_i, c)
                    else:
                        if size_i not in usual:
                            usual[size_i] = choose_length(UNSEEN * np.arange(1, size_i + 1), size_i, c)
                        el[i] = usual[size_i]
                    p = base + int(el[i])
                    take[a : a + p] = True
                    place[a : a + p] = np.arange(p)
                own = T.owner(n)[take]
                got = code[take]
                held.append((got, key[own], np.minimum(n[own], 2**32 - 1).astype(np.uint32), place[take], el[own]))
                size += len(got)
                if size > 2_000_000:
                    yield from flush()
        yield from flush()

    return T.tidily(run)


KINDS = (np.uint32, U, np.uint32, np.uint32, np.uint16)  # token, class, set size, place of the token, l
HOT_KINDS = (U, *KINDS[1:], np.uint8)  # whole token; and the class of its frequency


def pack(kinds: tuple, *columns: np.ndarray) -> bytes:
    return b"".join((np.array([len(kinds), len(columns[0])], np.uint32).tobytes(), *(c.astype(k, copy=False).tobytes() for k, c in zip(kinds, columns))))


def is_hot(blob: bytes) -> bool:
    return int(np.frombuffer(blob, np.uint32, 1)[0]) == len(HOT_KINDS)


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    kinds, m = (HOT_KINDS if is_hot(blob) else KINDS), int(np.frombuffer(blob, np.uint32, 1, 4)[0])
    at = 8
    out = []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, m, at))
        at += m * np.dtype(kind).itemsize
    return tuple(out)


def _may_link(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, el: np.ndarray, em: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m tokens that share the tokens at places p and q can still link by them.

    Sizes must be close, the token must lie in both prefixes of the smaller l, and, were it the l-th or an earlier
    shared token, what follows it in both sets must be enough for the rest of the intersection.
    """
    need = np.minimum(el, em).astype(np.int64)
    n, m, p, q = (x.astype(np.int64) for x in (n, m, p, q))
    inside = (p < n - _need(n, num, den) + need) & (q < m - _need(m, num, den) + need)
    rest = np.minimum(n - p, m - q) - 1
    return inside & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & ((need + rest) * (num + den) >= num * (n + m))


def _may_link_sql(a: str, b: str, num: int, den: int) -> str:
    """The same of columns n, p, l with these prefixes."""
    inside = " AND ".join(f"{x}p < {x}n + floor(-{num} * {x}n / {den}) + least({a}l, {b}l)" for x in (a, b))
    return (
        f"{den} * least({a}n, {b}n) >= {num} * greatest({a}n, {b}n) AND {inside} AND "
        f"(least({a}l, {b}l) + least({a}n - {a}p, {b}n - {b}p) - 1) * {num + den} >= {num} * ({a}n + {b}n)"
    )


def _buckets(num: int, den: int, parts: int):
    """Of one part: pairs of small buckets with counts (kind 0), and the members of large ones with size and rank (kind 1;
    kind 2 where the token is a hot one: its size and ranks are estimates, and members may repeat)."""
    schema = ["kind", "x", "y", "nx", "ny", "c", "need"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        out: list[tuple[np.ndarray, ...]] = []
        plain = [b for b in rows["blob"] if not is_hot(b)]
        for tok, key, n, at, el, level in (unpack(b) for b in rows["blob"] if is_hot(b)):
            m, shift = len(tok), U(64) - level.astype(U)
            rank = (T.mix(key) >> shift).astype(np.int64)
            out.append((np.full(m, 2), T.mix(tok) >> U(1), key, np.left_shift(1, level.astype(np.int64)), n, at.astype(np.int64) * 65536 + el, rank))
        tok, key, n, at, el = (np.concatenate(x) for x in zip(*map(unpack, plain))) if plain else (np.zeros(0, k) for k in KINDS)
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        again = tok[1:] == tok[:-1]
        multi = np.zeros(len(tok), bool)
        multi[1:] |= again
        multi[:-1] |= again
        order, tok = order[multi], tok[multi]
        key, n, at, el = key[order], n[order], at[order], el[order]
        order = np.lexsort((key, tok))
        tok, key, n, at, el = tok[order], key[order], n[order], at[order], el[order]
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
        tok, key, n, at, el = tok[first], key[first], n[first], at[first], el[first]
        starts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(tok)))

        def pairs(i: np.ndarray, j: np.ndarray) -> None:
            ok = _may_link(n[i], n[j], at[i], at[j], el[i], el[j], num, den)
            i, j = i[ok], j[ok]
            need = np.minimum(el[i], el[j])
            out.append((np.zeros(len(i)), key[i], key[j], n[i], n[j], np.ones(len(i)), need))

        for size in range(2, SMALL + 1):
            s = starts[sizes == size]
            for p in range(size):
                for q in range(p + 1, size):
                    pairs(s + p, s + q)
        order_key = T.mix(key)
        for b in np.flatnonzero(sizes > SMALL):
            lo, hi = int(starts[b]), int(starts[b] + sizes[b])
            m = hi - lo
            rank = np.empty(m, np.int64)
            rank[np.argsort(order_key[lo:hi])] = np.arange(m)
            bucket = int(T.mix(np.array([int(tok[lo]) * parts + part], U))[0]) >> 1
            out.append((np.ones(m), np.full(m, bucket, U), key[lo:hi], np.full(m, m), n[lo:hi], at[lo:hi].astype(np.int64) * 65536 + el[lo:hi], rank))
        if not out:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in schema})
        kind, x, y, nx, ny, c, need = (np.concatenate([o[j] for o in out]).astype(U if j in (1, 2) else np.int64) for j in range(7))
        x, y = x.view(np.int64), y.view(np.int64)
        swap = (kind == 0) & (x > y)
        x, y, nx, ny = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)
        df = pd.DataFrame({"kind": kind, "x": x, "y": y, "nx": nx, "ny": ny, "c": c, "need": need})
        some = df["kind"] == 0
        met = df[some].groupby(["kind", "x", "y", "nx", "ny", "need"], as_index=False)["c"].sum()
        return pd.concat((met[schema], df[~some]), ignore_index=True)

    return run


def _members(shingle: int, bits, names: Names):
    """(key, packed sorted tokens) of the texts whose key's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        low = U(64 * len(table) - 1)
        seen = np.zeros(0, U)
        for batch in batches:
            for _, _, data, offs in T.pieces(batch.column(0)):
                h, _, _, cnt = T.words(data, offs)
                tok, n = T.sets(*T.grams(h, cnt, shingle))
                key = names(tok, n)
                b = key & low
                met = (table[(b >> U(6)).astype(np.int64)] >> (b & U(63))) & U(1) == U(1)
                new = _fresh(key, seen) & (n > 0) & met
                seen = _remember(seen, key[new])
                ends = np.cumsum(n)
                rows = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rows].view(np.int64)), pa.array([tok[ends[i] - n[i] : ends[i]].tobytes() for i in rows], pa.binary())], ["key", "toks"]
                )

    return T.tidily(run)


def _verify_run(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, last = None, None, None
        for batch in batches:
            a, s, role, b, toks = (batch.column(i) for i in range(5))
            a, s, role, b = a.to_numpy(), s.to_numpy(), role.to_numpy(), b.to_numpy(zero_copy_only=False)
            u, v = [], []
            for i in range(len(a)):
                t = np.frombuffer(toks[i].as_buffer(), U)
                if role[i] == 0:
                    at, mine, last = (a[i], s[i]), t.copy(), None
                elif at == (a[i], s[i]) and last != b[i]:
                    last = b[i]
                    small, big = (t, mine) if len(t) < len(mine) else (mine, t)
                    p = np.searchsorted(big, small)
                    p[p == len(big)] = 0
                    both = int((big[p] == small).sum())
                    if den * both >= num * (len(t) + len(mine) - both):
                        u.append(a[i])
                        v.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return T.tidily(run)


def _apart(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in LANE_NAMES)


def _close_run(num: int, den: int):
    """Drops pairs whose fine bitmaps, folded to the shorter one's size, differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(np.asarray(batch.column(4).is_valid()) & np.asarray(batch.column(5).is_valid())):
                a, b = (np.frombuffer(batch.column(j)[i].as_buffer(), np.uint8) for j in (4, 5))
                size = min(len(a), len(b))
                apart = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
                keep[i] = (int(n[i] + m[i]) - apart) * (num + den) >= 2 * num * int(n[i] + m[i])
            yield batch.select([0, 1]).filter(pa.array(keep))

    return T.tidily(run)


class Verifier:
    """Tells which candidate pairs link: first by bitmaps, then exactly, on the sets of the texts that are left."""

    def __init__(self, scratch: Scratch, texts: DataFrame, classes: DataFrame, many: int, shingle: int, num: int, den: int, names: Names):
        self.scratch, self.texts, self.classes, self.shingle, self.num, self.den, self.names = scratch, texts, classes, shingle, num, den, names
        self.bits = min(max(BITS[0], many.bit_length() + 4), BITS[1])

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The linked of the pairs (x, y), as (u, v); None where no pair is left to compare."""
        num, den = self.num, self.den
        one = {
            p: self.classes.select(F.col("key").alias(k), F.col("n").alias(p + "n"), *(F.col(c).alias(p + c) for c in (*LANE_NAMES, "fine")))
            for p, k in (("a_", "x"), ("b_", "y"))
        }
        close = f"(a_n + b_n - ({_apart('a_', 'b_')})) * {num + den} >= {2 * num} * (a_n + b_n)"
        left = pairs.distinct().join(one["a_"], "x").join(one["b_"], "y").where(close)
        left = self.scratch.save(left.select("x", "y", "a_n", "b_n", "a_fine", "b_fine").mapInArrow(_close_run(num, den), "x long, y long"))
        keys = left.select(F.col("x").alias("key")).union(left.select(F.col("y").alias("key")))
        bit = keys.select(F.expr(f"key & {(1 << self.bits) - 1}L").alias("b"))
        filled = bit.groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
        if not filled.num_rows:
            return None
        table = np.zeros(1 << (self.bits - 6), U)
        table[filled["w"].to_numpy()] = filled["m"].to_numpy().view(U)
        bits = self.texts.sparkSession.sparkContext.broadcast(table)
        # each task sends a class once; all but one of them go where the join's own shuffle and sort have put them
        sets = self.texts.mapInArrow(_members(self.shingle, bits, self.names), "key long, toks binary")
        sets = sets.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1").select("key", "toks")
        # a pivot with many partners is dealt over several groups
        many = left.groupBy("x").agg(F.ceil(F.count("*") / PER_PIVOT).alias("k"))
        dealt = left.join(many, "x").select(F.col("x").alias("a"), F.col("y").alias("b"), F.pmod(F.xxhash64("y"), F.col("k")).alias("s"))
        members = dealt.select("a", "s", F.lit(1).alias("role"), "b", F.col("b").alias("key"))
        pivots = dealt.select("a", "s").distinct().select("a", "s", F.lit(0).alias("role"), F.col("a").alias("b"), F.col("a").alias("key"))
        both = members.union(pivots).join(sets, "key").select("a", "s", "role", "b", "toks")
        both = both.repartition("a", "s").sortWithinPartitions("a", "s", "role", "b")
        found = self.scratch.save(both.mapInArrow(_verify_run(num, den), "u long, v long"))
        bits.destroy()
        self.scratch.drop(left)
        self.scratch.tidy()
        return found


def _groups(docs: DataFrame, shingle: int, threshold: tuple[int, int], id_col: str, text_col: str, hot: int, key_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, key) of every row, h a hash of its text; and (key, root) of every class of texts with words."""
    spark: SparkSession = docs.sparkSession
    num, den = threshold
    scratch = Scratch(spark, "jaccard")
    text = F.col(text_col)
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))

    names = Names(key_bits)
    schema = "doc_id long, h long, n long, key long, chk long, " + "".join(f"{c} long, " for c in LANE_NAMES) + "fine binary, blk int, blob binary"
    base = scratch.save(only.mapInArrow(_digest(shingle, names), schema))
    blocks = base.where("blk is not null").select("blk", "blob").groupBy("blk").applyInPandas(_sum_blocks, "blk int, blob binary").collect()
    counts = np.zeros((BLOCKS, (1 << SKETCH) // BLOCKS), np.uint32)
    for r in blocks:
        counts[r["blk"]] = np.frombuffer(r["blob"], np.uint32)
    tokens = int(counts.sum(dtype=np.int64))
    rows = base.where("blk is null").drop("blk", "blob")

    def classed(rows: DataFrame) -> DataFrame:
        told = (F.first("n").alias("n"), F.min("chk").alias("lo"), F.max("chk").alias("hi"), *(F.first(c).alias(c) for c in (*LANE_NAMES, "fine")))
        return scratch.save(rows.where("n > 0").groupBy("key").agg(*told))

    known = classed(rows)
    # sets that share a name: n ** 2 / 2 ** 65 of n classes are expected, some tens among 5e10
    shared = known.where("lo <> hi").select("key", "lo").collect()
    if shared:
        table = np.sort(np.array([(r["key"], r["lo"]) for r in shared], np.int64).view(U).view([("key", U), ("lo", U)]).reshape(-1), order="key")
        names = Names(key_bits, table["key"].copy(), table["lo"].copy())
        pairs = F.broadcast(spark.createDataFrame([tuple(r) for r in shared], "_key long, _lo long"))
        rows = rows.join(pairs, F.col("key") == F.col("_key"), "left").withColumn("key", F.expr("if(_lo is not null and chk <> _lo, chk, key)")).drop("_key", "_lo")
        scratch.drop(known)
        known = classed(rows)
    known = known.drop("lo", "hi")
    digest = rows.select("doc_id", "h", "n", "key")
    verifier = Verifier(scratch, only.select("text"), known, known.count(), shingle, num, den, names)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * least, 1 + tokens // 2_000_000)
    classes = spark.sparkContext.broadcast(frequency_classes(counts.reshape(-1).astype(np.int64)))

    posted = only.select("text").mapInArrow(_postings(shingle, num, den, parts, classes, names, hot), "part long, blob binary")
    found = scratch.save(posted.groupBy("part").applyInPandas(_buckets(num, den, parts), "kind long, x long, y long, nx long, ny long, c long, need long"))
    classes.destroy()
    counted = found.where("kind = 0").groupBy("x", "y", "need").agg(F.sum("c").alias("c"))
    short = counted.where("c < need")
    member = ("x as bucket", "y as key", "nx as size", "ny as n", "shiftright(c, 16) as p", "c & 65535 as l", "need as rank", "y as label")
    large = found.where("kind = 1").selectExpr(*member).union(found.where("kind = 2").selectExpr(*member).dropDuplicates(["bucket", "key"]))
    met = counted.where("c >= need").select("x", "y").union(_meet(large, num, den, ROUNDS[0]))
    roots = spark.createDataFrame([], "u long, v long")

    def merge(roots: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return roots
        out = components(scratch, roots.union(links))
        scratch.drop(links, roots)
        return out

    before = None
    for width in (*ROUNDS[1:], None):
        roots = merge(roots, verifier.links(met))
        open_ = _label(large.drop("label"), roots, "key", "label")
        split = open_.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.min_by("label", "rank").alias("lead"), F.count("*").alias("many")).where("a <> z")
        split = scratch.save(split.select("bucket", "lead", "many"))
        # a few buckets go to where the members are, so that one of a third of all rows is not dealt to one task
        large = scratch.save(open_.join(F.broadcast(split) if split.count() <= FEW else split, "bucket"))
        scratch.drop(split)
        if before is not None:
            scratch.drop(before)
        before = large
        met = _meet(large.join(known.select("key", *LANE_NAMES), "key"), num, den, width)
        large = large.drop("lead", "many")
        if width is None:
            left = _label(_label(short, roots, "x", "lx"), roots, "y", "ly").where("lx <> ly").select("x", "y", "need", "c")
            met = met.union(left).groupBy("x", "y").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where("c >= need").select("x", "y")
    roots = merge(roots, verifier.links(met))
    scratch.drop(found, before)
    return digest, _label(known.select("key"), roots, "key", "root")


def similar_groups(
    docs: DataFrame,
    shingle: int = 5,
    threshold: tuple[int, int] = (75, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    hot: int = HOT,
    key_bits: int = 64,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    component_id is the smallest id that can be reached over links (num/den or more of the union shared), the
    text's own included. A null or blank text has no shingles, links with nothing and keeps its own id. Rows that
    repeat an id are each returned. A null id stays null unless the text links to one that has an id. Other columns
    of `docs` are not read. hot: the class of frequency (a power of two) from which tokens are dealt evenly; key_bits:
    the bits of a class's first name. Neither changes the result.
    """
    digest, named = _groups(docs, shingle, threshold, id_col, text_col, hot, key_bits)
    plain = digest.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    per_class = digest.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("own"))
    lab = named.join(per_class, "key")
    least = lab.groupBy("root").agg(F.min("own").alias("component_id"))
    of_class = lab.join(least, "root").select("key", "component_id")
    return digest.where("n > 0").join(of_class, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(plain)


def _label(df: DataFrame, roots: DataFrame, key: str, label: str) -> DataFrame:
    r = roots.select(F.col("u").alias(key), F.col("v").alias("_root"))
    return df.join(r, key, "left").withColumn(label, F.coalesce("_root", key)).drop("_root")


def _meet(large: DataFrame, num: int, den: int, width: int | None) -> DataFrame:
    """Pairs (x, y) of large buckets across components.

    With a width, each text meets the first members of one bucket only, its largest: members of a group share many
    buckets. Without, every bucket counts (columns need and c too); of each pair one at least lies outside the
    component of the bucket's first member. Where parity bitmaps are there, a pair whose bitmaps differ in more
    places than a link's sets can have tokens apart is none. The larger side of a bucket is dealt over groups of some
    DEALT rows, and the smaller one is sent to each of them.
    """
    size = F.col("size" if width is not None else "many")
    groups = F.ceil(size / DEALT).cast("int")
    dealt = F.pmod(F.xxhash64("key"), groups).cast("int")
    every = F.explode(F.sequence(F.lit(0), groups - 1))
    one, other = large, large
    if width is None:
        one = one.where("label <> lead").withColumn("s", every)
        other = other.withColumn("s", dealt)
    else:
        own = large.groupBy("key").agg(F.max(F.struct("size", "bucket")).alias("m")).select("key", F.col("m.bucket").alias("bucket"))
        one = one.join(own, ["key", "bucket"]).withColumn("s", dealt)
        other = other.where(F.col("rank") < width).withColumn("s", every)
    p = other.select(*(F.col(c).alias("p_" + c) for c in other.columns))
    on = (F.col("bucket") == F.col("p_bucket")) & (F.col("s") == F.col("p_s")) & (F.col("label") != F.col("p_label")) & F.expr(_may_link_sql("", "p_", num, den))
    if "s0" in large.columns:
        on = on & F.expr(f"(n + p_n - ({_apart('', 'p_')})) * {num + den} >= {2 * num} * (n + p_n)")
    pair = [F.least("key", "p_key").alias("x"), F.greatest("key", "p_key").alias("y")]
    if width is None:
        on = on & ((F.col("p_label") == F.col("lead")) | (F.col("key") < F.col("p_key")))
        return one.join(p, on).select(*pair, F.least("l", "p_l").alias("need"), F.lit(1).cast("long").alias("c"))
    return one.join(p, on).select(*pair).distinct()


def one_of_each_group(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (75, 100), hot: int = HOT, key_bits: int = 64) -> DataFrame:
    """The rows of docs, all columns, of one document of each group: that of the least doc_id, once if its row repeats.

    Of rows that share the least id the one of least text hash stays. A group without any id keeps one row too. Texts
    without words are in no group and stay, each.
    """
    digest, named = _groups(docs, shingle, threshold, "doc_id", "text", hot, key_bits)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    per_class = digest.where("n > 0").groupBy("key").agg(F.min(first).alias("first"))
    kept = named.join(per_class, "key").groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select("first.doc_id", "first.h", F.lit(False).alias("each")).union(digest.where("n = 0").select("doc_id", "h", F.lit(True)).distinct())
    hidden = "_".join(docs.columns) + "_"  # names that docs does not have
    keys = [hidden + x for x in ("id", "none", "h")]

    def keyed(doc_id, h) -> list:
        return [F.coalesce(doc_id, F.lit(0)).cast("long").alias(keys[0]), doc_id.isNull().alias(keys[1]), h.alias(keys[2])]

    rows = docs.select("*", *keyed(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))
    both = rows.join(kept.select(*keyed(F.col("doc_id"), F.col("h")), F.col("each").alias(hidden + "each")), keys)
    # rows meet their equals where the join has put them
    both = both.withColumn(hidden + "n", F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])))
    return both.where(F.col(hidden + "each") | (F.col(hidden + "n") == 1)).select(*docs.columns)
