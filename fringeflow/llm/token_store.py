"""Token ids of a corpus in Re-Pair compressed shards, with random access.

The store is a Parquet dataset, so its files are committed by Spark and survive lost executors. A row is a shard:
some whole documents in ascending id order, as

- ids: int64 document ids; ends: uint64 running token counts; first: uint32 place of each document in the sequence
- rules: pairs of uint16 or uint32 symbols, rule r standing for symbol vocabulary + r
- lengths: uint32, how many ids each rule expands to
- sequence: the remaining symbols, of the same width

Re-Pair runs in batches: a round counts all adjacent pairs, gives the most frequent ones a nonterminal each and
replaces them from left to right, until no pair is frequent enough or the symbols are used up. No pair spans two
documents, so a document is a run of whole symbols, and the lengths tell which symbols hold a range of its ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import arrow_batches
from . import text as T

U = np.uint64
SHARD = 2_000_000  # tokens after which a shard is closed
LEAST = 8  # a pair that is rarer is not worth a rule
TABLE_BITS = 21  # slots of an encoder's table of words
MOST_HELD = 8_000_000  # ids, and four bytes of words each, after which an encoder forgets its words


class Encoder:
    """Encodes texts by their distinct words: each task asks the tokenizer once for a word it has not met.

    A text is cut at white space, and a last full stop or comma is cut from a word that ends in a Latin letter or an
    ASCII digit; the tokenizer's own rules cut there too. Words are found by a hash and then compared byte for byte.
    Words of plain Latin letters skip the tokenizer's normaliser and patterns, which do nothing to them once lower-cased,
    and its spelling of bytes as characters, which is done in bulk. Texts with marks of special tokens go to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.full.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {c: self.full.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, U)
        self.rank = np.zeros(1 << TABLE_BITS, np.int32)
        self.known = 0  # words in the table
        self.at, self.flat = _Grown(np.int64), _Grown(np.uint32)  # where the ids of each word start, and the ids
        self.sizes, self.first, self.place, self.pool = _Grown(np.int32), _Grown(U), _Grown(np.int64), _Grown(np.uint8)
        self.at.add(np.zeros(1, np.int64))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash, or -1."""
        mask = (1 << TABLE_BITS) - 1
        slot = (h & U(mask)).astype(np.int64)
        k = self.keys[slot]
        out = np.where(k == h, self.rank[slot], -1).astype(np.int64)
        todo = np.flatnonzero((k != h) & (k != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            k = self.keys[slot[todo]]
            hit = k == h[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (k != 0)]
        return out

    def _add(self, h: np.ndarray, first: int) -> None:
        """Enters words by their hashes, under the ranks from `first` on."""
        mask = (1 << TABLE_BITS) - 1
        slot = (h & U(mask)).astype(np.int64)
        rank = np.arange(first, first + len(h))
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            _, at = np.unique(slot[todo], return_index=True)
            one = np.zeros(len(todo), bool)
            one[at] = True
            put = todo[free & one]
            self.keys[slot[put]] = h[put]
            self.rank[slot[put]] = rank[put]
            todo = todo[~(free & one)]
            slot[todo] = (slot[todo] + 1) & mask
        self.known += len(h)

    def _learn(self, raw: bytes, b: T.Bytes, s: np.ndarray, e: np.ndarray) -> int:
        """Ranks, from the returned one on, of spans, with their ids and their folded bytes."""
        first = len(self.sizes.values)
        n = e - s
        start = np.cumsum(n) - n
        letters = b.data[np.repeat(s - start, n) + np.arange(int(n.sum()))]
        flat, sizes = self._encode(raw, letters, s, n, start)
        self.at.add(self.at.values[-1] + np.cumsum(sizes))
        self.flat.add(flat)
        self.sizes.add(n.astype(np.int32))
        self.first.add(b.lane(s, n, 0))
        self.place.add(len(self.pool.values) + start)
        self.pool.add(letters)
        return first

    def _same(self, b: T.Bytes, s: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether the spans are, byte for byte, the words of these ranks."""
        ok = (self.sizes.values[rank] == n) & (self.first.values[rank] == b.lane(s, n, 0))
        more = np.flatnonzero(ok & (n > 8))
        if len(more):
            known = T.Bytes(self.pool.values, fold=False)
            for j in range(1, T.SHORT // 8):
                more = more[n[more] > 8 * j]
                if not len(more):
                    break
                same = known.lane(self.place.values[rank[more]], n[more], j) == b.lane(s[more], n[more], j)
                ok[more[~same]] = False
                more = more[same]
        return ok

    def ranks(self, raw: bytes, b: T.Bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Rank of each span. Words that are too long to compare, or share another one's hash, get a rank of their own."""
        key = b.hashes(s, e) | U(1)
        short = e - s <= T.SHORT
        rank = np.where(short, self._find(key), -1)
        new = np.flatnonzero(short & (rank < 0))
        if len(new):
            some, at = np.unique(key[new], return_index=True)
            self._add(some, self._learn(raw, b, s[new[at]], e[new[at]]))
            rank[new] = self._find(key[new])
        known = np.flatnonzero(short)
        apart = np.concatenate((known[~self._same(b, s[known], (e - s)[known], rank[known])], np.flatnonzero(~short)))
        if len(apart):
            rank[apart] = self._learn(raw, b, s[apart], e[apart]) + np.arange(len(apart))
        return rank

    def _encode(self, raw: bytes, letters: np.ndarray, s: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and their number. letters: the words' folded bytes, each word's from `start`."""
        # words of a-z and of two-byte letters, the first byte 0xC3 (0x97 and 0xB7 are signs)
        second = np.zeros(len(letters), bool)
        second[1:] = letters[:-1] == 0xC3
        good = _LOWER[letters] | (letters == 0xC3) | (second & (letters >= 0x80) & (letters != 0x97) & (letters != 0xB7))
        easy = np.logical_and.reduceat(good, start)
        lower = letters.copy()
        lower[second & (letters >= 0x80) & (letters <= 0x9E)] += 0x20
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which words, their ids, how many each
        rest = [np.flatnonzero(~easy)]
        plain = np.flatnonzero(easy)
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            k = n[some]
            line = np.full(int(k.sum()) + len(some), 0x20, np.uint8)
            step = np.arange(int(k.sum()))
            line[step + np.repeat(np.arange(len(some)), k)] = lower[step + np.repeat(start[some] - (np.cumsum(k) - k), k)]
            line[np.cumsum(k + 1)[LINE - 1 :: LINE] - 1] = 0x0A
            lines = _SPELLING[line].tobytes().decode("utf-16-le").split("\n")
            ids = np.array([x for f in self.plain.encode_batch_fast(lines, add_special_tokens=False) for x in f.ids], np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):
                parts.append((some, ids, np.diff(cut, prepend=0)))
            else:
                rest.append(some)
        slow = np.concatenate(rest)
        found = self.full.encode_batch_fast([raw[x : x + y].decode("utf-8", "replace") for x, y in zip(s[slow].tolist(), n[slow].tolist())], add_special_tokens=False)
        parts.append((slow, np.array([x for f in found for x in f.ids], np.uint32), np.array([len(f.ids) for f in found], np.int64)))
        sizes = np.zeros(len(n), np.int64)
        for which, _, k in parts:
            sizes[which] = k
        at = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for which, ids, k in parts:
            out[np.repeat(at[which] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, sizes

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number; after each text the end id, if there is one."""
        ids, sizes, done = self._ids(data, offs, end_id)
        if end_id is None or done:
            return ids, sizes
        sizes = sizes + 1
        out = np.full(int(sizes.sum()), end_id, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(sizes) - 1] = False
        out[body] = ids
        return out, sizes

    def _ids(self, data: np.ndarray, offs: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids and their number, and whether the end ids are among them: they are where every text has a word."""
        raw = data.tobytes()
        if b"<|" in raw:
            o = offs.tolist()
            found = [e.ids for e in self.full.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(o, o[1:])], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((x for y in found for x in y), np.uint32, int(sizes.sum())), sizes, False
        if self.known > 1 << (TABLE_BITS - 1) or len(self.flat.values) + len(self.pool.values) // 4 > MOST_HELD:
            self.reset()
        start, end, counts = T.bounds(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64), False
        last = data[end - 1]
        before = data[np.maximum(end - 2, 0)]
        # before the mark an ASCII letter or digit, or a letter of two bytes, the first 0xC3 (0x97 and 0xB7 are signs)
        latin = (end - start > 2) & (data[np.maximum(end - 3, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
        cut = (end - start > 1) & ((last == 0x2E) | (last == 0x2C)) & (_ALNUM[before] | latin)
        found = self.ranks(raw, T.Bytes(data), start, end - cut)
        marks = np.where(cut, np.where(last == 0x2E, self.marks["."], self.marks[","]), 0).astype(np.uint32)
        at = self.at.values
        of = np.concatenate(([0], np.cumsum(counts)))
        ended = end_id is not None and bool(counts.all())
        # places after each word's ids for its mark and for the end id, where it has them
        more = cut.astype(np.int64)
        if ended:
            more[of[1:] - 1] += 1
        lens = at[found + 1] - at[found] + more
        total = np.cumsum(lens)
        where = np.repeat(at[found] - (total - lens), lens)
        where += np.arange(len(where))
        first = total[cut] - more[cut]
        where[first] = 0
        if ended:
            where[total[of[1:] - 1] - 1] = 0
        ids = self.flat.values[where] if len(self.flat.values) else np.zeros(len(where), np.uint32)
        ids[first] = marks[cut]
        if ended:
            ids[total[of[1:] - 1] - 1] = end_id
        return ids, np.diff(np.concatenate(([0], total))[of]), ended


class _Grown:
    """An array that grows in steps, so adding to it does not copy it each time."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate((self.held, np.zeros(max(need, 3 * len(self.held) // 2) - len(self.held), self.held.dtype)))
        self.held[self.n : need] = values
        self.n = need

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


_ENCODERS: dict[str, Encoder | None] = {}
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
LINE = 500  # words given to the tokenizer at once
# fixed values: characters by which byte-level vocabularies spell bytes that are no printable Latin-1 characters
_SPELLING = np.arange(256, dtype="<u2")
_SPELLING[128:161], _SPELLING[173] = np.arange(290, 323), 323


def repair(seq: np.ndarray, vocabulary: int, stop: int, per_round: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The remaining sequence and the rules (pairs of symbols). `stop` is never part of a pair."""
    seq = seq.astype(np.uint32)
    limit = 65536 if vocabulary <= 60_000 else 1 << 20
    bits = 16 if limit == 65536 else 20
    kind = np.uint32 if limit == 65536 else U
    none = np.iinfo(kind).max  # the code of no pair
    rules: list[np.ndarray] = []
    used = vocabulary
    while used < limit and len(seq) >= 2 * LEAST:
        code = seq[:-1].astype(kind)
        code <<= kind(bits)
        code |= seq[1:]
        ends = np.flatnonzero(seq == stop)
        code[ends[ends < len(code)]] = none
        code[ends[ends > 0] - 1] = none
        ordered = np.sort(code)
        edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        edge = np.concatenate(([0], edge))
        times = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(times >= LEAST)
        if len(often) and ordered[edge[often[-1]]] == none:
            often = often[:-1]
        if not len(often):
            break
        often = often[np.argsort(-times[often], kind="stable")][: min(per_round, limit - used)]
        pairs = ordered[edge[often]]
        slot = _hash(pairs)
        _, first = np.unique(slot, return_index=True)  # of pairs that meet in a slot the most frequent one goes first
        pairs = pairs[np.sort(first)]
        table = np.zeros(1 << 20, np.uint32)
        table[_hash(pairs)] = np.arange(1, len(pairs) + 1)
        hit = table[_hash(code)]
        at = np.flatnonzero(hit)
        which = hit[at] - 1
        same = pairs[which] == code[at]
        at, which = at[same], which[same]
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        i = np.arange(len(at))
        other = (i - np.maximum.accumulate(np.where(run, i, 0))) % 2 == 0
        at = at[other]
        seq[at] = used + which[other]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack((pairs >> kind(bits), pairs & kind((1 << bits) - 1)), 1).astype(np.uint32))
        used += len(pairs)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _hash(code: np.ndarray) -> np.ndarray:
    """A slot of 20 bits."""
    if code.dtype == np.uint32:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return (code * U(0x9E3779B97F4A7C15) >> U(44)).astype(np.int64)


def expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """All expansions one after another, first of the vocabulary's ids and then of the rules, and where each starts."""
    size = np.ones(vocabulary + len(rules), np.int64)
    rules = rules.astype(np.int64)
    seq = np.arange(vocabulary, vocabulary + len(rules))
    own = np.arange(len(rules))
    while len(seq) and (seq >= vocabulary).any():
        big = seq >= vocabulary
        n = 1 + big
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        out[at] = seq
        out[at[big]], out[at[big] + 1] = rules[seq[big] - vocabulary, 0], rules[seq[big] - vocabulary, 1]
        seq, own = out, np.repeat(own, n)
    size[vocabulary:] = np.bincount(own, minlength=len(rules)) if len(rules) else 0
    return np.concatenate((np.arange(vocabulary), seq)).astype(np.uint32), np.concatenate(([0], np.cumsum(size)))


def decode(sequence: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = at[sequence + 1] - at[sequence]
    total = np.cumsum(n)
    if not len(n):
        return np.zeros(0, np.uint32)
    return flat[np.repeat(at[sequence] - (total - n), n) + np.arange(int(total[-1]))]


SCHEMA = "part long, shard long, n_docs long, n_tokens long, vocabulary long, ids binary, known binary, ends binary, first binary, rules binary, lengths binary, sequence binary"


def _write_run(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)
        _ENCODERS[path] = encoder  # words met by a worker's earlier tasks are known to the next one
        part = TaskContext.get().partitionId()
        shard = 0
        ids: list[np.ndarray] = []
        known: list[np.ndarray] = []
        seqs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            seq, n = np.concatenate(seqs), np.concatenate(sizes)
            short, rules = repair(seq, encoder.size, end_id)
            kind = np.uint16 if encoder.size + len(rules) <= 65536 else np.uint32
            _, at = expansions(rules, encoder.size)
            length = np.diff(at)[encoder.size :]
            first = np.searchsorted(np.concatenate(([0], np.cumsum(np.diff(at)[short]))), np.concatenate(([0], np.cumsum(n)))[:-1])
            row = [
                part, shard, len(n), int(n.sum()), encoder.size, np.concatenate(ids).tobytes(), np.packbits(np.concatenate(known)).tobytes(),
                np.cumsum(n).astype(U).tobytes(), first.astype(np.uint32).tobytes(), rules.astype(kind).tobytes(), length.astype(np.uint32).tobytes(), short.astype(kind).tobytes(),
            ]
            shard, held = shard + 1, 0
            for x in (ids, known, seqs, sizes):
                x.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names)

        for batch in batches:
            col = batch.column(0)
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                seq, n = encoder.encode(data, offs, end_id)
                own = col.slice(lo, hi - lo)
                known.append(np.asarray(own.is_valid()))
                ids.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                seqs.append(seq)
                sizes.append(n)
                held += len(seq)
                if held >= SHARD:
                    yield close()
        if held:
            yield close()

    return T.tidily(run)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes every text of docs (doc_id, text) and writes the store at `path`, in ascending doc_id order.

    A null text is empty: its one id is the end id. Null ids come first; rows that repeat an id follow one another,
    ordered by text. No other column is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_batches(docs.sparkSession, "8m"):
        rows.mapInArrow(_write_run(tokenizer, end_id), SCHEMA).write.mode("overwrite").parquet(path)


class Shard:
    """A row of the store, opened for reading."""

    def __init__(self, row):
        self.vocabulary = int(row["vocabulary"])
        many = len(row["lengths"]) // 4
        kind = np.uint16 if self.vocabulary + many <= 65536 else np.uint32
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
        self.sequence = np.frombuffer(row["sequence"], kind).astype(np.int64)
        self.lengths = np.concatenate((np.ones(self.vocabulary, np.int64), np.frombuffer(row["lengths"], np.uint32)))
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(self.ids)].astype(bool)
        self.ends = np.frombuffer(row["ends"], U).astype(np.int64)
        self.first = np.frombuffer(row["first"], np.uint32).astype(np.int64)

    def tokens(self) -> np.ndarray:
        return decode(self.sequence, *expansions(self.rules, self.vocabulary))

    def document(self, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of the i-th document: only the symbols that hold them are expanded."""
        a = self.first[i]
        b = self.first[i + 1] if i + 1 < len(self.first) else len(self.sequence)
        run = np.concatenate(([0], np.cumsum(self.lengths[self.sequence[a:b]])))
        hi = int(run[-1]) if hi is None else min(hi, int(run[-1]))
        if lo >= hi:
            return np.zeros(0, np.uint32)
        p, q = int(np.searchsorted(run, lo, "right")) - 1, int(np.searchsorted(run, hi, "left"))
        out: list[int] = []
        stack = self.sequence[a + p : a + q][::-1].tolist()
        while stack:
            s = stack.pop()
            if s < self.vocabulary:
                out.append(s)
            else:
                x, y = self.rules[s - self.vocabulary].tolist()
                stack += (y, x)
        return np.array(out[lo - run[p] : hi - run[p]], np.uint32)


def _read_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            s = Shard(row)
            raw = memoryview(s.tokens().astype("<u4").tobytes())
            start = np.concatenate(([0], s.ends[:-1]))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), s.ends.tolist())]
            many = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, row["part"])), pa.array(np.full(many, row["shard"])), pa.array(s.ids, mask=~s.known), pa.array(start), pa.array(s.ends - start), pa.array(crc, pa.int64())],
                ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the store, from the decoded ids."""
    store = spark.read.parquet(path)
    rows = store.mapInArrow(T.tidily(_read_run), "part long, shard long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    shards = store.select("part", "shard", F.col("n_tokens").alias("total"))
    # running sums: over the parts, of which there are as many as tasks, and inside each part
    parts = shards.groupBy("part").agg(F.sum("total").alias("total"))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(over_parts), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = shards.withColumn("more", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("base") + F.col("more")).alias("base"))
    return rows.join(at, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    """The vocabulary file that the contract names; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
