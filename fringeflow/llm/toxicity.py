"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate and an L1 penalty, so the weights of the rare n-grams stay exactly zero
and what remains is a short list of (feature, weight) that is broadcast. Features are binary: the distinct word
unigrams, bigrams, trigrams and one-skip bigrams of a whole text, hashed to 2**BITS coordinates. A text of any length
is scored from the sum of its features' weights plus the bias, so very long texts need no cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U = np.uint64
BITS = 20


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # sorted features with a weight
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.index] = self.weight
        return w


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each text, with repeats, and their count.

    A word's letters decide: what is not a letter, digit or byte above 0x7F separates words here, so punctuation
    does not hide a word.
    """
    h, _, _, counts = T.words(_LETTERS[data], offs)
    own = T.owner(counts)
    out, rows = [h], [own]
    for a, b, salt in ((0, 1, 1), (0, 2, 2)):
        m = max(len(h) - b, 0)
        ok = own[:m] == own[b : b + m]
        out.append((h[a : a + m] * T.COMBINE[salt] + h[b : b + m] * T.COMBINE[salt + 10])[ok])
        rows.append(own[:m][ok])
    m = max(len(h) - 2, 0)
    ok = own[:m] == own[2:]
    out.append((h[:m] * T.COMBINE[3] + h[1 : 1 + m] * T.COMBINE[13] + h[2:] * T.COMBINE[23])[ok])
    rows.append(own[:m][ok])
    f = (T.mix(np.concatenate(out)) >> U(64 - BITS)).astype(np.int64)
    return f, np.concatenate(rows)


def _letters() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    t[~word] = 0x20
    return t


_LETTERS = _letters()


def distinct(f: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(row << BITS | f)
    keep = np.ones(len(code), bool)
    keep[1:] = code[1:] != code[:-1]
    code = code[keep]
    return code & ((1 << BITS) - 1), code >> BITS


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, label = batch.column(0), batch.column(2)
        for lo, hi, data, offs in T.pieces(batch.column(1)):
            f, row = distinct(*features(data, offs))
            at = np.searchsorted(row, np.arange(hi - lo + 1))
            blobs = [f[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), label.slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["doc_id", "label", "f"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> Model:
    """Per-coordinate FTRL-proximal over (label, distinct features) rows, in a seeded order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = 1 << BITS
    rng = np.random.Generator(np.random.PCG64(seed))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, f = rows[r]
            i = np.append(f, bias).astype(np.int64)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(size))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 16_000,
    epochs: int = 4,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 16.0,
    l2: float = 1.0,
    refit_l1: float = 2.0,
    seed: int = 11,
    label_col: str = "label",
) -> Model:
    """Fits on at most `most_rows` labelled rows, those whose seeded hash of doc_id is least.

    A strong penalty picks the features; a second fit over them alone, with a weak one, sets their weights.

    labels: (doc_id, label 0/1); rows with a null label are left out, repeated ids count by their greatest label.
    Without any labelled row the model scores every text one half.
    """
    some = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(most_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")
    found = rows.mapInArrow(T.tidily(_extract), "doc_id long, label int, f binary")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for i, y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                f = np.frombuffer(f.as_buffer(), np.uint32)  # in the batch's own buffer: no copy of it is made
                if i not in seen or (len(f), f.tobytes()) > (len(seen[i][1]), seen[i][1].tobytes()):
                    seen[i] = (y, f)
        rows = [seen.pop(i) for i in sorted(seen)]
        picked = np.zeros(1 << BITS, bool)
        picked[ftrl(rows, epochs, alpha, beta, l1, l2, seed).index] = True
        m = ftrl([(y, f[picked[f]]) for y, f in rows], 2 * epochs, alpha / 2, beta, refit_l1, l2 / 10, seed + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.index.astype(np.uint32).tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias])], ["i", "w", "b"]
        )

    got = found.repartition(1).mapInArrow(T.tidily(fit), "i binary, w binary, b double").collect()
    if not got:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(got[0]["i"], np.uint32).astype(np.int64), np.frombuffer(got[0]["w"]), got[0]["b"])


def _scores(model: Model, w: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    f, row = features(data, offs)
    hit = w[f] != 0
    f, row = distinct(f[hit], row[hit])
    s = np.bincount(row, w[f], len(offs) - 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null or blank text scores the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.dense()
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                p = _scores(held.value, w, data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.tidily(run), "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """The fifth of the rows that no model learns from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxic_scores(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Learns from rows of labels that are not held out."""
    model = train(docs, labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label")), **how)
    return score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cutoff, 1).otherwise(0).alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.5, **how) -> DataFrame:
    """The rows of docs, all columns, that score under the cutoff. A null or blank text scores the bias alone."""
    model = train(docs, labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label")), **how)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.dense()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, data, offs in T.pieces(batch.column(at)):
                keep[lo:hi] = _scores(held.value, w, data, offs) < cutoff
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(T.tidily(run), docs.schema)
