"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = 1 / (1 + exp(s - threshold_k)), with one score s = w . x for all grades and ordered thresholds. The
features x are hashed words of a text, weighted by the root of their share, and a few hashed habits of its shape
(shares of letters, digits and capitals, lengths, repeated words and lines), in steps. Expected grade and the
probability of a grade at or above a chosen one follow from the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .toxicity import _LETTERS, held_out

U = np.uint64
BITS = 18
HABITS = 12  # habits of shape
STEPS = 24


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    threshold: np.ndarray  # ascending, one fewer than grades
    grades: np.ndarray  # ascending

    def tail(self, s: np.ndarray, k: int) -> np.ndarray:
        """Probability of the k-th or a higher grade, k from 1."""
        return 1 / (1 + np.exp(-np.clip(s - self.threshold[k - 1], -35, 35)))

    def expected(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), float(self.grades[0]))
        for k in range(1, len(self.grades)):
            out += float(self.grades[k] - self.grades[k - 1]) * self.tail(s, k)
        return out


def _share(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return (c[offs[1:]] - c[offs[:-1]]) / np.maximum(np.diff(offs), 1)


def _distinct_share(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    _, n = T.sets(h, counts)
    return n / np.maximum(counts, 1)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and texts, sorted by text; a text's words share weight one, and so do its habits."""
    texts = len(offs) - 1
    h, _, _, counts = T.words(_LETTERS[data], offs)
    code = np.sort(T.owner(counts) << BITS | (h >> U(64 - BITS)).astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(code)))
    row, f = code[first] >> BITS, code[first] & ((1 << BITS) - 1)
    value = np.sqrt(times / counts[row]) if len(row) else np.zeros(0)
    raw, _, _, raw_counts = T.words(data, offs)
    lines = np.where(data == 0x0A, 0x20, np.where(T.SPACE[data], 0x5F, data)).astype(np.uint8)
    lh, _, _, lc = T.words(lines, offs)
    size = np.diff(offs)
    shares = [
        _share(((data >= 65) & (data < 91)) | ((data >= 97) & (data < 123)), offs), _share((data >= 48) & (data < 58), offs), _share((data >= 65) & (data < 91), offs),
        _share(data >= 128, offs), _share(T.SPACE[data], offs), _share(~T.SPACE[data] & (_LETTERS[data] == 0x20), offs), _distinct_share(raw, raw_counts),
        _distinct_share(lh, lc), np.minimum(size / np.maximum(raw_counts, 1) / 20, 1), np.minimum(np.log1p(raw_counts) / 12, 1), np.minimum(np.log1p(lc) / 12, 1),
        np.minimum(raw_counts / np.maximum(lc, 1) / 200, 1),
    ]
    habit_row = np.tile(np.arange(texts), HABITS)
    step = np.concatenate([np.floor(np.sqrt(x) * (STEPS - 1)).astype(np.int64) for x in shares])
    number = (np.repeat(np.arange(HABITS), texts) * STEPS + step).astype(U)
    hf = (T.mix(number + U(0xABCDEF)) >> U(64 - BITS)).astype(np.int64)
    row, f, value = np.concatenate((row, habit_row)), np.concatenate((f, hf)), np.concatenate((value, np.full(len(hf), HABITS**-0.5)))
    order = np.argsort(row, kind="stable")
    return f[order], value[order], row[order]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, l2: float, seed: int) -> Model:
    """AdaGrad on the log-likelihood of (grade, features, values) rows in a seeded order."""
    grades = np.array(sorted({y for y, _, _ in rows}))
    k = len(grades) - 1
    place = {g: i for i, g in enumerate(grades.tolist())}
    n = np.bincount([place[y] for y, _, _ in rows], minlength=k + 1)
    below = np.clip(np.cumsum(n)[:-1] / n.sum(), 1e-3, 1 - 1e-3)
    th = np.log(below / (1 - below))
    w, gw, gt = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), np.full(max(k, 0), 1e-2)
    if k < 1:
        return Model(w, np.zeros(0), grades)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, f, v = rows[r]
            i = place[y]
            s = float(w[f] @ v)
            at = 1 / (1 + np.exp(np.clip(s - th, -35, 35)))  # P(grade <= k)
            lo, hi = at[i - 1] if i else 0.0, at[i] if i < k else 1.0
            p = max(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi), lo * (1 - lo)
            ds = (dhi - dlo) / p  # descent direction of the negative log-likelihood in s
            g = ds * v + l2 * w[f]
            gw[f] += g * g
            w[f] -= rate * g / np.sqrt(gw[f])
            for j, d in ((i, -dhi / p), (i - 1, dlo / p)):
                if 0 <= j < k:
                    gt[j] += d * d
                    th[j] -= rate * d / np.sqrt(gt[j])
            th = np.maximum.accumulate(th)
    return Model(w, th, grades)


def train(
    docs: DataFrame, ratings: DataFrame, most_rows: int = 12_000, epochs: int = 4, rate: float = 0.15, l2: float = 1e-5, seed: int = 3
) -> Model:
    """Fits on at most `most_rows` rated rows (doc_id, grade), those whose seeded hash of doc_id is least.

    Rows with a null grade are left out; repeated ids count by their greatest grade. With fewer than two grades every
    text has the one grade there is (0 without any).
    """
    some = (
        ratings.where("grade is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "grade").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for b in batches:
            ids, grades = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, hi, data, offs in T.pieces(b.column(1)):
                f, v, row = features(data, offs)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    x = (grades[lo + i], f[at[i] : at[i + 1]].astype(np.int32), v[at[i] : at[i + 1]].astype(np.float32))
                    old = seen.get(ids[lo + i])
                    if old is None or (len(x[1]), x[1].tobytes()) > (len(old[1]), old[1].tobytes()):
                        seen[ids[lo + i]] = x
        m = fit([seen[i] for i in sorted(seen)], epochs, rate, l2, seed)
        at = np.flatnonzero(m.weight).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (at, m.weight[at], m.threshold, m.grades.astype(np.int64))], ["i", "w", "t", "g"]
        )

    got = rows.mapInArrow(T.tidily(run), "i binary, w binary, t binary, g binary").collect()
    w = np.zeros(1 << BITS)
    if not got or not got[0]["g"]:
        return Model(w, np.zeros(0), np.zeros(1, np.int64))
    w[np.frombuffer(got[0]["i"], np.uint32)] = np.frombuffer(got[0]["w"])
    return Model(w, np.frombuffer(got[0]["t"]), np.frombuffer(got[0]["g"], np.int64))


def grade(docs: DataFrame, model: Model, at_least: int, cutoff: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of grade `at_least` or more), selected, for every row of docs.

    A null or blank text is graded by its shape alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    k = int((model.grades < at_least).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, data, offs in T.pieces(batch.column(1)):
                f, v, row = features(data, offs)
                s = np.bincount(row, m.weight[f] * v, hi - lo)
                tail = np.ones(hi - lo) if k == 0 else np.zeros(hi - lo) if k >= len(m.grades) else m.tail(s, k)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(m.expected(s)), pa.array(tail), pa.array(tail >= cutoff)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "expected_grade", "tail_probability", "selected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(T.tidily(run), "doc_id long, expected_grade double, tail_probability double, selected boolean")


def quality_grades(docs: DataFrame, labels: DataFrame, at_least: int = 1) -> DataFrame:
    """Grades every row of docs with a model of labels.quality, learnt from rows that are not held out."""
    model = train(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("grade")))
    return grade(docs, model, at_least).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
