"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each whole text gives a fixed vector: its size, word lengths, shares of kinds of bytes, repetition of words and
lines; counts enter as logarithms and shares as log odds. A class is a normal density whose covariance is shrunk
towards the pooled diagonal; the score is the posterior of label 1 from the difference of log densities, with the
Mahalanobis terms from Cholesky factors computed once. The classes' sums and products are taken over all labelled
rows that are not held out.

Cases: null and empty text has the vector of no words and is scored; with no labels, or labels of one kind, the
score is that label's share (0.5 without labels); a null doc_id is not held out; repeated rows are scored one by
one, and a doc_id labelled twice counts by its highest label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import fold, materialise, slices, table, text_bytes

SHRINKAGE, FLOOR = 0.1, 1e-3
THRESHOLD, HELD_OUT = 0.7, 2
_KINDS = {
    "upper": [c for c in range(128) if chr(c).isupper()],
    "lower": [c for c in range(128) if chr(c).islower()],
    "digit": list(range(48, 58)),
    "mark": [ord(c) for c in ".,;:'\"-()"],
    "loud": [ord(c) for c in "!?"],
    "symbol": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
    "line": [10],
    "wide": list(range(128, 256)),
}
_KIND = np.zeros((len(_KINDS), 256), bool)
for _row, _bytes in zip(_KIND, _KINDS.values()):
    _row[_bytes] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole - part + 0.5))


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct values of each row."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    return _sums(new, first)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    raw, offsets = text_bytes(column)
    size = np.diff(offsets).astype(float)
    starts, ends, first = words.bounds(raw, offsets)
    n, length = np.diff(first).astype(float), (ends - starts).astype(float)
    hashed = words.hashes(raw, starts, ends)
    again = np.zeros(len(hashed), bool)
    again[1:] = hashed[1:] == hashed[:-1]
    again[first[:-1][first[:-1] < len(hashed)]] = False
    newline = np.ones(256, bool)
    newline[:] = False
    newline[10] = True
    l0, l1, lines = words.bounds(raw, offsets, newline)
    line_hash, n_lines = words.hashes(raw, l0, l1), np.diff(lines).astype(float)
    mean = _sums(length, first) / np.maximum(1, n)
    spread = np.sqrt(np.maximum(0, _sums(length**2, first) / np.maximum(1, n) - mean**2))
    short, last = length <= 2, raw[ends - 1] if len(ends) else raw[:0]
    columns = [np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(n / np.maximum(1, n_lines))]
    columns += [_odds(_sums(k[raw], offsets), size) for k in _KIND]
    columns += [_odds(_distinct(hashed, first), n), _odds(_sums(again, first), n), _odds(_distinct(line_hash, lines), n_lines), _odds(_sums(short, first), n), _odds(_sums(_KIND[5][last] | _KIND[4][last], first), n)]
    return np.stack(columns, 1)


N_STATISTICS = 5 + len(_KINDS) + 5


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the inverse covariances and log priors less half log determinants."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        log = [c - 0.5 * (((x - m) @ f) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From each class's number of rows, sum of vectors and sum of outer products."""
    share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
    if counts.min() < 2:
        return Discriminant([], [], [], share)
    means = [s / n for s, n in zip(sums, counts)]
    covariances = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means)]
    pooled = np.diag(sum(n * c.diagonal() for n, c in zip(counts, covariances)) / counts.sum() + FLOOR)
    factors, constants = [], []
    for n, c in zip(counts, covariances):
        lower = np.linalg.cholesky((1 - SHRINKAGE) * c + SHRINKAGE * pooled)
        factors.append(np.linalg.inv(lower).T)
        constants.append(float(np.log(n / counts.sum()) - np.log(lower.diagonal()).sum()))
    return Discriminant(means, factors, constants, share)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics (packed doubles) of every whole text, written once for fitting and scoring."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in statistics(b.column("text"))], pa.binary())], names=["doc_id", "x"])

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary"), "statistics")


def fit(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((fold("doc_id", 4) != HELD_OUT) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_STATISTICS + 1, N_STATISTICS + 1))
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist())).reshape(b.num_rows, -1)
            x, y = np.hstack([np.ones((len(x), 1)), x]), b.column("quality").to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "value"])

    cells = vectors.join(known, "doc_id").select("quality", "x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(2 * (N_STATISTICS + 1) ** 2)
    for r in cells.collect():  # as many rows as the matrices have cells
        total[r.cell] = r.value
    total = total.reshape(2, N_STATISTICS + 1, N_STATISTICS + 1)
    return discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def score(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.frombuffer(b"".join(b.column("x").to_pylist())).reshape(b.num_rows, N_STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return vectors.select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = measured(table(spark, sf_dir, "documents"))
    return score(vectors, fit(vectors, table(spark, sf_dir, "labels")))
