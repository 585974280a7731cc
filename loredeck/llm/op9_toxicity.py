"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (white space and ASCII punctuation end a word, A-Z count as a-z) and the words' first
four to seven bytes, hashed to a fixed number of buckets; presence counts, not frequency. Buckets that go with the
label in the labelled sample become features. The machine scores a text by a bias, a weight for each feature and
the dot products of the features' factor vectors, so that two terms together, an insult and a group, can weigh
more, or less, than their sum. Texts are scored whole. Fitted on at most about FIT_DOCS labelled documents.

Cases: null and empty text has no terms and gets the bias's score; with no label, or one kind only, the score is
that label's share (0 without labels); a null doc_id is not held out; repeated rows are scored row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import bounded_sample, fold, slices, table, text_bytes

#: Hash buckets, features, factors of a feature, labelled documents to fit on.
BUCKETS, FEATURES, FACTORS, FIT_DOCS = 1 << 18, 4096, 8, 12_000
#: Bytes of a word's beginning that are terms too.
BEGINNINGS = (4, 5, 6, 7)
#: Least association (standard errors of the log odds) and least documents of a feature.
LEAST_Z, LEAST_DOCS = 3.5, 4
PASSES, RATE, PENALTY = 60, 0.05, 1e-4
THRESHOLD, HELD_OUT = 0.5, 0


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms of the texts and the text each belongs to."""
    raw, offsets = text_bytes(column)
    starts, ends, first = words.bounds(raw, offsets, words.PUNCTUATED)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, owners = [words.hashes(raw, starts, ends)], [owner]
    for n in BEGINNINGS:
        long = ends - starts > n
        found.append(words.hashes(raw, starts[long], starts[long] + n) + np.uint64(n))
        owners.append(owner[long])
    return (np.concatenate(found) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(owners)


@dataclass
class Machine:
    feature: np.ndarray  # bucket -> feature, -1 if none
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, owner: np.ndarray, i: np.ndarray, rows: int) -> np.ndarray:
        """Log odds of texts given as (text, feature) pairs."""
        out = self.bias + np.bincount(owner, self.weight[i], rows)
        for f in self.factor.T:
            v = f[i]
            s = np.bincount(owner, v, rows)
            out += 0.5 * (s * s - np.bincount(owner, v * v, rows))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        bucket, owner = terms(column)
        i = self.feature[bucket]
        hit = i >= 0
        pairs = np.unique(owner[hit] * (len(self.weight) + 1) + i[hit])
        owner, i = np.divmod(pairs, len(self.weight) + 1)
        return 1 / (1 + np.exp(-np.clip(self.raw(owner, i, len(column)), -40, 40)))


def select_features(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Buckets by association with the label, strongest first."""
    positive, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for y, i in rows:
        total[i] += 1
        positive[i] += y
    n, n1 = len(rows), sum(y for y, _ in rows)
    a, b = positive + 0.5, total - positive + 0.5
    c, d = n1 - positive + 0.5, n - n1 - (total - positive) + 0.5
    z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    strong = np.flatnonzero((np.abs(z) >= LEAST_Z) & (total >= LEAST_DOCS))
    return strong[np.argsort(-np.abs(z[strong]), kind="stable")][:FEATURES]


def train(rows: list[tuple[int, np.ndarray]]) -> Machine:
    """rows: label and distinct buckets of each document."""
    share = sum(y for y, _ in rows) / len(rows) if rows else 0.0
    none = np.full(BUCKETS, -1, np.int64)
    if share in (0.0, 1.0):
        return Machine(none, 40.0 if share else -40.0, np.zeros(1), np.zeros((1, FACTORS)))
    chosen = select_features(rows)
    none[chosen] = np.arange(len(chosen))
    data = [(y, none[i][none[i] >= 0]) for y, i in rows]
    rng = np.random.Generator(np.random.PCG64(5))
    m = Machine(none, float(np.log(share / (1 - share))), np.zeros(max(1, len(chosen))), rng.normal(0, 0.02, (max(1, len(chosen)), FACTORS)))
    g0, g1, g2 = 1e-8, np.full_like(m.weight, 1e-8), np.full_like(m.factor, 1e-8)
    for _ in range(PASSES):
        order = rng.permutation(len(data))
        for part in np.array_split(order, max(1, len(order) // 256)):
            y = np.array([data[k][0] for k in part], float)
            i = np.concatenate([data[k][1] for k in part])
            owner = np.repeat(np.arange(len(part)), [len(data[k][1]) for k in part])
            e = (1 / (1 + np.exp(-np.clip(m.raw(owner, i, len(part)), -40, 40))) - y) / len(part)
            sums = np.stack([np.bincount(owner, f[i], len(part)) for f in m.factor.T], 1)
            d0, d1, d2 = e.sum(), PENALTY * m.weight, PENALTY * m.factor
            np.add.at(d1, i, e[owner])
            np.add.at(d2, i, e[owner, None] * (sums[owner] - m.factor[i]))
            g0, g1, g2 = g0 + d0 * d0, g1 + d1 * d1, g2 + d2 * d2
            m.bias -= RATE * d0 / np.sqrt(g0)
            m.weight -= 4 * RATE * d1 / np.sqrt(g1)
            m.factor -= RATE * d2 / np.sqrt(g2)
    return m


def learned(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of a documents table: only labels of rows that are not held out teach it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((fold("doc_id", 5) != HELD_OUT) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), FIT_DOCS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bucket, owner = terms(b.column("text"))
            pairs = np.unique(owner * BUCKETS + bucket)
            cut = np.searchsorted(pairs, np.arange(b.num_rows + 1) * BUCKETS)
            own = [(pairs[a:z] % BUCKETS).astype("<i4").tobytes() for a, z in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(own, pa.binary())], names=["doc_id", "toxic", "buckets"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # the sample is bounded
    own = bounded_sample(own.select("doc_id", "toxic", "text"), FIT_DOCS, "text")  # an id may have many texts
    rows = own.mapInArrow(run, "doc_id long, toxic int, buckets binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.buckets))
    return train([(r.toxic, np.frombuffer(r.buckets, "<i4")) for r in rows])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == HELD_OUT).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(shared.value.score(b.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learned(docs, table(spark, sf_dir, "labels")))
