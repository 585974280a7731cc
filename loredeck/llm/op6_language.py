"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Runs of one to three characters of the lower-cased text, all but letters read as one space, are hashed to a fixed
number of buckets; a bucket's weight in a text is its share of the text's n-grams times its inverse document
frequency. The regression is trained by follow-the-regularised-leader with an elastic net, so most weights are
exactly zero, and its confidence is then calibrated by one temperature on documents left out of training.
Texts are scored whole. Fitted on at most about FIT_DOCS labelled documents.

Cases: null text and text without a letter are `und` with score 0; with nothing to learn from, all are `und`;
ties go to the first language in order; a null doc_id is not held out; repeated rows are scored row by row.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm.common import bounded_sample, fold, slices, table

#: Hash buckets, longest n-gram, documents to fit on, of which every fifth is for the temperature.
BUCKETS, LONGEST, FIT_DOCS = 1 << 16, 3, 4000
#: FTRL: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.001, 3
#: In a filtering stage, documents whose language is less certain than this go.
LEAST_SCORE = 0.5
HELD_OUT = 2


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each position's n-grams (a row for each length), the texts' offsets, and which have a letter."""
    lowered = [t.lower() for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=offsets[1:])
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    seen = np.concatenate([[0], np.cumsum(letter)])
    code = np.where(letter, code, np.uint32(32))
    out = np.empty((LONGEST, len(code)), np.uint16 if BUCKETS <= 1 << 16 else np.uint32)
    key = np.zeros(len(code), np.uint32)
    for k in range(LONGEST):  # n-grams that reach before the text's start read what stands there as 0
        shifted = np.zeros(len(code), np.uint32)
        shifted[k:] = code[: len(code) - k] if k else code
        for j in range(k if len(code) else 0):
            shifted[np.minimum(offsets[:-1] + j, len(code) - 1)] = 0
        key = key * np.uint32(0x01000193) + (shifted + np.uint32(1)) * np.uint32(0x9E3779B1)
        out[k] = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return out, offsets, seen[offsets[1:]] > seen[offsets[:-1]]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # inverse document frequency times weight, bucket by language
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        buckets, offsets, lettered = grams(texts)
        size = np.maximum(1, np.diff(offsets))[:, None] * LONGEST
        logits = np.tile(self.bias, (len(texts), 1))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for row in buckets:
                logits[full] += np.add.reduceat(self.table[row], offsets[full], axis=0, dtype=np.float64) / size[full]
        return softmax(logits / self.temperature), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p, lettered = self.probabilities([t or "" for t in texts])
        best = p.argmax(1)
        return [self.languages[i] if ok else "und" for i, ok in zip(best, lettered)], np.where(lettered, p.max(1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal state of a multinomial regression; weights are read off the state."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] += g * g


def fit(docs: DataFrame) -> Model:
    """docs: text and non-null lang of documents to learn from."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            buckets, offsets, _ = grams([t or "" for t in b.column("text").to_pylist()])
            found = [np.unique(buckets[:, a:z].ravel(), return_counts=True) for a, z in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([i.astype("<u2").tobytes() for i, _ in found], pa.binary()), pa.array([n.astype("<f4").tobytes() for _, n in found], pa.binary())], names=["doc_id", "lang", "buckets", "counts"])

    rows = docs.mapInArrow(run, "doc_id long, lang string, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.buckets, r.lang))
    rows = [(r.lang, np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<f4")) for r in rows if r.buckets]
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    frequency = np.ones(BUCKETS)
    for _, i, _ in rows:
        frequency[i] += 1
    idf = np.log((len(rows) + 1) / frequency) + 1
    examples = [(languages.index(lang), np.append(i, BUCKETS), np.append(n / n.sum() * idf[i] * 10, 1.0)) for lang, i, n in rows]
    state, train = FollowTheLeader(len(languages)), [x for k, x in enumerate(examples) if k % 5 or len(examples) < 50]
    for _ in range(PASSES):
        for y, i, x in train:
            state.learn(i, x, y)
    weights = state.weights(slice(None))
    left = [x for k, x in enumerate(examples) if not k % 5] if len(examples) >= 50 else examples
    logits = np.array([x @ weights[i] for _, i, x in left])
    truth = np.array([y for y, _, _ in left])

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return Model(languages, (weights[:-1] * idf[:, None] * 10).astype(np.float32), weights[-1], float(temperature))


def learned(docs: DataFrame) -> Model:
    """The model of a documents table: only rows that are not held out and have a language teach it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter((fold("doc_id", 4) != HELD_OUT) & F.col("lang").isNotNull())
    return fit(bounded_sample(rows, FIT_DOCS, "text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs))
