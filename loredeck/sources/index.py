"""A stored index of character trigrams with their places: keyword search that doesn't read the texts.

Rows are dealt to buckets by a hash of their key, a bucket's rows to blocks of bounded size. For each block there is a
row for each trigram of its lower-cased texts, with the places it stands at, counted through the block's texts and
kept as gaps of seven bits a byte, and a header row with the keys and the lengths, from which follow the documents. A bucket is a partition folder whose rows are sorted by trigram,
so a search reads the row groups of its trigrams and no others; places decide whether the trigrams of a keyword stand
side by side, so the texts themselves aren't needed. A keyword shorter than a trigram is a range of trigrams.

A changed row is brought up to date by writing its bucket again (SNK-04/12); the other buckets stay.

Cases: null columns are empty; a null key isn't indexed; a text shorter than a trigram still has one for each of its
places, filled up by an end mark; places are those of the lower-cased text.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket aimed at; rows and characters of a block at most; marks that end a column and a text.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_CHARS = 512, 2048, 4 << 20
BREAK, END = "\u0001", "\u0003"
SCHEMA = "bucket int, block int, gram string, places binary, keys array<long>, sizes array<int>"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Pieces:
    """Cuts of a column that overlap: of `size` characters, one each `step`, those of `least` or more count."""

    column: str
    size: int
    step: int
    least: int

    def last(self, length: np.ndarray) -> np.ndarray:
        return np.maximum(-(-(length - (self.size - self.step)) // self.step), 1) - 1

    def lengths(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and length of all cuts that count."""
        n = self.last(length) + 1
        row = np.repeat(np.arange(len(length)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        size = np.clip(length[row] - piece * self.step, 0, self.size)
        some = size >= self.least
        return row[some], piece[some], size[some]


# ---- building


def packed_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as groups of seven bits, the lowest first, all but the last with the eighth bit set; and the bytes of each."""
    n = np.ones(len(gaps), np.int64)
    for bits in range(7, 63, 7):
        n += gaps >> bits > 0
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    for k in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > k)
        out[ends[some] - n[some] + k] = (gaps[some] >> (7 * k) & 127) | np.where(n[some] > k + 1, 128, 0)
    return out, n


def unpacked_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((raw & 127) << shift, first)


def _gram_rows(bucket: int, block: int, keys: list[int], texts: list[list[str]]) -> pa.RecordBatch:
    """A block's rows in the order of trigrams, the header first."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    codes = np.frombuffer("".join(BREAK.join(t) + END * 2 for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([sum(map(len, t)) + len(t) - 1 for t in texts], np.int64)
    place = np.arange(size.sum())
    at = place + 2 * np.repeat(np.arange(len(texts)), size)  # two marks end each text before
    gram = (codes[at] << np.uint64(42)) | (codes[at + 1] << np.uint64(21)) | codes[at + 2]
    order = np.argsort(gram, kind="stable")
    gram, place = gram[order], place[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    chars = np.stack([(gram[first] >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)], 1).astype("<u4")
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    raw, width = packed_gaps(gaps)
    ends = np.append(np.append(0, np.cumsum(width))[first], len(raw))
    places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
    n = len(first)
    header = pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([""]), pa.nulls(1, pa.binary()),
         pa.array([keys], pa.list_(pa.int64())), pa.array([[len(c) for t in texts for c in t]], pa.list_(pa.int32()))], names=names)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(np.ascontiguousarray(chars).view("<U3").ravel().tolist(), pa.string()),
         places, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], names=names)
    return pa.Table.from_batches([header, rows]).combine_chunks().to_batches()[0]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


def _blocks(docs: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """The index rows of docs."""
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)]
    own = docs.filter(F.col(key).isNotNull()).select(_bucket(key, buckets).alias("bucket"), F.col(key).cast("long").alias("key"), *texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, keys, held, chars = None, 0, [], [], 0
        for b in batches:
            for own_bucket, k, *t in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if keys and (own_bucket != bucket or len(keys) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    yield _gram_rows(bucket, block, keys, held)
                    block, keys, held, chars = block + 1 if own_bucket == bucket else 0, [], [], 0
                bucket = own_bucket
                keys.append(k)
                held.append(t)
                chars += sum(map(len, t))
        if keys:
            yield _gram_rows(bucket, block, keys, held)

    return own.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SCHEMA)


def _write(rows: DataFrame, path: str) -> None:
    out = rows.sortWithinPartitions("bucket", "gram").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(path)


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]
    buckets: int

    @classmethod
    def build(cls, docs: DataFrame, key: str, columns: list[str], path: str) -> StoredIndex:
        """FTS-01: index all rows of docs."""
        buckets = max(1, -(-docs.count() // BUCKET_ROWS))
        _write(_blocks(docs, key, columns, buckets), path)
        return cls(docs.sparkSession, path, key, tuple(columns), buckets)

    def refresh(self, docs: DataFrame, changed: DataFrame) -> None:
        """SNK-04/12: bring the keys of `changed` (added, changed or gone) up to date with docs, by writing their buckets again."""
        touched = changed.select(_bucket(self.key, self.buckets).alias("bucket")).distinct()
        of = docs.withColumn("__bucket", _bucket(self.key, self.buckets))
        own = of.join(touched.withColumnRenamed("bucket", "__bucket"), "__bucket", "left_semi").drop("__bucket")
        empty = touched.selectExpr("bucket", "-1 block", "'' gram", "null places", "array() keys", "array() sizes")  # so that an emptied bucket is written too
        _write(_blocks(own, self.key, list(self.columns), self.buckets).unionByName(empty), self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def hits(self, required: list[str], also: tuple[str, ...] = (), inside: str | None = None, pieces: Pieces | None = None) -> DataFrame:
        """Rows (or pieces) in which every required keyword stands: key, piece, counts (of required and also), size, and for each block of rows one with key null: n, total (size), having (rows with each required keyword).

        `inside` looks in one column only. Size is the number of trigrams.
        """
        words = [w.lower() for w in [*required, *also]]
        wanted = [F.col("gram") == ""]
        grams = sorted({w[i : i + 3] for w in words for i in _cover(w)})
        wanted += [F.col("gram").isin(grams)] if grams else []
        wanted += [F.col("gram").startswith(w) for w in words if len(w) < 3]
        found = self.rows().filter(functools.reduce(operator.or_, wanted))
        find = _Finder(words, len(required), self.columns, self.columns.index(pieces.column if pieces else inside) if pieces or inside else None, pieces)
        dealt = found.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "gram")
        return dealt.mapInArrow(find, "key long, piece int, counts array<int>, size long, n long, total long, having array<long>")


# ---- searching


def _cover(word: str) -> list[int]:
    """Places of trigrams that cover a word."""
    return sorted({*range(0, len(word) - 2, 3), len(word) - 3}) if len(word) >= 3 else []


def _apart(at: np.ndarray, word: str) -> np.ndarray:
    """Of a word's places those that a search from left to right finds, without overlaps."""
    n = len(word)
    if not any(word.startswith(word[k:]) for k in range(1, n)):
        return at
    kept, last = [], -n
    for x in at.tolist():
        if x - last >= n:
            kept.append(x)
            last = x
    return np.array(kept, at.dtype)


class _Finder:
    """What the hits of a block are; a block's rows come one after another, the header first."""

    def __init__(self, words: list[str], required: int, columns: tuple[str, ...], column: int | None, pieces: Pieces | None):
        self.words, self.required, self.columns, self.column, self.pieces = words, required, columns, column, pieces

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for b in batches:
            names = [b.column(c).to_pylist() for c in ("bucket", "block", "gram", "places", "keys", "sizes")]
            for bucket, block, gram, places, keys, sizes in zip(*names):
                if (bucket, block) != key:
                    if held:
                        yield self.block(held)
                    key, held = (bucket, block), {}
                if gram == "":
                    held[""] = (keys, sizes)
                    whole = np.array(sizes, np.int64).reshape(len(keys), len(self.columns)).sum(1) + len(self.columns) - 1
                    begin = np.cumsum(whole) - whole
                else:
                    at = np.cumsum(unpacked_gaps(places))
                    doc = np.searchsorted(begin, at, "right") - 1
                    held[gram] = (doc << 32) | (at - begin[doc])
        if held:
            yield self.block(held)

    def places(self, word: str, grams: dict) -> np.ndarray:
        """Document and place (document << 32 | place) of all occurrences."""
        if len(word) < 3:
            some = [v for g, v in grams.items() if g.startswith(word) and g]
            return np.sort(np.concatenate(some)) if some else np.zeros(0, np.int64)
        parts = [(i, grams.get(word[i : i + 3], np.zeros(0, np.int64))) for i in _cover(word)]
        first, *others = sorted(parts, key=lambda p: len(p[1]))
        at = first[1] - first[0]
        for i, own in others:
            k = np.searchsorted(own, at + i)
            at = at[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] == at + i)] if len(own) else at[:0]
        return at

    def block(self, grams: dict) -> pa.RecordBatch:
        keys, sizes = (np.array(x, np.int64) for x in grams[""])
        sizes = sizes.reshape(len(keys), len(self.columns))
        starts = np.cumsum(sizes + 1, axis=1) - sizes - 1
        if self.pieces:
            row, piece, length = self.pieces.lengths(sizes[:, self.column])
        else:
            row, piece = np.arange(len(keys)), np.zeros(len(keys), np.int64)
            length = None
        unit = (row << 32) | piece
        counts = np.zeros((len(self.words), len(unit)), np.int64)
        for w, word in enumerate(self.words):
            at = self.places(word, grams)
            doc, place = at >> 32, at & 0xFFFFFFFF
            if self.column is not None:
                place = place - starts[doc, self.column]
                inside = (place >= 0) & (place + len(word) <= sizes[doc, self.column])
                doc, place = doc[inside], place[inside]
            if self.pieces:
                p = self.pieces
                low, high = np.maximum(-(-(place + len(word) - p.size) // p.step), 0), place // p.step
                n = np.maximum(high - low + 1, 0)
                doc, place, k = np.repeat(doc, n), np.repeat(place, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = (doc << 32) | k
            else:
                doc = doc << 32
            of, first = np.unique(doc, return_index=True)
            order = np.lexsort((place, doc))
            cut = np.split(place[order], np.cumsum(np.unique(doc, return_counts=True)[1])[:-1]) if len(of) else []
            overlaps = any(word.startswith(word[k:]) for k in range(1, len(word)))
            found = np.array([len(_apart(c, word)) for c in cut], np.int64) if overlaps else np.unique(doc, return_counts=True)[1]
            k = np.searchsorted(unit, of)
            there = (k < len(unit)) & (unit[np.minimum(k, max(0, len(unit) - 1))] == of) if len(unit) else np.zeros(len(of), bool)
            counts[w, k[there]] = found[there]
        size = np.maximum(length - 2, 0) if length is not None else np.maximum(sizes if self.column is None else sizes[:, [self.column]], 2).sum(1) - 2 * (len(self.columns) if self.column is None else 1)
        some = np.flatnonzero((counts[: self.required] > 0).all(0))
        m = len(some)
        having = [int(x) for x in (counts[: self.required] > 0).sum(1)]
        kind = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        columns = [
            [*keys[row[some]].tolist(), None], [*piece[some].tolist(), None], [*counts[:, some].T.tolist(), None], [*size[some].tolist(), None],
            [None] * m + [len(unit)], [None] * m + [int(size.sum())], [None] * m + [having],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)], names=["key", "piece", "counts", "size", "n", "total", "having"])


def ranked(index: StoredIndex, keywords: list[str], also: tuple[str, ...] = (), pieces: Pieces | None = None) -> DataFrame:
    """FTS-02, MTH-02: hits with relevance (higher is better); a document's or a piece's."""
    found = index.hits(keywords, also, pieces=pieces)
    stats = found.filter("key is null").agg(
        F.sum("n").alias("N"), F.sum("total").alias("length"), *(F.sum(F.col("having")[i]).alias(f"n{i}") for i in range(len(keywords)))
    )
    hits = found.filter("key is not null").select("key", "piece", "counts", "size").join(F.broadcast(stats))  # one row
    score, average = F.lit(0.0), F.col("length") / F.col("N")
    for i in range(len(keywords)):
        f = F.col("counts")[i].cast("double")
        idf = F.greatest(F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / average))
    return hits.select("key", "piece", "counts", score.alias("relevance"))
