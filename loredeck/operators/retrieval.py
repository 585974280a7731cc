"""Documents that hold most words of a passage, in one pass over the documents for a block of passages.

Passages are dealt to blocks of at most about BLOCK_WORDS words by a hash of their id. A block's words, with the
passages each is in, are broadcast; each task counts, for its documents, the words they share with every passage and
keeps the first k documents of a passage, so that a word all documents hold never becomes a group of rows. What the
tasks kept is merged in two steps (a task's share of a passage is one row, and a merge takes a SALTS-th of them).

Cases: null texts and null ids take no part, passages without words aren't returned, nor those no document shares a
word with; rows that repeat an id are documents of their own. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block's passages, counts that a task holds at once, shares of a merge, words counted by a product of matrices.
BLOCK_WORDS, CELLS, SALTS, DENSE = 1 << 20, 1 << 20, 64, 1024


class Passages:
    """Words of a block of passages: sorted hashes, and of each the passages (by place) that hold it."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(w) for w in words], np.int64)
        place, flat = np.repeat(np.arange(len(words)), self.sizes), np.concatenate(words)
        order = np.argsort(flat, kind="stable")
        self.words, first = np.unique(flat[order], return_index=True)
        self.places, self.starts = place[order], np.append(first, len(order))
        # words in many passages are counted as a product of matrices, the others by their passages
        often = np.argsort(-np.diff(self.starts), kind="stable")[:DENSE]
        self.column = np.full(len(self.words), -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(words)), np.float32)
        for c, w in enumerate(often):
            self.dense[c, self.places[self.starts[w] : self.starts[w + 1]]] = 1

    def shared(self, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many of the words, each of the document `owner` says, each of n documents shares with each passage."""
        at = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        known = self.words[at] == values
        at, owner = at[known], owner[known]
        column = self.column[at]
        held = np.zeros((n, len(self.dense)), np.float32)
        held[owner[column >= 0], column[column >= 0]] = 1
        at, owner = at[column < 0], owner[column < 0]
        length = self.starts[at + 1] - self.starts[at]
        begin = np.repeat(self.starts[at] - (np.cumsum(length) - length), length)
        cells = np.repeat(owner, length) * len(self.ids) + self.places[begin + np.arange(length.sum())]
        return np.bincount(cells, minlength=n * len(self.ids)).reshape(n, -1) + (held @ self.dense).astype(np.int64)


class Best:
    """The first k documents of each passage so far, by words shared, then by smaller id; and how many hold enough."""

    def __init__(self, passages: Passages, k: int, share: float):
        self.passages, self.k, self.share = passages, k, share
        n = len(passages.ids)
        self.enough = np.zeros(n, np.int64)
        self.least = np.zeros(n, np.int64)  # words that the k-th has
        self.rows = [np.zeros((3, 0), np.int64)]  # passage, words shared, document

    def add(self, docs: np.ndarray, hits: np.ndarray) -> None:
        self.enough += (hits >= self.share * self.passages.sizes).sum(0)
        row, item = np.nonzero((hits > 0) & (hits >= self.least))
        self.rows.append(np.stack([item, hits[row, item], docs[row]]))
        if sum(r.shape[1] for r in self.rows) > 4 * self.k * len(self.enough) + CELLS // 8:
            self.settle()

    def settle(self) -> np.ndarray:
        item, hits, doc = np.concatenate(self.rows, axis=1)
        order = np.lexsort((doc, -hits, item))
        item, hits, doc = item[order], hits[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.enough)))
        rank = np.arange(len(item)) - first[item]
        last = rank == self.k - 1
        self.least[item[last]] = hits[last]
        kept = np.stack([item, hits, doc])[:, rank < self.k]
        self.rows = [kept]
        return kept


def best_documents(docs: DataFrame, words: Column, passages: DataFrame, passage_words: Column, k: int, share: float = 0.9) -> DataFrame:
    """item_id, size (distinct words), enough (documents that hold `share` of them) and top: at most k of (hits, doc_id), best first.

    `docs` has doc_id, `passages` item_id; words are expressions of distinct words on each.
    """
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    asked = passages.select("item_id", hashed(passage_words).alias("words")).filter("item_id is not null and size(words) > 0")
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(hashed(words), F.array().cast("array<long>")).alias("words")).filter("doc_id is not null")
    schema = "item_id long, size long, enough long, salt int, top array<struct<hits:long,doc_id:long>>"
    parts = [own.mapInArrow(_ranker(own, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, share), schema) for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("top")), lambda a, b: _before(a, b)), 1, k).alias("top")
    sums = [F.first("size").alias("size"), F.sum("enough").alias("enough"), merged]
    return found.groupBy("item_id", "salt").agg(*sums).groupBy("item_id").agg(*sums)


def _before(a: Column, b: Column) -> Column:
    more, same = a["hits"] > b["hits"], a["hits"] == b["hits"]
    return F.when(more | (same & (a["doc_id"] < b["doc_id"])), -1).when(same & (a["doc_id"] == b["doc_id"]), 0).otherwise(1)


def _ranker(docs: DataFrame, asked: DataFrame, k: int, share: float):
    rows = asked.orderBy("item_id").collect()  # one block
    block = Passages(np.array([r.item_id for r in rows], np.int64), [np.array(r.words, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        if not len(passages.ids):
            return
        best, n = Best(passages, k, share), max(1, CELLS // len(passages.ids))
        for b in (b.slice(s, n) for b in batches for s in range(0, b.num_rows, n)):
            words = b.column("words")
            owner = np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            best.add(b.column("doc_id").to_numpy(), passages.shared(words.flatten().to_numpy(), owner, b.num_rows))
        item, hits, doc = best.settle()
        at, size = np.unique(item, return_counts=True)
        top = pa.StructArray.from_arrays([pa.array(hits), pa.array(doc)], names=["hits", "doc_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), top)
        salt = pa.array(np.full(len(at), TaskContext.get().partitionId() % SALTS, np.int32))
        columns = [pa.array(passages.ids[at]), pa.array(passages.sizes[at]), pa.array(best.enough[at]), salt, lists]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "size", "enough", "salt", "top"])

    return run
