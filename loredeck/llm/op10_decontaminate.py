"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors over hashed words, with document frequencies counted over all documents. One
randomised SVD of all passages, by subspace iteration whose products are Spark jobs over the passages, gives a latent
space of far fewer dimensions than there are passages (RANK at most, half the passages at most). Every document is read
in overlapping windows of words; a window is laid into the latent space and compared with every passage there, both
by their latent length: words that no passage has don't count, words that stand together in passages count for each
other, and a window equal to a passage has cosine one at any rank. Pairs above a cosine, whose window also reaches
far enough along the passage (a word or two don't), are candidates. A candidate
counts as a leak if the words it shares with the passage in the same order, weighed by their rarity (longest common
subsequence), make up most of the passage, or about half of it and the passage's answer, its last words, stands there
too. So copies, cut copies and paraphrases are found, while passing similarity of topic isn't enough.

Passages longer than PIECE words are retrieved by pieces of at most so many words, and judged whole.

Documents are read once for all passages of a block: BLOCK_PIECES pieces on average (or one passage of more), so what
is broadcast is bounded and no passage is given up however long the benchmark is.

Cases: null, empty or blank passages, and those of ASCII punctuation only, match nothing; null, empty or blank texts are clean; repeated documents and
passages are judged one by one; a document or a passage with a null id is compared like any other (a null id is
returned as null); with no passages, or no documents, nothing is found; extra columns are kept by the filter and
ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import slices, table, text_bytes

#: Buckets words are hashed to, dimensions of the sketch beyond the rank, power iterations.
BUCKETS, EXTRA, POWERS = 1 << 15, 16, 2
#: Words of half a window: windows of two halves start at every half.
HALF = 16
#: Words of a passage that are retrieved as one: a copy of so many always fills whole windows.
PIECE = 4 * HALF
#: Text that is compared at once, and passages its windows are compared with at once.
COMPARED_BYTES, COMPARED_PIECES = 256 << 10, 2048
#: Any byte of a word, as `words.PUNCTUATED` has it.
WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
#: Dimensions of the latent space at most, pieces of passages in a block on average; least cosine of a candidate; shares of the
#: passage that make a leak, alone and with its answer.
RANK, BLOCK_PIECES, LEAST_COSINE, WHOLE, PARTLY = 128, 1 << 15, 0.4, 0.75, 0.45
#: How far a candidate window reaches along the passage, as a share of the passage's latent length; a window holds half a piece or more.
LEAST_REACH = 0.2
#: Share of a passage's last words taken as its answer, and how much of the answer must be there.
ANSWER_PART, ANSWER_FOUND = 0.2, 0.5
MATCHES = "doc_id long, item_id long, score double, answer double, cosine double"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts one after another, and where each text's begin. Punctuation separates words."""
    raw, offsets = text_bytes(column)
    starts, ends, first = words.bounds(raw, offsets, words.PUNCTUATED)
    return words.hashes(raw, starts, ends), first


def pieces(column: pa.Array) -> list[list[str]]:
    """Each text as it is, or if it has more than PIECE words, in pieces of about as many words each."""
    raw, offsets = text_bytes(column)
    starts, ends, first = words.bounds(raw, offsets, words.PUNCTUATED)
    out = []
    for a, z in zip(first.tolist(), first[1:].tolist()):
        cuts = np.linspace(a, z, max(1, -(-(z - a) // PIECE)) + 1).astype(int).tolist() if z > a else []
        out.append([raw[starts[i] : ends[j - 1]].tobytes().decode() for i, j in zip(cuts, cuts[1:])])
    return out


def bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for b in slices(batches):
            hashed, first = word_hashes(b.column("text"))
            owner = np.repeat(np.arange(b.num_rows), np.diff(first))
            n[:-1] += np.bincount(np.unique(owner * BUCKETS + bucket(hashed)) % BUCKETS, minlength=BUCKETS)
            rows += b.num_rows
        n[-1] = rows  # the number of documents goes with them
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    n = np.zeros(BUCKETS + 1)
    for r in found:
        n[r.bucket] = r.n
    return np.log((n[-1] + 1) / (n[:-1] + 1)) + 0.1


def weighed(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' words as (row, bucket, times it stands there by rarity)."""
    hashed, first = word_hashes(column)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    key, n = np.unique(owner * BUCKETS + bucket(hashed), return_counts=True)
    row, col = np.divmod(key, BUCKETS)
    return row, col, n * idf[col]


def vector_lengths(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    row, _, value = weighed(column, idf)
    return np.maximum(1e-12, np.sqrt(np.bincount(row, value**2, len(column))))


def sparse_rows(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF vectors of length one as (row, bucket, value)."""
    row, col, value = weighed(column, idf)
    return row, col, value / vector_lengths(column, idf)[row]


def latent_basis(items: DataFrame, idf: np.ndarray, rank: int, extra: int = EXTRA, used: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors (used buckets by rank) of the passages' TF-IDF matrix, by randomised subspace iteration.

    `used` are all buckets of the passages, in ascending order (or else every bucket); the vectors are zero elsewhere.
    """
    used = np.arange(BUCKETS) if used is None else used
    context = items.sparkSession.sparkContext
    width = min(rank + extra, len(used))
    basis = np.random.Generator(np.random.PCG64(9)).normal(size=(len(used), width))

    def product(right: np.ndarray) -> np.ndarray:
        """A'A times right: each task sends the rows it touched, packed; the sums have a row a bucket."""
        shared = context.broadcast((idf, right))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, right = shared.value
            for b in slices(batches):
                row, col, value = sparse_rows(b.column("text"), idf)
                col = np.searchsorted(used, col)
                image = np.zeros((b.num_rows, width))
                np.add.at(image, row, value[:, None] * right[col])
                at, i = np.unique(col, return_inverse=True)
                out = np.zeros((len(at), width))
                np.add.at(out, i, value[:, None] * image[row])
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([x.tobytes() for x in out], pa.binary())], names=["bucket", "x"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, np.zeros(width)
            for b in batches:
                for k, x in zip(b.column("bucket").to_pylist(), b.column("x").to_pylist()):
                    if at is not None and k != at:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "x"])
                        total = np.zeros(width)
                    at, total = k, total + np.frombuffer(x)
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "x"])

        parts = items.select("text").mapInArrow(run, "bucket int, x binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket int, x binary")
        out = np.zeros((len(used), width))
        for r in parts.collect():
            out[r.bucket] = np.frombuffer(r.x)
        shared.destroy()
        return out

    for _ in range(POWERS):
        basis = np.linalg.qr(product(basis))[0]
    image = product(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    strong = np.argsort(-values)[:rank]
    strong = strong[values[strong] > 1e-9]
    return basis @ turn[:, strong]


@dataclass
class Passages:
    """A block of passages with all that a task needs to find them."""

    ids: list[list[int | None]]  # of the passages that share a text
    hashes: list[np.ndarray]
    whole: np.ndarray  # the passage of each piece
    idf: np.ndarray
    place: np.ndarray  # bucket -> its row of `coordinates`, -1 if no passage has it
    coordinates: np.ndarray  # a bucket's latent vector times idf
    latent: np.ndarray  # each piece's latent vector, of length one
    length: np.ndarray  # what its length was, with words weighed as in a window

    @classmethod
    def of(cls, ids: list[list[int | None]], texts: list[str], idf: np.ndarray, basis: np.ndarray, buckets: np.ndarray | None = None) -> Passages:
        buckets = np.arange(BUCKETS) if buckets is None else buckets
        hashed, first = word_hashes(pa.array(texts, pa.string()))
        parts = pieces(pa.array(texts, pa.string()))
        whole = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
        row, col, value = sparse_rows(pa.array([x for part in parts for x in part], pa.string()), idf)
        latent = np.zeros((len(whole), basis.shape[1]))
        np.add.at(latent, row, value[:, None] * basis[np.searchsorted(buckets, col)])
        length = np.maximum(1e-9, np.linalg.norm(latent, axis=1))
        latent /= length[:, None]
        length *= vector_lengths(pa.array([x for part in parts for x in part], pa.string()), idf)
        place = np.full(BUCKETS, -1, np.int64)
        place[buckets] = np.arange(len(buckets))
        coordinates = (basis * idf[buckets, None]).astype(np.float32)
        return cls(ids, [hashed[a:z] for a, z in zip(first, first[1:])], whole, idf, place, coordinates, latent.astype(np.float32), length.astype(np.float32))

    def candidates(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, first and last word (in the text), passage and cosine of windows like a piece of a passage."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        halves = -(-np.diff(first) // HALF)
        start = np.concatenate([[0], np.cumsum(halves)])  # each text's first half
        half = start[owner] + (np.arange(len(hashed)) - first[owner]) // HALF
        at = bucket(hashed)
        row = self.place[at]
        use = np.flatnonzero(row >= 0)
        z = np.zeros((start[-1] + 1, self.coordinates.shape[1]), np.float32)
        if len(use):
            new = np.flatnonzero(np.diff(half[use], prepend=-1))
            z[half[use][new]] = np.add.reduceat(self.coordinates[row[use]], new, axis=0)
        text = np.repeat(np.arange(len(first) - 1), halves)
        joined = np.append(text[1:] == text[:-1], False)
        window = z[:-1] + np.where(joined[:, None], z[1:], 0)
        size = np.maximum(1e-6, np.linalg.norm(window, axis=1))
        window /= size[:, None]
        found = []
        for a in range(0, len(self.whole), COMPARED_PIECES):
            cosine = window @ self.latent[a : a + COMPARED_PIECES].T
            w, piece = np.nonzero(cosine >= np.maximum(LEAST_COSINE, LEAST_REACH * self.length[None, a : a + COMPARED_PIECES] / size[:, None]))
            found.append((w, piece + a, cosine[w, piece]))
        w, piece, cosine = (np.concatenate(x) for x in zip(*found))
        begin = (w - start[text[w]]) * HALF
        return text[w], begin, begin + 2 * HALF, self.whole[piece], cosine

    def plausible(self, jobs: list[tuple], hashed: np.ndarray, first: np.ndarray) -> list[tuple]:
        """The jobs (text, passage, first and last word, cosine) whose words stand for PARTLY of the passage, in whatever order."""
        known = np.unique(np.concatenate(self.hashes))
        number = np.searchsorted(known, hashed)
        number[known[np.minimum(number, len(known) - 1)] != hashed] = len(known)
        seen = np.zeros(len(known) + 1, bool)
        own: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        out = []
        for job in jobs:
            t, i, a, z, _ = job
            if i not in own:
                weight = self.idf[bucket(self.hashes[i])]
                own[i] = np.searchsorted(known, self.hashes[i]), weight, PARTLY * weight.sum()
            region = number[first[t] + a : min(first[t] + z, first[t + 1])]
            seen[region] = True
            seen[-1] = False
            words_of, weight, least = own[i]
            if weight[seen[words_of]].sum() >= least:
                out.append(job)
            seen[region] = False
        return out

    def matches(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """Row, passage, share of the passage in order, share of its answer, cosine; the best for each row and passage."""
        hashed, first = word_hashes(column)
        if not len(hashed) or not len(self.ids):
            return []
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        regions: dict[tuple[int, int], list[list]] = {}
        for t, a, z, i, c in zip(*(x.tolist() for x in self.candidates(hashed, first))):
            n = len(self.hashes[i])
            a, z = max(0, a - n), z + n
            spans = regions.setdefault((t, i), [])
            if spans and a <= spans[-1][1] and z - spans[-1][0] <= 4 * (n + HALF):  # windows of one place are looked at together
                spans[-1][1], spans[-1][2] = z, max(c, spans[-1][2])
            else:
                spans.append([a, z, c])
        jobs = self.plausible([(t, i, *x) for (t, i), spans in regions.items() for x in spans], hashed, first)
        jobs = [(t, i, hashed[first[t] : first[t + 1]][a:z], c) for t, i, a, z, c in jobs]
        jobs.sort(key=lambda j: (len(self.hashes[j[1]]), len(j[2])))
        k = 0
        while k < len(jobs):
            part = jobs[k : k + max(1, min(256, (1 << 18) // (4 * (len(self.hashes[jobs[min(k + 255, len(jobs) - 1)][1]]) + HALF))))]
            k += len(part)
            shares = common_share([self.hashes[i] for _, i, _, _ in part], [region for _, _, region, _ in part], self.idf)
            for (t, i, region, c), share in zip(part, shares):
                if share < PARTLY:
                    continue
                tail = self.hashes[i][-max(1, round(ANSWER_PART * len(self.hashes[i]))) :]
                answer = float(np.isin(tail, region).mean())
                if share >= WHOLE or (share >= PARTLY and answer >= ANSWER_FOUND):
                    best[t, i] = max(best.get((t, i), (0.0, 0.0, 0.0)), (float(share), answer, float(c)))
        return [(t, i, *x) for (t, i), x in best.items()]


def common_share(passages: list[np.ndarray], regions: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Weight of the heaviest common subsequence of each passage and region, as a share of the passage's weight."""
    rows, n, m = len(passages), max(map(len, passages)), max(map(len, regions))
    a, b = np.zeros((rows, n), np.uint64), np.zeros((rows, m), np.uint64)
    there = np.zeros((rows, n), bool)
    for r, (x, y) in enumerate(zip(passages, regions)):
        a[r, : len(x)], b[r, : len(y)], there[r, : len(x)] = x, y, True
    weight = np.where(there, idf[bucket(a)], 0.0)
    total = np.zeros((rows, m + 1))
    for i in range(n):
        step = total[:, :-1] + np.where(b == a[:, i : i + 1], weight[:, i : i + 1], 0.0)
        total[:, 1:] = np.maximum.accumulate(np.maximum(total[:, 1:], step), axis=1)
    return total[:, -1] / np.maximum(1e-9, weight.sum(1))


def blocks(items: DataFrame, docs: DataFrame) -> Iterator[Passages]:
    """The benchmark in blocks of bounded size, in one latent space of all passages, with statistics of these documents."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x for part in pieces(b.column("text")) for x in part], pa.string())], names=["text"])

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(bucket(word_hashes(b.column("text"))[0])))], names=["bucket"])

    passages = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(WORD))
    parts = passages.select("text").mapInArrow(cut, "text string")
    n = parts.count()
    if not n:
        return
    idf = rarity(docs)
    used = np.array(sorted(r.bucket for r in parts.mapInArrow(buckets, "bucket long").distinct().collect()), np.int64)  # at most BUCKETS
    basis = latent_basis(parts, idf, max(1, min(RANK, n // 2)), used=used)
    dealt = -(-n // BLOCK_PIECES)  # by a hash of the text
    for k in range(dealt):
        rows = (passages.filter(F.pmod(F.xxhash64("text"), F.lit(dealt)) == k) if dealt > 1 else passages).orderBy("item_id", "text").collect()
        # of a text that many passages share, all ids are kept, but it is compared once
        by_text: dict[str, list[int | None]] = {}
        for r in rows:
            by_text.setdefault(r.text, []).append(r.item_id)
        if by_text:
            yield Passages.of(list(by_text.values()), list(by_text), idf, basis, used)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, answer and cosine of each leak; documents without one don't appear."""
    out = docs.sparkSession.createDataFrame([], MATCHES)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in blocks(items, own):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, max_bytes=COMPARED_BYTES):
                found = [(t, item, *x) for t, i, *x in shared.value.matches(b.column("text")) for item in shared.value.ids[i]]
                if found:
                    row, item, *figures = zip(*found)
                    arrays = [b.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in figures)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "score", "answer", "cosine"])

        out = out.unionByName(own.mapInArrow(run, MATCHES))
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, that leak no passage."""
    out = docs
    for block in blocks(items, docs.select("doc_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, max_bytes=COMPARED_BYTES):
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in shared.value.matches(b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
