"""Byte-level BPE encoding and decoding by the rank file of a public tokenizer.

Text is split by the tokenizer's pattern; each match that is no token itself is merged on its own. A segment
tree over its byte positions holds, at each leaf, the rank of the pair that starts there, and above, the leftmost
minimum. A merge takes the root's pair and updates three leaves (its own, the swallowed part's, the live left
neighbour's), each in logarithmic time. Short matches are merged many at a time, their trees side by side as rows
of one array; a long match gets a tree of its own. Ids of matches already seen are kept in a bounded table of each
task.

Cases: null or empty text gives no ids; every other text, however long, is encoded whole; repeated rows and ids
are encoded row by row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loredeck.llm.common import batched, binary, slices, table

NONE = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class SegmentTree:
    """Leftmost minimum over a fixed number of leaves; keys are rank * size + position."""

    def __init__(self, ranks: list[int]):
        n = len(ranks)
        self.size = size = 1 << max(0, (n - 1).bit_length())
        tree = [NONE] * (2 * size)
        tree[size : size + n] = [r * size + i if r < NONE else NONE for i, r in enumerate(ranks)]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        self.tree = tree

    def best(self) -> tuple[int, int]:
        """Rank and position of the leftmost minimum; rank NONE if no leaf has one."""
        root = self.tree[1]
        return (NONE, 0) if root >= NONE else divmod(root, self.size)

    def put(self, i: int, rank: int) -> None:
        tree, k = self.tree, self.size + i
        tree[k] = rank * self.size + i if rank < NONE else NONE
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low


class BytePairs:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, keep: int = 300_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.vocabulary: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        # the pattern's \s is Unicode white space, to which Python adds the four separators 0x1C to 0x1F
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.seen: dict[str, bytes] = {}
        self.keep = keep
        pairs = sorted((a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None)
        keys, self.pair_ranks = np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs] + [NONE], np.int64)
        self.slots = 1 << (4 * len(keys)).bit_length()
        self.slot_keys, self.slot_pairs = np.full(self.slots, -1, np.int64), np.full(self.slots, len(keys), np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        self.probes = 0
        while len(left):  # those whose slot is taken go on to the next one
            self.probes += 1
            free = self.slot_keys[at] < 0
            self.slot_keys[at[free]], self.slot_pairs[at[free]] = keys[left[free]], left[free]
            lost = self.slot_keys[at] != keys[left]
            left, at = left[lost], (at[lost] + 1) & (self.slots - 1)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # where the part that starts here ends
        start = list(range(-1, n))  # where the part that ends here starts, by end
        tree = SegmentTree([get(piece[i : i + 2], NONE) for i in range(n - 1)] or [NONE])
        while True:
            rank, i = tree.best()
            if rank == NONE:
                break
            j = end[i]
            k = end[i] = end[j]
            tree.put(j, NONE) if j < n - 1 else None
            start[k] = i
            if i < n - 1:
                tree.put(i, get(piece[i : end[k]], NONE) if k < n else NONE)
            if i > 0:
                left = start[i]
                tree.put(left, get(piece[left:k], NONE))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * -7046029254386353131) >> 40) & (self.slots - 1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if they don't merge; a negative id never does."""
        key = a << 32 | b
        at = self.slot(key)
        out = np.full(key.shape, len(self.pair_ranks) - 1)
        open_ = np.arange(key.size)
        flat, at, found = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            there = self.slot_keys[at]
            hit = there == flat[open_]
            found[open_[hit]] = self.slot_pairs[at[hit]]
            on = ~hit & (there >= 0)
            open_, at = open_[on], (at[on] + 1) & (self.slots - 1)
            if not len(open_):
                break
        return self.pair_ranks[out]

    def merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of matches of at most `size` bytes, a power of two; row r of `tree` is the segment tree of match r."""
        rows, place = len(pieces), np.arange(size)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        ids = self.byte_ids[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)].reshape(rows, size)
        ids[place >= length[:, None]] = -1
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * size), NONE, np.int64)
        rank = np.where(place[1:] < length[:, None], self.pair_rank(ids[:, :-1], ids[:, 1:]), NONE)
        tree[:, size : 2 * size - 1] = np.where(rank < NONE, rank * size + place[:-1], NONE)
        k = size // 2
        while k:
            np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2], out=tree[:, k : 2 * k])
            k //= 2
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[1 :: 2 * size] < NONE)
        while len(live):
            row, at = live * size, live * 2 * size
            rank, i = np.divmod(tree[at + 1], size)
            j = after[row + i]
            k = after[row + j]
            more = k < length[live]
            ids[row + i], ids[row + j], after[row + i] = rank, -1, k
            before[(row + k)[more]] = i[more]
            left = np.where(i > 0, before[row + i], i)
            right = np.where(more, self.pair_rank(rank, ids[row + np.minimum(k, size - 1)]), NONE)
            ahead = np.where(i > 0, self.pair_rank(ids[row + left], rank), NONE)
            tree[at + size + j] = NONE
            tree[at + size + left] = np.where(ahead < NONE, ahead * size + left, NONE)
            tree[at + size + i] = np.where(right < NONE, right * size + i, NONE)
            up = [size + i, size + j, size + left]
            for _ in range(size.bit_length() - 1):
                up = [x >> 1 for x in up]
                for x in up:
                    tree[at + x] = np.minimum(tree[at + 2 * x], tree[at + 2 * x + 1])
            live = live[tree[at + 1] < NONE]
        kept = ids >= 0
        ends = np.cumsum(kept.reshape(rows, size).sum(1)) * 4
        packed = ids[kept].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each match."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, raw in enumerate(pieces):
            rank = self.ranks.get(raw)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(raw) > 64:
                out[k] = np.array(self.merge(raw), "<u4").tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append(k)
        for size, found in by_size.items():
            for part in batched(found, (1 << 16) // size):
                for k, ids in zip(part, self.merge_rows([pieces[k] for k in part], size)):
                    out[k] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > self.keep:
            self.seen.clear()
        split = [self.find(t) for t in texts]
        new = [p for p in set().union(*split) if p not in self.seen]
        self.seen.update(zip(new, self.packed([p.encode() for p in new])))
        ids = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(ids, pieces)), "<u4") for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def coder(path: str) -> BytePairs:
    return BytePairs(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in slices(batches):
            ids = binary(bpe.encode_all([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, ids binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Length and digest of each text's ids, and the digest of what the ids decode to.

    Encoding and decoding share a pass, so that ids, larger than the text, don't leave the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in slices(batches):
            counts, of_ids, of_text = [], [], []
            for ids in bpe.encode_all([t or "" for t in b.column("text").to_pylist()]):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
