"""Language-model scoring by a small causal self-attention model over subword ids.

Words of the lower-cased text become byte-level BPE ids, each word with a space before it; a document ends with an
end id. The model, in numpy, has one head of masked attention with a bias for places and a rectified layer; it
predicts a group of classes and a class of the group, on top of what the id before says of them. A class is one of the CLASSES - 1
most frequent ids or the rest, and an id of the rest gets its smoothed share of the rest. Documents are cut into
windows that overlap by CONTEXT ids, scored in batches, each id once and with at least so much before it.

All training documents teach it. Ids, and pairs of classes that follow each other, are counted over all of them by
Spark; weights are trained in ROUNDS: in each, every task starts from the same weights and goes through one window in
ROUNDS of each of its training documents, other windows in every round, and the tasks' weights are averaged, each by its
windows. So every window is learnt from once, and nothing but sums of fixed size meets in the driver.

The base is the smoothed unigram score of whole words. Its counts are taken over all training documents: tasks
send each word once for a block of documents, with the documents it is in; the counts are joined to these rows and
summed by document. Words so frequent that there can be but a few are joined from a table of bounded size, so
that no task gets all rows of one word.

Cases: null and blank text is the end token alone; a null doc_id is no held-out one; repeated rows are scored row by
row; with no training documents all counts are 0 and ids are equally likely; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import fold, materialise, packed_bytes, slices, table, text_bytes

FOLDS, HELD_OUT = 5, 1
#: Rounds of training, windows of a step, rate.
ROUNDS, STEP, RATE = 3, 192, 0.01
#: Windows whose vectors are found at once, so that they stay in a core's cache.
CHUNK = 96
#: Output classes and members of a group of classes, width of the model and of its rectified layer, ids of a window,
#: of those that are context only.
CLASSES, MEMBERS, WIDTH, HIDDEN, WINDOW, CONTEXT = 1024, 32, 32, 64, 32, 8
#: What the share of a class among all ids weighs against the pairs counted.
PRIOR = 20.0
#: Parts in which packed sums of all tasks are added up.
SUM_PARTS = 16
#: Text and documents of a block of word counts; a word with this share of all tokens is frequent, so at most FREQUENT are.
BLOCK_BYTES, BLOCK_DOCS, FREQUENT = 12 << 20, 60_000, 512
#: Packed ids that are scored at once.
SCORE_BYTES = 1 << 20
_END = 0  # the end id; ids of the tokenizer follow


@dataclass
class Attention:
    """Weights of the model; `classes` maps ids to classes, `rest` is the log share of an id among the rest.

    `group_told` and `member_told` are what the class before tells: log shares of groups, and within each group.
    """

    classes: np.ndarray
    rest: np.ndarray
    weights: dict[str, np.ndarray]
    group_told: np.ndarray
    member_told: np.ndarray

    @property
    def small(self) -> np.ndarray:
        """The classes of ids in two bytes each."""
        return self.classes.astype(np.int16)

    @classmethod
    def fresh(cls, count: np.ndarray, pairs: np.ndarray | None = None) -> Attention:
        """Untrained: count of each id, and of pairs of classes one after another (CLASSES by CLASSES)."""
        classes, rest = classes_of(count)
        rng = np.random.Generator(np.random.PCG64(4))
        normal = lambda *s: rng.normal(0, s[-2] ** -0.5 / 2, s).astype(np.float32)
        groups = CLASSES // MEMBERS
        w = {"embed": normal(CLASSES, WIDTH) * 8, "place": np.zeros((WINDOW, WINDOW), np.float32)}
        w |= {k: normal(WIDTH, WIDTH) for k in "qkvo"} | {"up": normal(WIDTH, HIDDEN), "down": normal(HIDDEN, WIDTH)}
        w |= {"group": normal(WIDTH, groups) / 8, "member": normal(groups, WIDTH, MEMBERS) / 8}
        w |= {"group_bias": np.zeros(groups, np.float32), "member_bias": np.zeros((groups, MEMBERS), np.float32)}
        share = np.bincount(classes, count, CLASSES) + 0.5
        share /= share.sum()
        told = (0 if pairs is None else pairs) + PRIOR * share
        told = np.broadcast_to(told, (CLASSES, CLASSES)).reshape(CLASSES, groups, MEMBERS)
        of_group = told.sum(2)
        group_told = np.log(of_group / of_group.sum(1, keepdims=True)).astype(np.float32)
        member_told = np.log(told / of_group[:, :, None]).astype(np.float32).transpose(1, 0, 2)
        return cls(classes, rest, w, group_told, np.ascontiguousarray(member_told))

    def by_class(self) -> tuple[np.ndarray, ...]:
        """Query of each class, key and what its value adds to a vector side by side, and the bias of the scored places."""
        w, t = self.weights, np.arange(WINDOW)
        bias = np.where(t[CONTEXT:, None] >= t, w["place"][CONTEXT:], w["place"].dtype.type(-1e9))
        return w["embed"] @ (w["q"] * np.float32(WIDTH**-0.5)), w["embed"] @ np.concatenate([w["k"], w["v"] @ w["o"]], 1), bias

    def body(self, before: np.ndarray, first: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        """Vectors after the scored places of ids `before` (classes, a window a row), a place a row, and what training needs."""
        w = self.weights
        of_q, of_kv, bias = tables or self.by_class()
        here = before[:, CONTEXT:]
        x, q, kv = np.take(w["embed"], here, axis=0), np.take(of_q, here, axis=0), np.take(of_kv, before, axis=0)
        a = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        a += bias
        a[first, :, :CONTEXT] = -1e9  # a document's first window has no context
        np.exp(a, out=a)
        share = 1 / (flat(a) @ np.ones(WINDOW, a.dtype))[:, None]
        c = flat(a @ kv[:, :, WIDTH:])
        c *= share
        y = flat(x) + c
        h = y @ w["up"]
        h *= h > 0
        out = h @ w["down"]
        out += y
        return out, (q, kv, a, share, c, y, h)

    def heads(self, z: np.ndarray, target: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log probability of each row's target class after class `last`, as its group's times its own within the group; and the distributions.

        Rows without a target (-1) have 0. The others are ordered by the target's group: distributions of groups and
        of members stand side by side, and so do their weights, with the biases as a last row.
        """
        w, groups = self.weights, CLASSES // MEMBERS
        group = target.astype(np.uint16) // MEMBERS  # -1 comes last
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(groups), "right")
        order = order[: ends[-1]]
        n, group, last = len(order), group[order].astype(np.intp), np.take(last, order)
        both = np.empty((groups, WIDTH + 1, groups + MEMBERS), z.dtype)
        both[:, :-1, :groups], both[:, -1, :groups], both[:, :-1, groups:], both[:, -1, groups:] = w["group"], w["group_bias"], w["member"], w["member_bias"]
        rows = np.ones((n, WIDTH + 1), z.dtype)
        rows[:, :WIDTH] = np.take(z, order, axis=0)
        p = np.empty((n, groups + MEMBERS), z.dtype)
        parts = [(g, slice(s, e)) for g, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if s < e]
        for g, at in parts:
            np.matmul(rows[at], both[g], out=p[at])
        p[:, :groups] += np.take(self.group_told, last, axis=0)
        p[:, groups:] += np.take(self.member_told.reshape(-1, MEMBERS), group * CLASSES + last, axis=0)
        at = np.arange(n) * (groups + MEMBERS)
        own = at + group, at + groups + np.take(target, order) % MEMBERS
        log = np.zeros(len(z), z.dtype)
        chosen = np.take(p, own[0]) + np.take(p, own[1])
        np.exp(p, out=p)
        total = np.stack([p[:, :groups] @ np.ones(groups, z.dtype), p[:, groups:] @ np.ones(MEMBERS, z.dtype)], 1)
        log[order] = chosen - np.log(total) @ np.ones(2, z.dtype)
        return log, (order, parts, rows, both, p, total, own)

    def gradients(self, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the scored places and its gradients; after is -1 where nothing is scored, as in the context."""
        w, groups, step = self.weights, CLASSES // MEMBERS, WINDOW - CONTEXT
        tables, chunks = self.by_class(), [slice(s, s + CHUNK) for s in range(0, len(before), CHUNK)]
        bodies = [self.body(before[at], first[at], tables) for at in chunks]
        vectors = np.concatenate([b[0] for b in bodies])
        log, (order, parts, rows, both, p, total, own) = self.heads(vectors, after[:, CONTEXT:].ravel(), before[:, CONTEXT:].ravel())
        n, dtype = max(1, len(order)), vectors.dtype
        g = {name: np.zeros_like(w[name]) for name in ("member", "member_bias", "embed", "place", "up", "down")}
        total *= n
        halves = p.reshape(-1, MEMBERS)
        halves /= total.reshape(-1, 1)
        for at in own:
            p.reshape(-1)[at] -= dtype.type(1 / n)
        of_group, of_vector = np.zeros((WIDTH + 1, groups), dtype), np.zeros_like(vectors)
        dz = np.empty((len(order), WIDTH), dtype)
        for k, at in parts:
            d = rows[at].T @ p[at]
            of_group += d[:, :groups]
            g["member"][k], g["member_bias"][k] = d[:-1, groups:], d[-1, groups:]
            np.matmul(p[at], both[k, :-1].T, out=dz[at])
        g["group"], g["group_bias"] = of_group[:-1], of_group[-1]
        of_vector[order] = dz
        dx, of_kv, of_q = np.empty((*before.shape, WIDTH), dtype), 0, 0
        scale, adds = np.float32(WIDTH**-0.5), w["v"] @ w["o"]
        back_q, back_kv = w["q"].T * scale, np.concatenate([w["k"], adds], 1).T
        for at, (_, (q, kv, a, share, c, y, h)) in zip(chunks, bodies):
            d = of_vector[at.start * step : at.stop * step]
            dh = d @ w["down"].T
            dh *= h > 0
            g["down"] += h.T @ d
            g["up"] += y.T @ dh
            dy = dh @ w["up"].T
            dy += d
            dc = dy * share
            inner = np.einsum("ij,ij->i", dc, c)
            dc = dc.reshape(q.shape)
            ds = dc @ kv[:, :, WIDTH:].transpose(0, 2, 1)
            ds -= inner.reshape(*ds.shape[:2], 1)  # the same as the sum of the shares times ds
            ds *= a
            g["place"][CONTEXT:] += ds.sum(0)
            dq = flat(ds @ kv[:, :, :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), q, out=kv[:, :, :WIDTH])
            np.matmul(a.transpose(0, 2, 1), dc, out=kv[:, :, WIDTH:])  # gradients take the places of keys and values
            x = np.take(w["embed"], before[at], axis=0)
            of_kv += flat(x).T @ flat(kv)
            of_q += flat(x[:, CONTEXT:]).T @ dq
            np.matmul(flat(kv), back_kv, out=flat(dx[at]))
            dy += dq @ back_q
            dx[at, CONTEXT:] += dy.reshape(q.shape)
        g["q"], g["k"], g["v"], g["o"] = of_q * scale, of_kv[:, :WIDTH], of_kv[:, WIDTH:] @ w["o"].T, w["v"].T @ of_kv[:, WIDTH:]
        names = before.ravel().astype(np.uint16)
        order = np.argsort(names, kind="stable")
        names = names[order]
        new = np.flatnonzero(np.diff(names.astype(np.int32), prepend=-1))
        pairs = np.take(flat(dx), order, axis=0).view(np.result_type(dtype, np.complex64))  # two numbers are added at once
        g["embed"][names[new]] = np.add.reduceat(pairs, new, axis=0).view(dtype)
        return -float(log.sum() / n), g

    def logs(self, ids: np.ndarray, offsets: np.ndarray, batch: int = 240) -> np.ndarray:
        """log10 probability of each id of documents given as ids one after another, each with its end id."""
        classes = self.small[ids]
        before, after, first, _ = windows(classes, offsets)
        out, tables = [np.zeros(0, np.float32)], self.by_class()
        for s in range(0, len(before), batch):
            e = min(s + batch, len(before))
            z = np.concatenate([self.body(before[c : min(c + CHUNK, e)], first[c : min(c + CHUNK, e)], tables)[0] for c in range(s, e, CHUNK)])
            target = after[s:e, CONTEXT:].ravel()
            out.append(self.heads(z, target, before[s:e, CONTEXT:].ravel())[0][target >= 0])
        out = np.concatenate(out)  # windows score the ids in their order
        out += np.take(self.rest, ids) * (classes == CLASSES - 1)
        return out * np.float32(1 / math.log(10))

    def score(self, ids: np.ndarray, offsets: np.ndarray, batch: int = 240) -> np.ndarray:
        """log10 probability of each document."""
        total = np.concatenate([[0], np.cumsum(self.logs(ids, offsets, batch), dtype=np.float64)])
        return total[offsets[1:]] - total[offsets[:-1]]


def classes_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and its log share of the rest, by the ids' counts."""
    count = count.astype(float)
    count[_END] += count.sum() + 1  # always a class
    kept = np.argsort(-count, kind="stable")[: CLASSES - 1]
    classes = np.full(len(count), CLASSES - 1, np.int64)
    classes[kept] = np.arange(len(kept))
    share = np.where(classes == CLASSES - 1, count + 0.1, 0)
    return classes, np.log(np.where(share > 0, share, 1) / max(share.sum(), 1e-9)).astype(np.float32)


def runs(values: np.ndarray) -> tuple[list[int], list[slice]]:
    """Values of a sorted array and where each stands."""
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    ends = [*first[1:].tolist(), len(values)]
    return values[first].tolist(), [slice(a, z) for a, z in zip(first.tolist(), ends)]


def flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def numbered(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each window, its number there, and the windows of each document."""
    n = -(-np.diff(offsets) // (WINDOW - CONTEXT))
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), n


def windows(classes: np.ndarray, offsets: np.ndarray, chosen: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Classes before and after each place of each window, whether it is a document's first, and its document.

    A document's ids are scored WINDOW - CONTEXT to a window; the first place of a document follows an end id. All
    windows, or those chosen, given by document and number.
    """
    step = WINDOW - CONTEXT
    owner, number = chosen or numbered(offsets)[:2]
    size = np.diff(offsets)[owner] - number * step  # ids from the window's first scored place on
    end = classes[offsets[1] - 1 : offsets[1]] if len(offsets) > 1 else np.zeros(1, classes.dtype)  # every document ends with the end id
    around = np.concatenate([np.repeat(end, CONTEXT + 1), classes, np.repeat(end, WINDOW)])
    each = np.lib.stride_tricks.sliding_window_view(around, WINDOW)
    at = offsets[owner] + number * step
    before, after = each[at], each[at + 1]
    before[number == 0, : CONTEXT + 1] = end
    after[:, :CONTEXT] = -1
    short = np.flatnonzero(size < step)
    place, size = np.arange(-CONTEXT, step), size[short, None]
    before[short] = np.where(place <= size, before[short], end)
    after[short] = np.where(place < size, after[short], -1)
    return before, after, number == 0, owner


class Subwords:
    """Ids of words, by hash, in a bounded table; words that are new are merged by the tokenizer's library.

    A word is encoded with a space before it, so its ids don't depend on its neighbours.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.library = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        self.line = ranks[b"\n"]
        self.table = words.WordTable("<u2" if self.size < 1 << 16 else "<u4")

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids one after another, 0 left for the end."""
        found = self.library.encode_to_numpy("".join(f" {t.decode()}\n" for t in texts)).astype(np.int64)
        at = np.flatnonzero(found == self.line)
        if len(at) != len(texts) or at[-1] != len(found) - 1:  # white space beyond ASCII joins the line's end
            each = [self.library.encode_ordinary(f" {t.decode()}") for t in texts]
            return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate([np.array(x, np.int64) for x in each]) + 1
        return np.diff(at, prepend=-1) - 1, np.delete(found, at) + 1

    def encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with its end id, and the texts' offsets."""
        data = None

        def new(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal data
            data = words.LOWER[raw].tobytes() if data is None else data
            return self.ids([data[a:z] for a, z in zip(starts[places].tolist(), ends[places].tolist())])

        ids, length = words.encoded(self.table, hashed, new)
        offsets = np.concatenate([[0], np.cumsum(length)])[first] + np.arange(len(first))
        out = np.full(offsets[-1], _END, self.table.store.dtype)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        out[body] = ids
        return out, offsets


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def packed_ids(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of packed ids one after another, and the rows' offsets."""
    raw, offsets = packed_bytes(column)
    return raw.view(dtype), offsets // dtype.itemsize


def scan(docs: DataFrame, path: str) -> DataFrame:
    """Rows of documents (word null: row, doc_id, held_out, n, ids), of words in a block of documents, and of id counts (n null).

    A word's row has its count in the block's training documents, the block, and packed: the documents' places in
    the block and the word's counts there.
    """
    names = ["word", "block", "n", "wide", "packed", "doc_id", "held_out"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        own = subwords(path)
        seen = np.zeros(own.size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        taught: list[np.ndarray] = []

        def counts() -> Iterator[pa.RecordBatch]:
            word, place = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(word)
            word, place = word[order], place[order].astype(np.int64)
            new = np.flatnonzero(np.diff(word, prepend=word[:1] ^ np.uint64(1)))
            code = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(word))))
            key = code << 16 | place
            key.sort()
            at = np.flatnonzero(np.diff(key, prepend=-1))
            n = np.diff(np.append(at, len(key)))
            key = key[at]
            code, place = key >> 16, key & 0xFFFF
            total = np.bincount(code, np.where(np.concatenate(taught)[place], n, 0)).astype(np.int64)
            wide = bool(n.max() >= 1 << 16)
            data = np.stack([place, n], 1).astype("<u4" if wide else "<u2")
            raw, unit = data.tobytes(), data.itemsize * 2
            ends = np.cumsum(np.bincount(code)) * unit
            packed = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(raw)])
            for s in range(0, len(new), 20_000):
                k = min(20_000, len(new) - s)
                columns = [pa.array(word[new[s : s + k]].view(np.int64)), pa.array(np.full(k, block)), pa.array(total[s : s + k]), pa.array([wide] * k)]
                yield pa.RecordBatch.from_arrays([*columns, packed.slice(s, k).cast(pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_())], names=names)

        for b in (b.slice(s, BLOCK_DOCS) for b in slices(batches) for s in range(0, b.num_rows, BLOCK_DOCS)):
            raw, offsets = text_bytes(b.column("text"))
            if rows and (size + len(raw) > BLOCK_BYTES or rows + b.num_rows > BLOCK_DOCS):
                if held:
                    yield from counts()
                block, size, rows, held, taught = block + (1 << 16), 0, 0, [], []
            starts, ends, first = words.bounds(raw, offsets)
            hashed = words.hashes(raw, starts, ends)
            ids, cut = own.encode(raw, starts, ends, hashed, first)
            teaches = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            seen += np.bincount(ids[np.repeat(teaches, np.diff(cut))], minlength=own.size)
            taught.append(teaches)
            if len(hashed):
                held.append((hashed, np.repeat(np.arange(rows, rows + b.num_rows, dtype=np.uint16), np.diff(first))))
            k = b.num_rows
            packed = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(cut * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [pa.nulls(k, pa.int64()), pa.array(block + rows + np.arange(k)), pa.array(np.diff(first) + 1), pa.nulls(k, pa.bool_()), packed]
            yield pa.RecordBatch.from_arrays([*columns, b.column("doc_id"), b.column("held_out")], names=names)
            size, rows = size + len(raw), rows + k
        if held:
            yield from counts()
        if seen.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array([block >> 32]), none, pa.nulls(1, pa.bool_()), pa.array([seen.tobytes()], pa.binary()), none, pa.nulls(1, pa.bool_())], names=names)

    schema = "word long, block long, n long, wide boolean, packed binary, doc_id long, held_out boolean"
    return materialise(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema), "word-rows")


def added(parts: DataFrame, dtype: type, size: int) -> np.ndarray:
    """Sum of packed arrays of a fixed size (column `packed`), a row a task: added up in SUM_PARTS tasks, then here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for b in batches:
            for x in b.column("packed"):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), dtype)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["packed"])

    rows = parts.select("packed").repartition(SUM_PARTS).mapInArrow(run, "packed binary").collect()
    return sum((np.frombuffer(zlib.decompress(r.packed), dtype) for r in rows), np.zeros(size, dtype))


def zipped(arrays: Iterable[np.ndarray]) -> pa.RecordBatch:
    data = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(data, 1)], pa.binary())], names=["packed"])


def learned(found: DataFrame, path: str) -> Attention:
    """The model, taught by all training documents of a scan."""
    context = found.sparkSession.sparkContext
    own = subwords(path)
    dtype, size = own.table.store.dtype, own.size
    texts = found.filter("word is null and n is not null and not held_out").select("block", "packed")

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("packed"):
                yield zipped([np.frombuffer(x.as_buffer(), np.int64)])

    count = added(found.filter("word is null and n is null").select("packed").mapInArrow(again, "packed binary"), np.int64, size)
    classes = context.broadcast(classes_of(count)[0])

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(CLASSES * CLASSES, np.int64), False
        for b in slices(batches, "packed", 4 << 20):
            c = classes.value[packed_ids(b.column("packed"), dtype)[0]]
            last = np.concatenate([classes.value[[_END]], c[:-1]])
            total += np.bincount(last * CLASSES + c, minlength=CLASSES * CLASSES)
            any_row = True
        if any_row:
            yield zipped([total])

    pairs = added(texts.mapInArrow(follow, "packed binary"), np.int64, CLASSES * CLASSES)
    model = Attention.fresh(count, pairs.reshape(CLASSES, CLASSES))
    classes.destroy()
    names = list(model.weights)
    length = sum(w.size for w in model.weights.values()) + 1
    for turn in range(ROUNDS):
        shared = context.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            taught = Training(shared.value, turn)
            for b in slices(batches, "packed", 4 << 20):
                ids, offsets = packed_ids(b.column("packed"), dtype)
                taught.learn(ids, offsets, b.column("block").to_numpy())
            if n := taught.finish():
                yield zipped([np.float64(n)[None], *(taught.model.weights[k].astype(np.float64).ravel() * n for k in names)])

        total = added(texts.mapInArrow(run, "packed binary"), np.float64, length)
        at = 1
        for k in names if total[0] else []:
            w = model.weights[k]
            model.weights[k] = (total[at : at + w.size] / total[0]).reshape(w.shape).astype(np.float32)
            at += w.size
        shared.destroy()
    return model


class Training:
    """A task's share of a round: Adam over the windows chosen, from the round's weights on, the rate falling."""

    def __init__(self, model: Attention, turn: int):
        self.all = np.concatenate([w.ravel() for w in model.weights.values()])
        ends = np.cumsum([w.size for w in model.weights.values()])[:-1]
        views = {k: v.reshape(w.shape) for (k, w), v in zip(model.weights.items(), np.split(self.all, ends))}
        self.model = Attention(model.classes, model.rest, views, model.group_told, model.member_told)
        self.small = model.small
        self.turn, self.steps, self.windows = turn, 0, 0
        self.m, self.s = np.zeros_like(self.all), np.zeros_like(self.all)
        self.held: list[tuple[np.ndarray, ...]] = []

    def learn(self, ids: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> None:
        owner, number, _ = numbered(offsets)
        place = (words.mix(rows.astype(np.uint64)) % np.uint64(ROUNDS)).astype(np.int64) + self.turn
        chosen = np.flatnonzero((number - place[owner]) % ROUNDS == 0)
        if not len(chosen):
            return
        before, after, first, _ = windows(self.small[ids], offsets, (owner[chosen], number[chosen]))
        self.held.append((before, after, first))
        if sum(len(x) for x, _, _ in self.held) >= 32 * STEP:
            self.finish()

    def finish(self) -> int:
        """Go through what is held; the number of windows so far."""
        if not self.held:
            return self.windows
        before, after, first = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order = np.random.Generator(np.random.PCG64(self.steps)).permutation(len(before))
        for part in np.array_split(order, -(-len(order) // STEP)):
            self.step(before[part], after[part], first[part])
        self.windows += len(order)
        return self.windows

    def step(self, before: np.ndarray, after: np.ndarray, first: np.ndarray) -> None:
        self.steps += 1
        t = self.steps
        rate = RATE / (1 + self.turn) * min(1, t / 20)
        _, g = self.model.gradients(before, after, first)
        d = np.concatenate([g[k].ravel() for k in self.model.weights])
        self.m += (d - self.m) * np.float32(0.1)
        d *= d
        self.s += (d - self.s) * np.float32(0.02)
        down = np.sqrt(self.s / np.float32(1 - 0.98**t))
        down += np.float32(1e-7)
        self.all -= self.m * np.float32(rate / (1 - 0.9**t)) / down


def scored(found: DataFrame, model: Attention, dtype: np.dtype) -> DataFrame:
    """row, doc_id, held_out, n_tokens and score of documents."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "held_out", "n_tokens", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "packed", SCORE_BYTES):
            total = pa.array(shared.value.score(*packed_ids(b.column("packed"), dtype)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "held_out", "n")), total], names=names)

    texts = found.filter("word is null and n is not null").select(F.col("block").alias("row"), "doc_id", "held_out", "n", "packed")
    return texts.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, score double")


def word_sums(rows: DataFrame, counts: DataFrame, tokens: int) -> DataFrame:
    """Document row, sum of log10(c + 0.5) over its words, and its words with c > 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            # packed sums, a row for each block of documents, so that no document is a row for each task
            row, log, known = (np.concatenate(x) for x in zip(*held))
            at, i = np.unique(row, return_inverse=True)
            log, known = np.bincount(i, log), np.bincount(i, known).astype(np.int64)
            names, where = runs(at >> 16)
            packed = [b"".join((at[w].astype("<u2").tobytes(), known[w].astype("<u4").tobytes(), log[w].tobytes())) for w in where]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["block", "sums"])

        for b in batches:
            block, c = b.column("block").to_numpy(), b.column("c").to_numpy()
            wide = b.column("wide").to_numpy(zero_copy_only=False).astype(bool)
            log = np.log10(c + 0.5)
            for kind, pick in (("<u2", np.flatnonzero(~wide)), ("<u4", np.flatnonzero(wide))):
                if not len(pick):
                    continue
                raw, ends = packed_bytes(b.column("packed") if len(pick) == len(wide) else b.column("packed").take(pa.array(pick)))
                data = raw.view(kind).reshape(-1, 2)
                of = np.repeat(pick, np.diff(ends) // (4 if kind == "<u2" else 8))
                times = data[:, 1].astype(np.int64)
                held.append((block[of] + data[:, 0], times * log[of], np.where(c[of] > 0, times, 0)))
                size += len(data)
            if size > 3_000_000:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, log, known = None, np.zeros(1 << 16), np.zeros(1 << 16, np.int64)

        def close() -> pa.RecordBatch:
            at = np.flatnonzero(log)
            out = pa.RecordBatch.from_arrays([pa.array((block << 16) + at), pa.array(log[at]), pa.array(known[at])], names=["row", "log", "known"])
            log[:], known[:] = 0, 0
            return out

        for b in batches:
            for name, raw in zip(b.column("block").to_pylist(), b.column("sums").to_pylist()):
                if block is not None and name != block:
                    yield close()
                block, n = name, len(raw) // 14
                at = np.frombuffer(raw, "<u2", n)
                known[at] += np.frombuffer(raw, "<u4", n, 2 * n)
                log[at] += np.frombuffer(raw, "<f8", n, 6 * n)
        if block is not None:
            yield close()

    # at most FREQUENT words can each have a FREQUENT-th of all tokens
    frequent = F.broadcast(counts.filter(F.col("c") * FREQUENT >= max(1, tokens)))
    split = rows.join(frequent, "word", "left")
    common = split.filter("c is not null")
    scarce = split.filter("c is null").drop("c").join(counts.filter(F.col("c") * FREQUENT < max(1, tokens)), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = lambda x: x.select("block", "c", "packed", "wide").mapInArrow(run, "block long, sums binary")
    parts = sums(common).unionByName(sums(scarce)).repartition("block").sortWithinPartitions("block")
    return parts.mapInArrow(add, "row long, log double, known long")


def scores(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = scan(own, path)
    texts = materialise(scored(found, learned(found, path), subwords(path).table.store.dtype), "scores")
    taught = texts.filter("not held_out").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).first()
    tokens, ends = taught.n or 0, taught.docs
    rows = found.filter("word is not null").select("word", "block", "n", "wide", "packed")
    counts = materialise(rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    kinds = counts.count() + (ends > 0)
    sums = word_sums(rows, counts, tokens)
    whole = float(np.log10(tokens + 0.5 * (kinds + 1)))
    base = F.coalesce("log", F.lit(0.0)) + float(np.log10(ends + 0.5)) - F.col("n_tokens") * whole
    known = F.coalesce("known", F.lit(0)) + int(ends > 0)
    return texts.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
