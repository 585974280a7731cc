"""Repeated passages by sorting suffixes outside memory.

A byte goes if a string of LENGTH bytes that also starts earlier covers it. Whether a window of LENGTH bytes starts
earlier is read from an order of suffixes with their common-prefix values (LCP), made by induced sorting:

1. Sampled suffixes. Of the grams in a window the one of least hash (leftmost among equals) is its anchor; equal
   windows have equal anchors at equal places, so windows need comparing only where anchors have the same gram. An
   anchor serves a run of windows, about one anchor in 39 bytes. Anchors whose gram stands once are left.
2. Shards. Anchors with their surroundings (at most 180 bytes) are dealt by gram; a shard is whatever a task gets.
3. Induction. The suffixes at the far end of the surroundings are all equal. A step takes the order of the suffixes
   at some place and gives the order one block to the left: stably by the block before them; the LCP of neighbours
   with one block is its length and the least LCP between them in the order before. Recursion by blocks of eight
   bytes ends at the anchors; then byte by byte the suffixes that start at the windows follow. At each place,
   neighbours with an LCP of LENGTH are equal windows: the earliest stays, the others start earlier somewhere.
   A suffix that shares too little with both neighbours to become an equal window later leaves the queue.
4. Memory. A task holds some ten thousand suffixes. A gram with more goes through queues on disk: the suffix tuples
   stream from a file in pieces, each piece is sorted into runs of equal blocks (with the least LCP before the first
   and after the last tuple of each), and a heap of the pieces' runs, by block and piece, writes the next file.

The tasks that read documents do the same with what they hold before anything is shuffled: a passage that millions
of documents share leaves a task once. Their marks are final, since an earlier occurrence of a marked window is known,
and anchors with no window left to judge go no further.

Grams that stand more than once are passed to the readers in a Bloom filter of at most BLOOM_MOST bits; where they are
too many for it, anchors with surroundings are joined with them instead.

Cases: documents come in the order of doc_id (null ones first), rows that share one by a hash of their text; of rows
that repeat doc_id and text one is the first and the others are copies of it; null texts are empty; texts under LENGTH
bytes stay; long ones are read in pieces; an empty table gives an empty result; extra columns are ignored. Grams are
compared by 64-bit hashes first, windows always by their bytes.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm.common import delete, materialise, packed_bytes, slices, table, text_bytes

LENGTH, GRAM = 100, 24
#: Places of an anchor in its windows, bytes kept before and from an anchor (whole words of eight bytes).
PLACES, BEFORE, AFTER = LENGTH - GRAM + 1, 80, 104
#: Bytes of a text read at once, suffixes held in memory by a task, bits of the filter at most and for each gram.
PIECE, HELD, BLOOM_MOST, BLOOM_EACH = 1 << 20, 50_000, 1 << 29, 16
BLOCK_BITS = 16
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

CONTEXT = "gram long, doc_id long, hash long, start long, stop long, least int, most int, around binary"
SPAN = "doc_id long, hash long, start long, stop long"


# ---- sampled suffixes


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    word = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    n = len(raw) - GRAM + 1
    h = word[:n] * ODD[0]
    for k, odd in ((8, ODD[1]), (16, ODD[2])):
        h ^= h >> np.uint64(29)
        h += word[k : k + n]
        h *= odd
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the rows: gram, place in raw, first and last window (places in raw)."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = grams(raw)
    least = ((h * ODD[3]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[PLACES - width :])
    inside = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    p = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(p[1:] != p[:-1]) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    return h[p[first]].view(np.int64), p[first], at[first], at[last]


def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What is read at once: first row, place of it in that row's text, bytes, offsets of the rows."""
    if len(raw) <= PIECE:
        yield 0, 0, raw, offsets
        return
    for row, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for at in range(a, max(a + 1, z - LENGTH + 1), PIECE):
            own = raw[at : min(z, at + PIECE + LENGTH - 1)]
            yield row, at - a, own, np.array([0, len(own)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """Each gram of an anchor with the number of anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for _, _, raw, offsets in pieces(*text_bytes(part.column("text"))):
                found, n = np.unique(anchors(raw, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# ---- the filter of grams


def bloom_places(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    g = gram.view(np.uint64)
    mask = np.uint64(bits - 1)
    return ((g >> np.uint64(3)) & mask).astype(np.int64), (((g * ODD[0]) >> np.uint64(20)) & mask).astype(np.int64)


def bloom(repeated: DataFrame, bits: int) -> np.ndarray:
    """The filter's bytes; it comes to the driver in blocks of 8 kB, bits / 8 bytes together."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(bloom_places(b.column("gram").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> BLOCK_BITS).astype(np.int32)), pa.array(at)], names=["block", "at"])

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("at").to_numpy()
            at = at[np.argsort(at, kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(at >> BLOCK_BITS)) + 1) if len(at) else []:
                own = held.setdefault(int(part[0] >> BLOCK_BITS), np.zeros(1 << BLOCK_BITS, bool))
                own[part & ((1 << BLOCK_BITS) - 1)] = True
        for block, own in held.items():
            packed = np.packbits(own, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

    out = np.zeros(max(bits >> 3, 1 << (BLOCK_BITS - 3)), np.uint8)
    dealt = repeated.mapInArrow(deal, "block int, at long").repartition("block")
    for r in dealt.mapInArrow(fill, "block int, bits binary").collect():  # bits / 8 bytes, at most BLOOM_MOST / 8
        own = np.frombuffer(r.bits, np.uint8)
        out[r.block * len(own) : (r.block + 1) * len(own)] = own
    return out


# ---- induced sorting


def lead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of words that differ."""
    x = a ^ b
    return sum((x < np.uint64(1 << (8 * k))).astype(np.int32) for k in range(1, 8))


def between(lcp: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least lcp in (before, after] of each pair."""
    if not len(before):
        return np.zeros(0, lcp.dtype)
    at = np.stack([before + 1, after + 1], 1).ravel()
    return np.minimum.reduceat(np.append(lcp, np.array([32767], lcp.dtype)), at)[::2]


def step(group: np.ndarray, block: np.ndarray, lcp: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order one block to the left, and the LCP of each suffix with the one before it in that order."""
    order = np.lexsort((block, group))
    g, b = group[order], block[order]
    kin = g[1:] == g[:-1]
    same = kin & (b[1:] == b[:-1])
    out = np.zeros(len(order), np.int16)
    at = np.flatnonzero(same) + 1
    out[at] = width + between(lcp, order[at - 1], order[at])
    if width > 1:
        at = np.flatnonzero(kin & ~same) + 1
        out[at] = lead(b[at], b[at - 1])
    return order, out


def repeats(order_ids: np.ndarray, lcp: np.ndarray, age: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Which suffixes of an order are equal windows with an older one among them."""
    starts = np.flatnonzero(lcp < LENGTH)
    own = np.where(active, age[order_ids], np.iinfo(np.int64).max)
    first = np.minimum.reduceat(own, starts)
    return active & (own > np.repeat(first, np.diff(np.append(starts, len(lcp)))))


def sorted_in_memory(group: np.ndarray, around: np.ndarray, least: np.ndarray, most: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Marks [suffix, place before the anchor]: the window that starts there starts earlier too.

    group has the suffixes of a gram together; around has BEFORE bytes before the anchor and AFTER from it.
    """
    n = len(group)
    marks = np.zeros((n, PLACES), bool)
    ids, lcp = np.arange(n), np.zeros(n, np.int16)
    words = np.ascontiguousarray(around[:, BEFORE:]).view(">u8").astype(np.uint64)
    for k in range(AFTER // 8 - 1, -1, -1):
        order, lcp = step(group[ids], words[ids, k], lcp, 8)
        ids = ids[order]
    for d in range(PLACES):
        if d:
            order, lcp = step(group[ids], around[ids, BEFORE - d], lcp, 1)
            ids = ids[order]
        near = lcp >= GRAM + d  # enough for an equal window at a later place
        keep = (near | np.append(near[1:], False)) & (most[ids] >= d)
        if not keep.any():
            break
        if not keep.all():
            at = np.flatnonzero(keep)
            lcp = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
            ids = ids[at]
            lcp[0] = 0
        if (lcp >= LENGTH).any():
            marks[ids, d] = repeats(ids, lcp, age, (least[ids] <= d))
    return marks


class OnDisk:
    """The suffixes of one gram, more than memory holds: surroundings in a file, tuples in queues of files."""

    def __init__(self, folder: str):
        self.folder, self.n = Path(folder), 0
        self.files = {name: (self.folder / name).open("wb") for name in ("around", "least", "most", "age")}

    def add(self, around: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.files["around"].write(np.ascontiguousarray(around).tobytes())
        self.files["least"].write(least.astype(np.int32).tobytes())
        self.files["most"].write(most.astype(np.int32).tobytes())
        self.n += len(least)

    def opened(self, age: np.ndarray) -> None:
        self.files["age"].write(age.astype(np.int64).tobytes())
        for f in self.files.values():
            f.close()
        view = lambda name, kind, *shape: np.memmap(self.folder / name, kind, "r", shape=(self.n, *shape))
        self.around, self.age = view("around", np.uint8, BEFORE + AFTER), view("age", np.int64)
        self.least, self.most = view("least", np.int32), view("most", np.int32)
        self.marks = np.memmap(self.folder / "marks", bool, "w+", shape=(self.n, PLACES))

    def queue(self, name: str, mode: str, n: int) -> tuple[np.memmap, np.memmap]:
        return tuple(np.memmap(self.folder / f"{name}-{k}", kind, mode, shape=(n,)) for k, kind in (("id", np.int64), ("lcp", np.int16)))

    def induce(self, source: tuple[np.memmap, np.memmap], target: tuple[np.memmap, np.memmap], column: int) -> None:
        """One byte to the left: pieces are sorted into runs, a heap by block and piece puts the runs together."""
        ids, lcp = source
        sorted_ids, sorted_lcp = self.queue("runs", "w+", self.n)
        heap, least_of = [], []
        for piece, a in enumerate(range(0, self.n, HELD)):
            own, own_lcp = np.array(ids[a : a + HELD]), np.array(lcp[a : a + HELD])
            block = self.around[own, column]
            order, new = step(np.zeros(len(own), np.int8), block, own_lcp, 1)
            so_far, to_come = np.minimum.accumulate(own_lcp), np.append(np.minimum.accumulate(own_lcp[::-1])[::-1], np.int16(32767))
            sorted_ids[a : a + len(own)], sorted_lcp[a : a + len(own)] = own[order], new
            least_of.append(int(so_far[-1]))
            b = block[order]
            starts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            for s, z in zip(starts.tolist(), starts[1:].tolist()):
                heap.append((int(b[s]), piece, a + s, a + z, int(so_far[order[s]]), int(to_come[order[z - 1] + 1])))
        heapq.heapify(heap)
        at, last = 0, None
        while heap:
            block, piece, s, z, before, after = heapq.heappop(heap)
            target[0][at : at + z - s], target[1][at : at + z - s] = sorted_ids[s:z], sorted_lcp[s:z]
            if last and last[0] == block:
                target[1][at] = 1 + min([last[2], before, *least_of[last[1] + 1 : piece]])
            else:
                target[1][at] = 0
            at += z - s
            last = (block, piece, after)

    def judge(self, queue: tuple[np.memmap, np.memmap], d: int) -> None:
        """Mark equal windows that aren't the oldest: forwards against older pieces, backwards against later ones."""
        most_age, cuts = np.iinfo(np.int64).max, list(range(0, self.n, HELD))
        for backwards in (False, True):
            carry = most_age
            for a in reversed(cuts) if backwards else cuts:
                z = min(self.n, a + HELD)
                ids, lcp = np.array(queue[0][a:z]), np.array(queue[1][a:z])
                active = (self.least[ids] <= d) & (self.most[ids] >= d)
                own = np.where(active, self.age[ids], most_age)
                starts = np.flatnonzero(np.append(True, lcp[1:] < LENGTH))
                first = np.minimum.reduceat(own, starts)
                if backwards:
                    first[-1] = min(first[-1], carry)
                    carry = int(first[0]) if lcp[0] >= LENGTH else most_age
                else:
                    if lcp[0] >= LENGTH:
                        first[0] = min(first[0], carry)
                    carry = int(first[-1])
                hit = active & (own > np.repeat(first, np.diff(np.append(starts, len(ids)))))
                self.marks[ids[hit], d] = True

    def sort(self) -> np.ndarray:
        queues = [self.queue(name, "w+", self.n) for name in ("even", "odd")]
        for a in range(0, self.n, HELD):
            z = min(self.n, a + HELD)
            queues[0][0][a:z], queues[0][1][a:z] = np.arange(a, z), 0
        for column in range(BEFORE + AFTER - 1, BEFORE - PLACES, -1):
            self.induce(queues[0], queues[1], column)
            queues.reverse()
            if column <= BEFORE:
                self.judge(queues[0], BEFORE - column)
        return self.marks


# ---- what a task does with suffixes


def ages(known: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order in the corpus; one number for one place of one text."""
    order = np.lexsort((place, text, doc, known))
    new = np.zeros(len(order), bool)
    for x in (known, doc, text, place):
        y = x[order]
        new[1:] |= y[1:] != y[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def spans_of(marks: np.ndarray, known: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marked windows as spans of bytes (known, doc, text, start, stop), put together where they touch."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    start, stop = place[row] - high, place[row] - low + LENGTH
    order = np.lexsort((start, text[row], doc[row], known[row]))
    row, start, stop = row[order], start[order], stop[order]
    if not len(row):
        return known[row], doc[row], text[row], start, stop
    new = np.append(True, (known[row][1:] != known[row][:-1]) | (doc[row][1:] != doc[row][:-1]) | (text[row][1:] != text[row][:-1]))
    far = np.cumsum(new) * (int(stop.max()) + 2)  # each text's places above those of the texts before
    reach = np.maximum.accumulate(stop + far)
    cut = np.flatnonzero(np.append(True, (start + far)[1:] > reach[:-1]))
    return known[row[cut]], doc[row[cut]], text[row[cut]], start[cut], np.maximum.reduceat(stop, cut)


def span_rows(found: tuple[np.ndarray, ...]) -> list[pa.Array]:
    known, doc, text, start, stop = found
    return [pa.array(doc, mask=~known.astype(bool)), pa.array(text), pa.array(start), pa.array(stop)]


def around_of(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """BEFORE bytes before each place and AFTER from it; zeros beyond raw (no window reads them)."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), raw, np.zeros(AFTER, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + AFTER)
    return view[place]


def unpacked(around: pa.Array, most: np.ndarray) -> np.ndarray:
    """Packed surroundings back at their places."""
    raw, offsets = packed_bytes(around)
    size = np.diff(offsets)
    out = np.zeros((len(most), BEFORE + AFTER), np.uint8)
    row = np.repeat(np.arange(len(most)), size)
    out[row, np.arange(len(raw)) - np.repeat(offsets[:-1], size) + BEFORE - most[row]] = raw
    return out


def sampled(docs: DataFrame, filtered: tuple[np.ndarray, int] | None) -> DataFrame:
    """Spans found inside the tasks (around is null) and the anchors that are left to compare (CONTEXT)."""
    shared = docs.sparkSession.sparkContext.broadcast(filtered)

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, known, doc, text, place, least, most = (np.concatenate(x) for x in zip(*(h[:7] for h in held)))
        around = np.concatenate([h[7] for h in held])
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        again[:-1] |= again[1:]
        some = order[again]
        open_ = np.ones(len(gram), bool)
        if len(some):
            age = ages(known[some], doc[some], text[some], place[some])
            marks = sorted_in_memory(gram[some], around[some], least[some], most[some], age)
            once = np.zeros(len(some), bool)
            once[np.unique(age * PLACES + least[some], return_index=True)[1]] = True  # rows that repeat id and text go on once
            open_[some] = once & (marks.sum(1) < most[some] - least[some] + 1)
            found = span_rows(spans_of(marks, known[some], doc[some], text[some], place[some]))
            n = len(found[0])
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([none[0], *found, *none[1:]], names=names)
        rest = np.flatnonzero(open_)
        rest = rest[np.argsort(gram[rest], kind="stable")]
        if len(rest):
            size = (LENGTH + most - least)[rest]
            at = np.repeat(BEFORE - most[rest] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            flat = around[np.repeat(rest, size), at]
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            arrays = [pa.array(gram[rest]), pa.array(doc[rest], mask=~known[rest].astype(bool)), pa.array(text[rest]), pa.array(place[rest])]
            arrays += [pa.nulls(len(rest), pa.int64()), pa.array(least[rest].astype(np.int32)), pa.array(most[rest].astype(np.int32)), packed]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held, count = [], 0
        for part in slices(batches):
            ids = part.column("doc_id")
            known, doc = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            text = part.column("hash").to_numpy()
            for row, base, raw, offsets in pieces(*text_bytes(part.column("text"))):
                gram, p, first, last = anchors(raw, offsets)
                if bits is not None and len(gram):
                    i, j = bloom_places(gram, bits[1])
                    some = np.flatnonzero((bits[0][i >> 3] >> (i & 7)) & (bits[0][j >> 3] >> (j & 7)) & 1)
                    gram, p, first, last = gram[some], p[some], first[some], last[some]
                own = np.searchsorted(offsets, first, "right") - 1
                rows = own + row
                place = p - offsets[own] + base
                for a in range(0, len(gram), HELD):
                    z = slice(a, a + HELD)
                    held.append((gram[z], known[rows[z]], doc[rows[z]], text[rows[z]], place[z], (p - last)[z], (p - first)[z], around_of(raw, p[z])))
                    count += len(gram[z])
                    if count >= HELD:
                        yield from settle(held)
                        held, count = [], 0
        if count:
            yield from settle(held)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, CONTEXT)


def sharded(contexts: DataFrame) -> DataFrame:
    """Spans that the shards find among the anchors of all tasks."""

    def in_memory(held: list[tuple]) -> tuple[np.ndarray, ...]:
        gram, known, doc, text, place, least, most = (np.concatenate(x) for x in zip(*(h[:7] for h in held)))
        around = np.concatenate([h[7] for h in held])
        again = np.zeros(len(gram), bool)
        again[1:] = gram[1:] == gram[:-1]
        again[:-1] |= again[1:]
        s = np.flatnonzero(again)
        known, doc, text, place, least, most = (x[s] for x in (known, doc, text, place, least, most))
        return spans_of(sorted_in_memory(gram[s], around[s], least, most, ages(known, doc, text, place)), known, doc, text, place)

    def on_disk(parts: Iterator[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            own, ids = OnDisk(folder), []
            for p in parts:
                own.add(p[7], p[5], p[6])
                ids.append(p[1:5])
            known, doc, text, place = (np.concatenate(x) for x in zip(*ids))  # 32 bytes a suffix
            own.opened(ages(known, doc, text, place))
            marks = own.sort()
            for a in range(0, own.n, HELD):
                z = slice(a, a + HELD)
                yield spans_of(np.array(marks[z]), known[z], doc[z], text[z], place[z])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            if b.num_rows:
                ids, most = b.column("doc_id"), b.column("most").to_numpy()
                numbers = (b.column(c).to_numpy() for c in ("hash", "start", "least"))
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                yield b.column("gram").to_numpy(), known, ids.fill_null(0).to_numpy(), *numbers, most, unpacked(b.column("around"), most)

    def whole_grams(held: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        """Spans of grams that are complete: those that memory holds together, others on disk."""
        rows = tuple(np.concatenate(x) for x in zip(*held))
        cuts = np.append(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])), len(rows[0]))
        large = np.diff(cuts) > HELD
        for a, z in zip(cuts[:-1][large].tolist(), cuts[1:][large].tolist()):
            yield from on_disk(iter([tuple(x[a:z] for x in rows)]))
        small = np.repeat(~large, np.diff(cuts))
        yield in_memory([tuple(x[small] for x in rows)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda found: pa.RecordBatch.from_arrays(span_rows(found), names=["doc_id", "hash", "start", "stop"])
        parts, held, ahead = read(batches), [], []

        def same_gram(gram: int) -> Iterator[tuple]:
            """What is held and all that follows of a gram; the rest of the last batch is put aside."""
            yield from held
            for q in parts:
                n = int(np.searchsorted(q[0], gram, "right"))
                if n:
                    yield tuple(x[:n] for x in q)
                if n < len(q[0]):
                    ahead.append(tuple(x[n:] for x in q))
                    return

        for p in parts:
            held.append(p)
            while held and sum(len(h[0]) for h in held) > HELD:
                last = int(held[-1][0][-1])
                if held[0][0][0] == last:
                    yield from map(batch, on_disk(same_gram(last)))
                    held, ahead = ahead, []
                    continue
                rows = tuple(np.concatenate(x) for x in zip(*held))
                n = int(np.searchsorted(rows[0], last))
                yield from map(batch, whole_grams([tuple(x[:n] for x in rows)]))
                held = [tuple(x[n:] for x in rows)]
                break
        if held:
            yield from map(batch, whole_grams(held))

    left = contexts.filter("around is not null")
    return left.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPAN)


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """The spans of each (doc_id, hash) of hashed() that earlier text has too: spans array<struct<start,stop>>, unordered."""
    long = docs.filter(F.octet_length("text") >= LENGTH)
    repeated = materialise(gram_counts(long).filter("n > 1").select("gram"), "grams")
    bits = 1 << max(BLOCK_BITS, int(BLOOM_EACH * repeated.count() - 1).bit_length())
    if bits <= BLOOM_MOST:
        contexts = materialise(sampled(long, (bloom(repeated, bits), bits)), "contexts")
    else:
        again = repeated.withColumn("again", F.lit(True))
        contexts = materialise(sampled(long, None).join(again, "gram", "left").filter("around is null or again").drop("again"), "contexts")
    delete(repeated)
    within = contexts.filter("around is null").select("doc_id", "hash", "start", "stop")
    found = within.unionByName(sharded(contexts))
    return found.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash, spans (maximal removed runs, in order) and kept (the bytes left) of each row.

    Of rows that repeat doc_id and text each gets what the first of them gets.
    """
    own = hashed(docs)
    found = repeated_spans(own).hint("shuffle_hash")
    same = own["doc_id"].eqNullSafe(found["doc_id"]) & (own["hash"] == found["hash"])
    joined = own.join(found, same, "left").select(own["doc_id"], "text", own["hash"], "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in slices(batches):
            raw, offsets = text_bytes(b.column("text"))
            kept, spans = [], []
            for a, z, s in zip(offsets.tolist(), offsets[1:].tolist(), b.column("spans").to_pylist()):
                whole, runs = raw[a:z], []
                for start, stop in sorted((x["start"], x["stop"]) for x in s or []):
                    if runs and start <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], stop)
                    else:
                        runs.append({"start": start, "stop": stop})
                edges = [0, *(e for r in runs for e in (r["start"], r["stop"])), len(whole)]
                kept.append(b"".join(whole[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
                spans.append(runs)
            arrays = [b.column("doc_id"), b.column("text"), b.column("hash"), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "hash", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, text string, hash long, spans array<struct<start:long,stop:long>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, left = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "hash", size.alias("n_bytes"), (size - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    rows = rows.groupBy(*rows.columns).count()  # copies of a row: all but one are removed whole
    copy = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    out = rows.withColumn("copy", F.explode(F.transform(F.sequence(F.lit(1), F.col("count")), lambda k: k > 1)))
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
