"""N-gram Jaccard join: every link of documents whose sets of five-word shingles overlap by 80 % or more.

Sets are ordered by one global order, rare shingles first: shingles seen often (counted over all documents) come
last, the rest by hash; any order gives the same links. Two linked sets share a shingle among the first
n - ceil(0.8 n) + 1 of each, and what either has from the first shared one on suffices for the overlap needed, so
only those prefixes are shuffled, with the place of each shingle, and only sets that can still reach the overlap
meet. Equal sets are one node from the start. Where a prefix shingle meets a few nodes, its pairs are compared;
where it meets many, they are compared with the most central ones (those whose shingles there come first). Nodes
connected by such pairs, that share enough shingles of their prefixes, are a cluster; the nodes of a cluster go,
with their sets, into cells of bounded size, and links found there are closed into components. Nodes of large
groups that are still apart and can share enough are joined in the same way, by cells of the group. No link
between components can be missed, and groups are not expanded into pairs.

The sets of a cell are joined by a prefix tree: globally ordered sets are stored as a tree, which each set walks depth first, sharing the
overlap of common beginnings; sets in a common component already are passed over, and a subtree is left as soon as the shingles that remain can't reach the overlap needed.

Cases: null, empty or blank text has no shingles, no links and its own component; one to four words are one
shingle; a row with a null doc_id takes no part and has a null component; repeated rows are equal sets; rows that
share a doc_id but not the text are nodes of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import delete, materialise, slices, table, text_bytes

WIDTH, PERCENT = 5, 80
#: Shingles counted together inside a task, the count there and in all from which one is known as frequent, and how
#: many the broadcast table of frequent shingles holds at most. They only settle the order, which any choice keeps exact.
COUNT_AT_ONCE, LOCAL_COUNT, FREQUENT, FREQUENT_AT_MOST = 1 << 22, 3, 12, 1 << 18
_HOT = np.int64(1 << 62)
#: Nodes that a prefix shingle meets up to which every pair of them is compared.
FEW = 12
#: Rows of a frequent shingle that are dealt together.
SPLIT = 1024
#: Nodes, and shingles of their sets, of one half of a cell.
CELL_SETS, CELL_SHINGLES = 512, 1 << 20
#: Pairs of a cell still apart, for each of its nodes, up to which they are compared one by one and only once.
PAIRS_A_NODE = 8
#: Bits of the filter of documents whose sets are needed; a fuller filter only lets more sets through.
BLOOM_BITS = 1 << 26


def sets_of(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingles, as non-negative 62-bit integers, of each text."""
    raw, offsets = text_bytes(column)
    starts, ends, first = words.bounds(raw, offsets)
    hashed = words.hashes(raw, starts, ends)
    return [np.unique((words.shingles(hashed[a:z], width) >> np.uint64(2)).astype(np.int64)) for a, z in zip(first, first[1:])]


def node(x: np.ndarray) -> int:
    """A 62-bit name of a set."""
    total = words.mix(np.array([words.mix(x.astype(np.uint64)).sum() + np.uint64(len(x))], np.uint64))
    return int(total[0] >> np.uint64(2))


def needed(n: int) -> int:
    """The least overlap a set of n shingles has with any set it is linked to."""
    return -(-PERCENT * n // 100)


class Order:
    """The global order: frequent shingles come last, by count; and how often each of those was seen."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        at = np.lexsort((shingle, count))
        self.count = count[at]
        self.key, place = shingle[at], np.arange(len(shingle), dtype=np.int64)
        by_key = np.argsort(self.key)
        self.key, self.place = self.key[by_key], place[by_key]

    def parts(self, ordered: np.ndarray, rows: int) -> np.ndarray:
        """Parts of about so many rows that each shingle, given as an order value, is dealt in."""
        out = np.ones(len(ordered), np.int64)
        hot = ordered >= _HOT
        if hot.any():
            out[hot] = -(-self.count[ordered[hot] - _HOT] // rows)
        return out

    def sort(self, x: np.ndarray) -> np.ndarray:
        """A set as ascending order values."""
        if not len(self.key) or not len(x):
            return x
        i = np.minimum(np.searchsorted(self.key, x), len(self.key) - 1)
        hit = self.key[i] == x
        return np.sort(np.where(hit, _HOT + self.place[i], x)) if hit.any() else x


def needed_together(n, m):
    """The least overlap of linked sets of n and m shingles (numbers or arrays)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class PrefixTree:
    """Ordered sets as a prefix tree, laid out depth first: sets in lexicographic order and how much each shares with the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.sets = sets
        self.shared = [0]
        for a, b in zip(self.order, self.order[1:]):
            n = min(len(sets[a]), len(sets[b]))
            differ = np.flatnonzero(sets[a][:n] != sets[b][:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def linked(self, probe: np.ndarray, wanted: np.ndarray | None = None, step: int = 64) -> list[int]:
        """Indices of the sets, of those wanted or all, linked with the probe."""
        found, n = [], len(probe)
        depth, overlap, passed = 0, np.zeros(1, np.int64), np.zeros(1, np.int64)  # of the path walked: shared so far, and shingles of the probe passed
        for i, shared in zip(self.order, self.shared):
            depth = min(depth, shared)
            if wanted is not None and not wanted[i]:
                continue
            x = self.sets[i]
            m = len(x)
            need = needed_together(n, m)
            overlap, passed = overlap[: depth + 1], passed[: depth + 1]
            while True:
                if overlap[-1] + min(m - depth, n - passed[-1]) < need:
                    break  # neither this set nor, below this point, the next ones of its length can reach it
                if depth == m:
                    found.append(i)
                    break
                part = x[depth : depth + step]
                at = np.searchsorted(probe, part)
                hit = probe[np.minimum(at, n - 1)] == part
                overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(hit)])
                passed = np.concatenate([passed, at + hit])
                depth += len(part)
        return found


class Forest:
    """Components of names met one after another."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = self.parent[min(a, b)] = min(a, b)


def scan(docs: DataFrame) -> tuple[DataFrame, Order]:
    """doc_id, text_key, n and node of each document, and the global order."""
    names = ["doc_id", "text_key", "n", "node", "shingle"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches):
            sets = sets_of(b.column("text"))
            held += sets
            size += sum(map(len, sets))
            n = [len(x) for x in sets]
            named = pa.array([node(x) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), named, pa.nulls(len(n), pa.int64())], names=names)
            if size > COUNT_AT_ONCE:
                yield frequent(held)
                held, size = [], 0
        if held:
            yield frequent(held)

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        x, n = x[n >= LOCAL_COUNT], n[n >= LOCAL_COUNT]
        none = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(n), none, pa.array(x)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = materialise(own.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "shingle-sets")
    counts = found.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    steps = sorted(((r.step, r.rows) for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for step, rows in steps:  # as many of the most frequent as the table holds
        total += rows
        if total > FREQUENT_AT_MOST:
            break
        least = step
    hot = counts.filter(F.floor(F.log2("n") * 4) >= least).collect() if least is not None else []
    order = Order(np.array([r.shingle for r in hot], np.int64), np.array([r.n for r in hot], np.int64))
    return found.filter("shingle is null").drop("shingle"), order


def prefixes(docs: DataFrame, order: Order) -> DataFrame:
    """Where nodes meet in prefix shingles.

    Pairs (a, b) and how often where few do; rows of nodes (a) where many do (shingle not null); and (neither) how many
    shingles of a node (a) meet any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in slices(batches):
            parts, nodes, sizes = [], [], []
            for x in sets_of(b.column("text")):
                name = node(x) if len(x) else None
                if name is None or name in done:
                    continue
                if len(done) > 200_000:
                    done.clear()
                done.add(name)
                parts.append(shared.value.sort(x)[: len(x) - needed(len(x)) + 1])
                nodes.append(name)
                sizes.append(len(x))
            if parts:
                length = [len(p) for p in parts]
                place = np.concatenate([np.arange(k, dtype=np.int32) for k in length])
                shingle, name = np.concatenate(parts), np.repeat(np.array(nodes, np.int64), length)
                of = shared.value.parts(shingle, SPLIT)
                part = np.where(of > 1, name % of, -1).astype(np.int32)
                columns = [pa.array(shingle), pa.array(part), pa.array(name), pa.array(np.repeat(np.array(sizes, np.int32), length)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "part", "node", "n", "place"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by shingle, part and node. A group that may go on is held back
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("shingle", "part", "node", "n", "place"))]
            shingle, part = rows[:2]
            before = np.flatnonzero((shingle != shingle[-1:]) | (part != part[-1:]))
            last = int(before[-1]) + 1 if len(before) else 0
            held = [r[last:] for r in rows]
            if last:
                yield joined(*(r[:last] for r in rows))
        if len(held[0]):
            yield joined(*held)

    def joined(shingle: np.ndarray, part: np.ndarray, name: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(shingle), bool)  # a node's rows of one shingle are alike
        new[1:] = (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])
        shingle, part, name, n, place = (x[new] for x in (shingle, part, name, n, place))
        first = np.ones(len(shingle), bool)
        first[1:] = (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(first) - 1
        size = np.bincount(group)[group]
        many = (size > FEW) | (part >= 0)
        pairs = []
        for d in range(1, FEW):
            i = np.flatnonzero((group[d:] == group[:-d]) & ~many[d:])
            pairs.append(np.stack([name[i], name[i + d], n[i], n[i + d], can_link(n[i], place[i], n[i + d], place[i + d])], 1))
        pairs, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        none = pa.nulls(len(pairs), pa.int64())
        few = pa.RecordBatch.from_arrays([*(pa.array(x) for x in pairs.T), pa.array(shared), none, none], names=meeting)
        rest, none = [pa.array(x[many]) for x in (name, n, place, shingle)], pa.nulls(int(many.sum()), pa.int64())
        rest = pa.RecordBatch.from_arrays([rest[0], none, rest[1], none, none, none, *rest[2:]], names=meeting)
        met, times = np.unique(name[(size > 1) | many], return_counts=True)
        none = pa.nulls(len(met), pa.int64())
        met = pa.RecordBatch.from_arrays([pa.array(met), none, none, none, none, pa.array(times), none, none], names=meeting)
        return pa.concat_batches([few, rest, met])

    meeting = ["a", "b", "n_a", "n_b", "able", "shared", "place", "shingle"]
    known = docs.filter("doc_id is not null").select("text")
    dealt = known.mapInArrow(emit, "shingle long, part int, node long, n int, place int").repartition("shingle", "part").sortWithinPartitions("shingle", "part", "node")
    return materialise(dealt.mapInArrow(meet, ", ".join(f"{c} long" for c in meeting)), "meetings")


def can_link(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first shared one stands at these places can share enough."""
    return np.minimum(n - place, m - other) >= needed_together(n, m)


def can_link_columns(a: str, b: str) -> Column:
    """The same of two columns that are structs with n and place."""
    left, right = F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place")
    return (100 + PERCENT) * F.least(left, right) >= PERCENT * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def share_needed(n_a: str, n_b: str) -> Column:
    """The least number of shingles that linked sets of these sizes share in their prefixes."""
    up = lambda x, k: F.floor((x + (k - 1)) / k)
    a, b = F.col(n_a), F.col(n_b)
    return up(PERCENT * (a + b), 100 + PERCENT) - up(PERCENT * F.greatest(a, b), 100) + 1


def places(doc_id: int) -> tuple[int, int]:
    """A document's two bits in the filter."""
    h = (doc_id * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    return (h >> 7) % BLOOM_BITS, (h >> 35) % BLOOM_BITS


def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = np.array([i for d in b.column("doc_id").to_pylist() for i in places(d)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 3).astype(np.int32)), pa.array((1 << (at & 7)).astype(np.int32))], names=["byte", "bits"])


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.concatenate([b.column(c).to_numpy().astype("<u4") for c in ("byte", "bits")])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["packed"])


def full_sets(docs: DataFrame, order: Order, nodes: DataFrame) -> DataFrame:
    """doc_id, node and ordered set (packed) of the nodes wanted, given with the doc_id of a document of each, and of a few others.

    A task gives a node once, whatever the number of its rows.
    """
    by_byte = nodes.mapInArrow(bits, "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    bloom = np.zeros(BLOOM_BITS // 8, np.uint8)  # of this size however many nodes there are
    for r in by_byte.mapInArrow(pack, "packed binary").collect():  # at most a cell for each byte of the filter
        x = np.frombuffer(r.packed, "<u4").reshape(2, -1)
        bloom[x[0]] = x[1]
    shared = docs.sparkSession.sparkContext.broadcast((order, bloom))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bloom = shared.value
        done: set[tuple[int, int]] = set()
        for b in batches:
            wanted = [all(bloom[i >> 3] >> (i & 7) & 1 for i in places(d)) for d in b.column("doc_id").to_pylist()]
            for part in slices([b.filter(pa.array(wanted, pa.bool_()))]):
                rows = [(d, node(x), order.sort(x).tobytes()) for d, x in zip(part.column("doc_id").to_pylist(), sets_of(part.column("text"))) if len(x)]
                rows = [r for r in rows if r[:2] not in done and not done.add(r[:2])]
                done = set() if len(done) > 200_000 else done
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "node", "members"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return known.mapInArrow(emit, "doc_id long, node long, members binary")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, of all nodes with edges (a, b).

    Tasks join what they hold into stars; then smallest neighbours and pointer jumps until nothing changes.
    """

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def close() -> pa.RecordBatch:
            names = [x for x in forest.parent if forest.root(x) != x]
            roots = [forest.root(x) for x in names]
            return pa.RecordBatch.from_arrays([pa.array(names + roots, pa.int64()), pa.array(roots + names, pa.int64())], names=["node", "other"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
            if len(forest.parent) > 500_000:
                yield close()
                forest.parent.clear()
        yield close()

    both = materialise(edges.mapInArrow(stars, "node long, other long").distinct(), "edges")
    label = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("comp").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = label.join(near, "node").select("node", F.least("comp", "theirs").alias("next"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("further"))
        after = materialise(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("comp"), "was"), "labels")
        delete(label)
        label = after
        if label.filter("comp <> was").isEmpty():
            delete(both)
            return label


def cells_of(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, node, n, place, met, comp, rank) dealt to cells (cell, i, j): every two rows of a key meet in one of bounded size."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    parts = sizes.select(key, F.greatest(F.ceil(F.col("rows") / CELL_SETS), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int").alias("parts"))
    placed = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    halves = F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("second")
    return placed.select(F.col(key).alias("cell"), *halves, "node", "n", "place", "met", "comp", "rank")


CELL_ROW = "cell long, i int, j int, second boolean, node long, n long, place long, met long, comp long, rank double"


def still_apart(many: DataFrame, label: DataFrame) -> DataFrame:
    """Of nodes that meet many others, those that can be linked and are in no common component.

    Where these are few for their nodes, pairs (node, other, n, n_b); else cells of nodes (other null).
    """
    rows = many.join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("shingle")
    cells = cells_of(rows.join(mixed, "shingle", "left_semi").withColumn("rank", F.col("place") / F.col("n")), "shingle")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs_of(batches, ["cell", "i", "j"]):
            able = np.triu(partners(cell))
            a, b = np.nonzero(able)
            if 0 < len(a) <= PAIRS_A_NODE * cell.num_rows:
                rows = cell.take(pa.array(a))
                other, n_b = (cell.column(c).take(pa.array(b)) for c in ("node", "n"))
            else:
                rows = cell.filter(pa.array(able.any(1) | able.any(0)))
                other = n_b = pa.nulls(rows.num_rows, pa.int64())
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([*rows.columns, other, n_b], names=[*rows.schema.names, "other", "n_b"])

    return materialise(cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, CELL_ROW + ", other long, n_b long"), "apart")


def partners(cell: pa.RecordBatch) -> np.ndarray:
    """For each two rows of a cell whether they are to be compared."""
    n, place, met, comp = (cell.column(c).to_numpy() for c in ("n", "place", "met", "comp"))
    second = cell.column("second").to_numpy(zero_copy_only=False).astype(bool)
    out = can_link(n[:, None], place[:, None], n, place) & (comp[:, None] != comp)
    # they share as many shingles of their prefixes as either has that meet any other set, at most
    out &= np.minimum(met[:, None], met) >= needed_together(n[:, None], n) - -(-PERCENT * np.maximum(n[:, None], n) // 100) + 1
    if cell.column("i")[0] != cell.column("j")[0]:  # rows of either half meet in cells of their own
        out &= second[:, None] != second
    return out


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key after another, of batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    was = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in keys], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:]):
            if held and tuple(key[a]) != was:
                yield pa.concat_batches(held)
                held = []
            was = tuple(key[a])
            held.append(b.slice(a, z - a))
    if held:
        yield pa.concat_batches(held)


def cell_links(docs: DataFrame, order: Order, own: DataFrame, cells: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join components, of the nodes of a cell: each walks the tree of the cell's sets.

    Compared are the pairs (cell, i, j, a, b) given, or else all that can be linked.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs_of(batches, ["cell", "i", "j"]):
            kind = cell.column("members").is_valid().to_numpy(zero_copy_only=False)
            asked, cell = cell.filter(pa.array(~kind)), cell.filter(pa.array(kind))
            name = cell.column("node").to_numpy()
            cell = cell.take(pa.array(np.sort(np.unique(name, return_index=True)[1])))  # a set that came from many tasks counts once
            names, comps = cell.column("node").to_pylist(), cell.column("comp").to_pylist()
            held = [np.frombuffer(m, np.int64) for m in cell.column("members").to_pylist()]
            partner: dict[int, list[int]] = {}
            if asked.num_rows:
                place = {x: k for k, x in enumerate(names)}
                for a, b in zip(asked.column("node").to_pylist(), asked.column("other").to_pylist()):
                    partner.setdefault(place[a], []).append(place[b])
                    partner.setdefault(place[b], []).append(place[a])
                asks = sorted(partner, key=lambda k: (-len(partner[k]), names[k]))  # those with most partners first
            else:
                able = np.triu(partners(cell))
                asks = np.flatnonzero(able.any(1)).tolist()
            tree, forest, found = PrefixTree(held), Forest(), []
            for k in asks:
                root, wanted = forest.root(comps[k]), np.zeros(len(names), bool)
                with_k = partner[k] if asked.num_rows else np.flatnonzero(able[k]).tolist()
                wanted[[i for i in with_k if forest.root(comps[i]) != root]] = True
                for i in tree.linked(held[k], wanted) if wanted.any() else []:
                    forest.join(comps[k], comps[i])
                    found.append((names[k], names[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    named = own.filter("doc_id is not null and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialise(named.join(cells.select("node").distinct(), "node", "left_semi"), "wanted")
    placed = cells.join(wanted.withColumnRenamed("doc_id", "of"), "node")
    sets = full_sets(docs, order, wanted)
    rows = placed.join(sets, (placed.node == sets.node) & (placed.of == sets.doc_id)).drop(sets.node).drop("of", "doc_id")
    if pairs is not None:
        rows = rows.unionByName(pairs.withColumnsRenamed({"a": "node", "b": "other"}), allowMissingColumns=True)
    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rank", "node")
    found = materialise(dealt.mapInArrow(run, "a long, b long"), "links")
    delete(wanted)
    return found


def clusters(pairs: DataFrame) -> DataFrame:
    """Cells (cell, i, j) of the pairs: connected nodes share a cell, or cells of bounded size."""
    cluster = components(pairs)
    ends = pairs.select(F.col("a").alias("node"), F.col("n_a").alias("n")).union(pairs.select("b", "n_b")).distinct()
    sizes = ends.join(cluster.select("node", "comp"), "node").groupBy("comp").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    parts = sizes.select("comp", F.greatest(F.ceil(F.col("rows") / CELL_SETS), F.ceil(F.col("total") / CELL_SHINGLES)).cast("int").alias("parts"))
    of_a = cluster.select(F.col("node").alias("a"), "comp")
    part = lambda c: F.pmod(F.xxhash64(c), "parts").cast("int")
    placed = pairs.join(of_a, "a").join(parts, "comp").select(F.col("comp").alias("cell"), F.least(part("a"), part("b")).alias("i"), F.greatest(part("a"), part("b")).alias("j"), "a", "b")
    out = materialise(placed, "clusters")
    delete(cluster)
    return out


def candidates(meetings: DataFrame, many: DataFrame, often: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) to compare first: where few meet, and of each node with the most central ones where many do."""
    row = F.struct("node", "n", "place")
    size = F.floor(F.log("n") / np.log(100 / PERCENT)).cast("int")
    sized = many.withColumn("size", size)
    central = sized.groupBy("shingle", "size").agg(F.min_by(row, F.struct(F.col("place") / F.col("n"), F.col("node"))).alias("lead"))
    central = central.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    led = sized.select("shingle", "size", row.alias("own")).join(central, ["shingle", "size"]).filter((F.col("own.node") != F.col("lead.node")) & can_link_columns("own", "lead"))
    first = F.col("own.node") < F.col("lead.node")
    pair = lambda c, a, b: (F.when(first, F.col(f"own.{c}")).otherwise(F.col(f"lead.{c}")).alias(a), F.when(first, F.col(f"lead.{c}")).otherwise(F.col(f"own.{c}")).alias(b))
    led = led.select(*pair("node", "a", "b"), *pair("n", "n_a", "n_b"), F.lit(1).cast("long").alias("able"), F.lit(0).cast("long").alias("shared"))
    few = meetings.filter("b is not null").select("a", "b", "n_a", "n_b", "able", "shared")
    pairs = few.unionByName(led).groupBy("a", "b", "n_a", "n_b").agg(F.max("able").alias("able"), F.sum("shared").alias("shared"))
    for s in ("a", "b"):
        pairs = pairs.join(often.select(F.col("node").alias(s), F.col("often").alias(f"often_{s}")), s, "left")
    there = F.least(F.coalesce("often_a", F.lit(0)), F.coalesce("often_b", F.lit(0)))
    return pairs.filter((F.col("able") > 0) & (F.col("shared") + there >= share_needed("n_a", "n_b"))).select("a", "b", "n_a", "n_b")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n and node of every document; and of every node with a link its component, the smallest node reachable."""
    own, order = scan(docs)
    meetings = prefixes(docs, order)
    many = meetings.filter("shingle is not null").select("shingle", F.col("a").alias("node"), F.col("n_a").alias("n"), "place")
    often = materialise(many.groupBy("node").agg(F.count("*").alias("often")), "often")  # prefix shingles of a node that meet many
    pairs = materialise(candidates(meetings, many, often), "pairs")

    def compared(pairs: DataFrame) -> DataFrame:
        jobs = clusters(pairs)
        nodes = jobs.select("cell", "i", "j", F.col("a").alias("node")).union(jobs.select("cell", "i", "j", "b")).distinct()
        out = cell_links(docs, order, own, nodes.withColumns({"comp": F.col("node"), "rank": F.lit(0.0)}), jobs)
        delete(jobs)
        return out

    found = compared(pairs)
    delete(pairs)
    label = components(found)
    met = meetings.filter("shingle is null and b is null").groupBy(F.col("a").alias("node")).agg(F.sum("shared").alias("met"))
    apart = still_apart(many.join(met, "node"), label)
    own_cells = apart.filter("other is null").drop("n_b")
    further = apart.filter("other is not null")
    a, b = F.struct(F.col("node").alias("x"), "n"), F.struct(F.col("other").alias("x"), F.col("n_b").alias("n"))
    further = further.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    further = further.select(F.col("a.x").alias("a"), F.col("b.x").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    more = [compared(further)] if not further.isEmpty() else []
    more += [cell_links(docs, order, own, own_cells)] if not own_cells.isEmpty() else []
    for links in more:
        found = found.union(links)
    label = components(found) if more else label
    delete(apart, often, meetings)
    return own, label


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    own, label = labelled(docs)
    named = own.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "comp").join(least, "comp").select("node", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row of each group: of the smallest id, then of the smallest hash of the text and of the row.

    Groups are of texts, so rows that share an id but not a group all stay; so do rows with a null id or without words.
    """
    own, label = labelled(docs.select(F.col(id_column).alias("doc_id"), "text"))
    known = own.filter("node is not null and doc_id is not null").join(label.select("node", "comp"), "node", "left")
    chosen = known.groupBy(F.coalesce("comp", "node")).agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    chosen = materialise(chosen.select(F.col("r.doc_id").alias("i"), F.col("r.text_key").alias("t")), "chosen")
    cast, apart = F.col(id_column).cast("long"), F.col(id_column).cast("long").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows alike in id and text are reduced to one before they are moved
    rows = docs.filter(~apart).groupBy(cast.alias("i"), F.xxhash64("text").alias("t")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    return rows.join(chosen, ["i", "t"], "left_semi").select("r.*").unionByName(docs.filter(apart))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


#: The same by comparing every pair that shares a shingle; for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
