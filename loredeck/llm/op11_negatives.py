"""Hard negatives by an inverted multi-index with certified windows.

Vectors of whole numbers are cut into two halves, each half with a codebook of its own; a pair of codes is a cell.
For an anchor, a code bounds the inner product of the anchor's half with the half of any member: centre's product
plus and minus length times radius. A heap walks the grid of the two orders of codes (multi-sequence), so cells come
by falling sum of upper bounds, and stops at the first sum under what is certain already.

What is certain comes from the sample that the codebooks are fitted on: its rows are rows of the table, so an anchor's
fifth best of its label there is no better than its fifth best at all, and the third best of a sample's window no better
than the third best of the window. Every cell whose bounds reach that is visited, in one join of probes with cells,
and every row in it is measured: the result is exact, whatever the codebooks.

Cells of many rows (a vector that a third of the rows repeat) are cut into parts, cells that many anchors visit into
blocks of anchors; both have a bounded size. The driver holds codebooks, radii and a row per cell (at most CODES^2).

Cases: rows with a null id, label or vector, with a null or non-finite component, or of another length than most take
no part; rows that repeat an id count once, as the least label, then the least vector; ties go to the smaller id; with
fewer positives or negatives all are returned; an empty table gives an empty result; extra columns are ignored. Scores
beyond 64 bits aren't defined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.llm.common import bounded_sample, delete, materialise, table

POSITIVES, NEGATIVES, ANCHOR_EVERY, SCALE = 5, 3, 50, 256
#: Rows and bytes of the sample at most, codes of a half at most, rows of a cell aimed at, of a part, anchors of a block.
FIT_ROWS, FIT_BYTES, CODES, AIM, PART_ROWS, BLOCK_ANCHORS = 20_000, 16 << 20, 256, 256, 4096, 512
LOWEST, TOP = -(1 << 62), (1 << 62) - 1


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in doubles where these are exact."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Index:
    """Codebooks and radii of both halves, the sample, and how many parts each cell is cut into."""

    half: int
    codes: list[np.ndarray]
    radii: list[np.ndarray]
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half].astype(np.float64), x[:, self.half :].astype(np.float64)

    def nearest(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Code and distance to its centre, of both halves of each row."""
        found, far = [], []
        for h, c in zip(self.halves(x), self.codes):
            k = np.argmin((c**2).sum(1) - 2 * h @ c.T, axis=1)
            found.append(k)
            far.append(np.sqrt(((h - c[k]) ** 2).sum(1)))
        return found, far

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of an anchor's half products by code, with room for rounding."""
        up, low = [], []
        for h, c, r in zip(self.halves(anchor[None]), self.codes, self.radii):
            centre, reach = c @ h[0], np.sqrt((h[0] ** 2).sum()) * r
            room = 1e-9 * (np.abs(centre) + reach) + 1e-3
            up.append(centre + reach + room)
            low.append(centre - reach - room)
        return up, low

    def visit(self, anchor: np.ndarray, floor: float) -> Iterator[tuple[int, float, float]]:
        """Cells with rows, by falling upper bound, down to the floor: cell, upper and lower bound."""
        up, low = self.bounds(anchor)
        order = [np.argsort(-u, kind="stable") for u in up]
        u, v = up[0][order[0]], up[1][order[1]]
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < floor:
                return
            a, b = order[0][i], order[1][j]
            if self.parts[a, b]:
                yield int(a) * len(self.codes[1]) + int(b), -bound, float(low[0][a] + low[1][b])
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))


def centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    x = np.unique(x, axis=0)
    own = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        near = np.argmin((own**2).sum(1) - 2 * x @ own.T, axis=1)
        n = np.bincount(near, minlength=len(own))
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        own = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own)
    return own


def fit(rows: DataFrame, dimensions: int) -> Index:
    """Codebooks by k-means on a bounded sample; radii and parts are still to be filled."""
    sample = bounded_sample(rows, max(64, min(FIT_ROWS, FIT_BYTES // (8 * dimensions))))
    total, held = rows.count(), sample.collect()
    x = np.array([r.v for r in held], np.int64).reshape(len(held), -1)
    half, rng = max(1, dimensions // 2), np.random.Generator(np.random.PCG64(11))
    k = int(min(CODES, max(1, np.ceil(np.sqrt(total / AIM)))))
    own = Index(half, [], [], np.array([r.vec_id for r in held], np.int64), np.array([r.label for r in held]), x, np.zeros((0, 0)))
    own.codes = [centres(h, k, rng) if h.shape[1] else np.zeros((1, 0)) for h in own.halves(x)]
    return own


def usable(rows: DataFrame) -> DataFrame:
    """One row (vec_id, label, v of whole numbers) of each id that takes part; v has the length that most have."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * float(SCALE)))
    own = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    most = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.filter(F.size("v") == (most.n if most else -1))


def indexed(own: DataFrame) -> tuple[Index, DataFrame]:
    """The index of all rows, and the rows with their cells: one of each id."""
    spark = own.sparkSession
    first = own.select(F.size("v").alias("n")).first()
    index = fit(own, first.n)
    shared = spark.sparkContext.broadcast(index)
    width = len(index.codes[1])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (i, j), (r, s) = shared.value.nearest(matrix(b.column("v")))
            arrays = [pa.array((i * width + j).astype(np.int32)), *b.columns, pa.array(r), pa.array(s)]
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "vec_id", "label", "v", "r", "s"])

    single = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    cells = materialise(single.mapInArrow(assign, "cell int, vec_id long, label long, v array<long>, r double, s double"), "cells")
    index.radii = [np.zeros(len(c)) for c in index.codes]
    index.parts = np.zeros((len(index.codes[0]), width), np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect():  # at most CODES^2
        i, j = divmod(r.cell, width)
        index.radii[0][i], index.radii[1][j] = max(index.radii[0][i], r.r), max(index.radii[1][j], r.s)
        index.parts[i, j] = -(-r.n // PART_ROWS)
    shared.destroy()
    return index, cells.drop("r", "s")


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each row number, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    own = rows[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return order[place < k]


def padded(lists: pa.Array, fill: int) -> np.ndarray:
    """A list column as a matrix, short rows filled up."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), max(1, int(size.max(initial=0)))), fill, np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def measured(probes: DataFrame, cells: DataFrame, index: Index, same: bool) -> DataFrame:
    """Candidates of the probed cells: anchor_id, low, high (the window), vec_id, score.

    A probe row is (cell, anchor_id, label, v, k, low, high): up to k rows in each window, of the anchor's label or of
    others, each window taken for itself. low is what is certain, so that few rows leave a task.
    """
    spark = probes.sparkSession
    counts = [(int(i), int(index.parts.flat[i])) for i in np.flatnonzero(index.parts)]  # at most CODES^2 rows
    parts = spark.createDataFrame(counts, "cell int, parts int")
    blocks = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ANCHORS).cast("int").alias("blocks"))
    shape = F.broadcast(parts.join(blocks, "cell"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64(F.lit(2), "anchor_id"), F.col("blocks")).cast("int")
    none = F.array().cast("array<long>")
    rows = cells.join(shape, "cell").select(
        "cell", part.alias("part"), span("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "v", none.alias("low"), none.alias("high")
    )
    asked = probes.join(shape, "cell").select(
        "cell", span("parts").alias("part"), block.alias("block"), F.lit(1).alias("kind"), F.col("anchor_id").alias("vec_id"), "label", "v", "low", "high"
    )
    k = POSITIVES if same else NEGATIVES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, whole = None, [], None
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in ("cell", "part", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            out: list[tuple] = []
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if tuple(at[a, :3].tolist()) != key:
                    key, held, whole = tuple(at[a, :3].tolist()), [], None
                own = b.slice(a, z - a)
                ids, labels, x = own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("v"))
                if at[a, 3] == 0:
                    held.append((ids, labels, x))
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = tuple(np.concatenate(p) for p in zip(*held))
                scores = products(x, whole[2])
                fits = ((whole[1] == labels[:, None]) == same) & (whole[0] != ids[:, None])
                for low, high in zip(padded(own.column("low"), TOP).T, padded(own.column("high"), LOWEST).T):
                    n, m = np.nonzero(fits & (scores >= low[:, None]) & (scores <= high[:, None]))
                    some = best(n, scores[n, m], whole[0][m], k)
                    n, m = n[some], m[some]
                    out.append((ids[n], low[n], high[n], whole[0][m], scores[n, m]))
            if out:
                names = ["anchor_id", "low", "high", "vec_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    dealt = rows.unionByName(asked).repartition("cell", "part", "block").sortWithinPartitions("cell", "part", "block", "kind")
    return dealt.mapInArrow(run, "anchor_id long, low long, high long, vec_id long, score long")


PROBES = "cell int, anchor_id long, label long, v array<long>, low array<long>, high array<long>"


def probes_of(spark: SparkSession, anchors: DataFrame, index: Index, same: bool) -> DataFrame:
    """A row for each cell that an anchor must visit; anchors have vec_id, label, v and, for negatives, low and high."""
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ids, labels = matrix(b.column("v")), b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            given = list(zip(b.column("low").to_pylist(), b.column("high").to_pylist())) if not same else [([LOWEST], [TOP])] * len(ids)
            scores = products(x, own.rows)
            out: list[tuple[int, int]] = []
            lows, highs = [], []
            for n, (low, high) in enumerate(given):
                fits = ((own.labels == labels[n]) == same) & (own.ids != ids[n])
                k, certain = POSITIVES if same else NEGATIVES, []
                for a, z in zip(low, high):
                    some = scores[n][fits & (scores[n] >= a) & (scores[n] <= z)]
                    certain.append(max(a, int(np.sort(some)[-k])) if len(some) >= k else a)
                lows.append(certain)
                highs.append(high)
                a, z = np.array(certain), np.array(high)
                cells, up, down = np.array(list(own.visit(x[n], float(a.min()))) or np.zeros((0, 3))).T
                reached = cells[((up[:, None] >= a) & (down[:, None] <= z)).any(1)]
                out += [(int(cell), n) for cell in reached.tolist()]
            if out:
                at = pa.array([n for _, n in out], pa.int64())
                kind = pa.list_(pa.int64())
                arrays = [pa.array([c for c, _ in out], pa.int32()), b.column("vec_id").take(at), b.column("label").take(at), b.column("v").take(at)]
                arrays += [pa.array(lows, kind).take(at), pa.array(highs, kind).take(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "anchor_id", "label", "v", "low", "high"])

    return materialise(anchors.mapInArrow(run, PROBES), "probes")


def mined(own: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of usable()."""
    spark = own.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if own.isEmpty():
        return spark.createDataFrame([], schema)
    index, cells = indexed(own)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few rows, each with much to do
    anchors = cells.filter(is_anchor).select("vec_id", "label", "v").repartition(tasks, "vec_id")
    asked = probes_of(spark, anchors, index, True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = measured(asked, cells, index, True).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= POSITIVES)
    # 50 p <= 100 n <= 95 p has no n under a negative p
    least, most = F.expr("(score + 1) div 2"), F.expr("(score div 100) * 95 + ((score % 100) * 95) div 100")
    positives = positives.filter("score >= 0")
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("low"), most.alias("high"))
    positives = materialise(positives.filter("low <= high"), "positives")
    delete(asked)
    # a window that several positives share is searched once
    spans = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("w"))
    wanted = anchors.join(spans, "vec_id").select("vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    asked = probes_of(spark, wanted, index, False)
    # the window's low is raised to what is certain; its high tells which window it was, but two windows may share one
    found = measured(asked, cells, index, False).drop("low").dropDuplicates(["anchor_id", "high", "vec_id"])
    pairs = positives.join(found.select("anchor_id", "high", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "high"])
    near = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.filter("negative_score >= low").withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = usable(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(own.withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""
