"""Approximate nearest neighbours: inverted lists scanned by adaptive dimensions.

Vectors are dealt to the lists of their nearest centroids. A query probes its nearest lists, as many as a
calibration against brute force on the fitting sample asks for. Inside a list, vectors are rotated by one random
orthogonal matrix and read in blocks of columns: the partial distance over the first d of D dimensions estimates
the whole one, and a candidate is left as soon as a test says that it lies beyond the tenth nearest so far. What
survives is measured exactly, in double precision, on the original vectors. Large lists and long rows of queries
are cut into cells of bounded size.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; rows with a null id neither; a query's own id is no candidate; of rows that repeat an id the nearest
vector counts, and as a query the least in order of components; ties go to the smaller
id; with fewer than ten candidates all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.llm.common import bounded_sample, materialise, table

#: Neighbours, rows the index is fitted on, most lists, recall of the probed lists asked for in the calibration.
NEAREST, FIT_ROWS, LISTS_AT_MOST, RECALL = 10, 20_000, 4096, 0.99
#: Vectors and queries of a cell, columns of a block, and how far beyond the estimate a candidate is left.
CELL_ROWS, CELL_QUERIES, COLUMNS, EPSILON = 4096, 512, 8, 3.0
QUERY_EVERY = 100


@dataclass
class Lists:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists of each row, nearest first."""
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        k = min(k, d.shape[1])
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def usable(vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0)).select("vec_id", v.alias("v"))
    return out.filter(F.size("v") == dimensions) if dimensions else out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(vectors: DataFrame) -> Lists:
    """Centroids by k-means on a bounded sample, and the number of probes by brute force on it."""
    sample = bounded_sample(vectors.select("v"), FIT_ROWS)
    total = vectors.count()
    x = np.unique(np.array([r.v for r in sample.select("v").collect()]), axis=0).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(3))
    k = int(min(LISTS_AT_MOST, max(1, np.sqrt(total)), max(1, len(x) // 8)))
    own = Lists(x[rng.choice(len(x), k, replace=False)], np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0], 1)
    for _ in range(8):
        nearest = own.nearest(x, 1)[:, 0]
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(own.centroids)
        np.add.at(sums, nearest, x)
        own.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], own.centroids).astype(np.float32)
    home = own.nearest(x, 1)[:, 0]
    tried = rng.choice(len(x), min(200, len(x)), replace=False)
    d = (x**2).sum(1) - 2 * x[tried] @ x.T
    near = np.argsort(d, axis=1)[:, 1 : NEAREST + 1]
    ranked = own.nearest(x[tried], k)
    place = np.argsort(ranked, axis=1)
    depth = np.sort(np.take_along_axis(place, home[near], 1).ravel())
    own.probes = int(depth[min(len(depth) - 1, int(RECALL * len(depth)))]) + 1 if len(depth) else 1
    return own


def scan(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, rotation: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Update each query's best (distances, ids) with the rows of x."""
    dimensions = x.shape[1]
    turned, q_turned = x @ rotation, queries @ rotation
    for k, (q, qt, own) in enumerate(zip(queries, q_turned, query_ids)):
        far = best[k][0][-1] ** 2 if len(best[k][0]) >= NEAREST else np.inf
        slack = 1e-9 * float(q @ q)
        alive = np.flatnonzero(ids != own)
        partial = np.zeros(len(alive))
        for d in range(0, dimensions, COLUMNS):
            partial += ((turned[alive, d : d + COLUMNS] - qt[d : d + COLUMNS]) ** 2).sum(1)
            seen = min(dimensions, d + COLUMNS)
            if np.isinf(far) and len(alive) > 4 * NEAREST and seen == 2 * COLUMNS:
                first = alive[np.argpartition(partial, 2 * NEAREST)[: 2 * NEAREST]]
                near = np.sort(((x[first] - q) ** 2).sum(1))
                far = near[NEAREST - 1] if len(np.unique(ids[first])) == len(first) else np.inf
            reach = min(1.0, (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dimensions)
            keep = partial <= far * reach * (1 + 1e-9) + slack
            alive, partial = alive[keep], partial[keep]
        if len(alive):
            distance = np.sqrt(((x[alive] - q) ** 2).sum(1))
            d, i = np.concatenate([best[k][0], distance]), np.concatenate([best[k][1], ids[alive]])
            order = np.lexsort((i, d))
            d, i = d[order], i[order]
            first = np.sort(np.unique(i, return_index=True)[1])[:NEAREST]  # of an id with many vectors the nearest counts
            best[k] = (d[first], i[first])


def search(vectors: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest vectors."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = usable(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    known = usable(vectors, sizes.n)
    lists = spark.sparkContext.broadcast(fit(known))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = lists.value.nearest(matrix(b.column("v")), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *b.columns], names=["list", "vec_id", "v", "query"])

    dealt = materialise(known.select("vec_id", "v", is_query.alias("query")).mapInArrow(deal, "list int, vec_id long, v array<double>, query boolean"), "lists")
    held = {r.list: r.n for r in dealt.groupBy("list").agg(F.count_distinct("vec_id").alias("n")).collect()}  # a row a list, at most LISTS_AT_MOST
    counts = np.array([held.get(i, 0) for i in range(len(lists.value.centroids))])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranked = lists.value.nearest(matrix(b.column("v")), len(counts))
            reached = np.cumsum(counts[ranked], axis=1)
            need = np.maximum(lists.value.probes, (reached < 2 * NEAREST + 2).sum(1) + 1)  # so that small lists don't leave a query short
            rows = np.repeat(np.arange(b.num_rows), np.minimum(need, len(counts)))
            probed = np.concatenate([r[:n] for r, n in zip(ranked, need)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(probed), b.column("vec_id").take(pa.array(rows)), b.column("v").take(pa.array(rows))], names=["list", "vec_id", "v"])

    asked = dealt.filter("query").groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(probe, "list int, vec_id long, v array<double>")
    asked = materialise(asked, "probes")
    # cells: a list's vectors by queries, each cut into parts of bounded size
    parts = dealt.groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("blocks")), "list")
    parts = F.broadcast(parts)  # a row a list, at most LISTS_AT_MOST
    part, block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("blocks")).cast("int")
    rows = dealt.select("list", "vec_id", "v").join(parts, "list").select("list", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    probes = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, queries, best = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if best:
                n = [len(i) for _, i in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.concatenate([i for _, i in best]).astype(np.int64)), pa.array(np.concatenate([d for d, _ in best]))], names=["query_id", "vec_id", "score"])

        for b in batches:
            cells = np.stack([b.column(c).to_numpy() for c in ("list", "part", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                cell = tuple(cells[a, :3].tolist())
                x, own = matrix(b.column("v").slice(a, z - a)), b.column("vec_id").to_numpy()[a:z]
                if cell != key:
                    yield from close()
                    key, ids, queries, best = cell, [], [], []
                if cells[a, 3] == 0:
                    ids += own.tolist()
                    queries.append(x)
                    best += [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
                elif ids:
                    queries = [np.concatenate(queries)]
                    scan(queries[0], np.array(ids), x, own, lists.value.rotation, best)
        yield from close()

    found = probes.unionByName(rows).repartition("list", "part", "block").sortWithinPartitions("list", "part", "block", "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
