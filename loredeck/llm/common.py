"""Helpers the operators share: reading tables, writing intermediate tables, walking Arrow text in small slices."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; the numpy arrays of a slice are some ten times as large.
SLICE_BYTES = 512 << 10

#: Text of a bounded sample at most.
SAMPLE_BYTES = 48 << 20

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="spark-loredeck-")
    return _OWN_DIR[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loredeck/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def delete(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more; of other tables, nothing."""
    for df in tables:
        if path := vars(df).get("_written_to"):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo the number of folds; null ids get fold -1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def bounded_sample(df: DataFrame, bound: int, text: str | None = None, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The `bound` distinct rows of df of the least hashes, or all if there are fewer: the same for any layout.

    The hash is of the whole row, so neither a key that many rows share nor null keys matter, and repeated rows are
    one. With a text column, so many rows as together have max_bytes of it, but at least one. The hashes of rows
    that may be chosen are ordered by Spark; at most `bound` of them come to the driver.
    """
    of = F.xxhash64(F.lit(17), *df.columns)
    size = F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0)

    def least(rows: DataFrame) -> list:
        return rows.select(of.alias("h"), size.alias("size")).groupBy("h").agg(F.max("size").alias("size")).orderBy("h").limit(bound).collect()

    total = df.count()
    share = min(1.0, 4 * bound / max(1, total))
    found = least(df.filter(of < int((share - 0.5) * (1 << 63) * 2))) if share < 1 else []
    if len(found) < bound:  # few rows, or few distinct ones
        found = least(df)
    kept, held = 0, 0
    for r in found:
        held += r["size"]
        if kept and held > max_bytes:
            break
        kept += 1
    return df.filter(of <= found[kept - 1].h).dropDuplicates() if found else df


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text in each slice stays within max_bytes (or is one row).

    At the end memory that Arrow holds in reserve is given back, as workers live on for other tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the rows' offsets into them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def packed_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls one after another, and the rows' offsets into them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batched(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield part


def binary(arrays: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
