"""Streams over append-only event files, each run until what is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from loredeck.operators.places import placed
from loredeck.sources.shared import exists


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream, with the time stamp a watermark needs."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    return files.parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events[.]parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def finished(stream: DataFrame, checkpoint: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run the stream over all that is there now and return its result table, kept as files in the checkpoint folder.

    A micro-batch is a folder of its own, which a batch run again replaces. In complete mode the last one is the result;
    in update mode, in which only what changed is written, the last row of each of the keys.
    """
    at, last = f"{checkpoint}/stream-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/{number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    schema = StructType([*stream.schema.fields, StructField("__batch", LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{at}/rows/{last[0]}" if mode == "complete" else f"{at}/rows/*")
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("r")).select("r.*")
    return rows.select(*stream.columns)


FLUSH_ROWS, QUEUE_ROWS = 200, 5_000


def flushed(stream: DataFrame, order: list[str], root: str, state: str, most: int = FLUSH_ROWS, room: int = QUEUE_ROWS) -> DataFrame:
    """STM-07: rows written in batches of at most `most`, in order; of a micro-batch rows beyond `room` are dropped and counted.

    The rows go to `root`/rows, by micro-batch and batch. The ledger has a row for each micro-batch, written after its
    rows: one that is there already is not written again when a stream begins anew, and one whose rows are there without
    it is written over. Gives the ledger: number, batches, written, dropped.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        if exists(spark, f"{root}/ledger/number={number}/_SUCCESS"):
            return
        rows = placed(batch, order).withColumn("batch", F.floor((F.col("place") - 1) / most).cast("int"))
        rows.filter(F.col("place") <= room).write.mode("overwrite").parquet(f"{root}/rows/number={number}")
        written = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{root}/rows/number={number}")
        total = batch.agg(F.count("*").alias("total"))
        done = written.agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("written")).join(total)  # one row each
        done.select(F.lit(number).cast("long").alias("number"), "batches", "written", (F.col("total") - F.col("written")).alias("dropped")).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/number={number}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("number long, batches long, written long, dropped long").parquet(f"{root}/ledger/*")
