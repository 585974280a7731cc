"""Trees and graphs of parents, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def descendants(edges: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """FTS-14: root, id and depth of all that lies below each root (column root), itself at depth 0.

    Edges are (id, parent). Each level is written to the folder and joined from there, so a level costs what it holds and no plan
    grows; what a root has reached already isn't reached again, so a cycle ends and the least depth counts.
    """
    spark, depth = edges.sparkSession, 0
    level = roots.select("root", F.col("root").alias("id"))
    schema = "root string, id string, depth int"
    while True:
        own = level.select(F.col("root").cast("string").alias("root"), F.col("id").cast("string").alias("id"), F.lit(depth).alias("depth")).distinct()
        own.write.mode("overwrite").parquet(f"{folder}/{depth}")
        held = spark.read.schema(schema).parquet(f"{folder}/{depth}")
        if held.isEmpty():
            return spark.read.schema(schema).parquet(*(f"{folder}/{d}" for d in range(depth + 1)))
        below = held.select("root", F.col("id").alias("parent")).join(edges.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent")), "parent").select("root", "id")
        reached = spark.read.schema(schema).parquet(*(f"{folder}/{d}" for d in range(depth + 1)))
        level, depth = below.join(reached, ["root", "id"], "left_anti"), depth + 1
