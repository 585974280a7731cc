"""The place of every row in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to, and rows of the sample for each that bound them.
RANGES, SAMPLED = 64, 32


def placed(df: DataFrame, order: list[str], name: str = "place", within: str | None = None) -> DataFrame:
    """SRT-05: df with each row's number, from 1, in ascending order (nulls first), of all rows or within each value of a column.

    Rows are dealt to ranges by bounds from a sample of fixed size, counted by range, and numbered inside each range; a
    row's place is its number and the rows of the ranges before. Rows of equal order have places beside each other, so
    the order should end with a key.
    """
    keys = ([within] if within else []) + order
    key = F.struct(*(F.col(k) for k in keys))
    some = df.select(*keys).distinct().orderBy(F.xxhash64(*keys)).limit(RANGES * SAMPLED)
    every = lambda k: (k % SAMPLED) == SAMPLED // 2
    bounds = some.agg(F.filter(F.array_sort(F.collect_list(key)), lambda _, k: every(k)).alias("__bounds"))  # one row
    dealt = df.join(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", lambda b: b <= key))).drop("__bounds")
    groups = ["__range", *([within] if within else [])]
    counts = dealt.groupBy(*groups).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(*([within] if within else [])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    numbered = dealt.withColumn("__number", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    same = [numbered["__range"] == counts["__range"]] + ([numbered[within].eqNullSafe(counts[within])] if within else [])
    joined = numbered.join(counts if within else F.broadcast(counts), same)  # without a column, at most a row a range
    return joined.select(*(numbered[c] for c in df.columns), (F.col("__before") + F.col("__number")).alias(name))
