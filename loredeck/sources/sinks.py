"""Writers: replaceable partitions, exports, derived tables kept in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loredeck.functions.text import guarded_csv, log_field


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """SNK-11/12: the partitions present in df replace those at the path; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-18: CSV in which no text field is taken for a formula."""
    df.select(*(guarded_csv(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("header", "true").csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """SNK-19/22: one JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """SNK-23: a line a row, fields joined by bars that no field can hold."""
    df.select(F.concat_ws(" | ", *(F.coalesce(log_field(F.col(c).cast("string")), F.lit("")) for c in df.columns)).alias("value")).write.mode("append").text(path)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK-15/16: a table, or a child of it, without the keys deleted."""
    return table.join(gone.select(key).distinct(), key, "left_anti")
