"""Keeping tables current: upserts, deltas, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loredeck.operators.ranking import best_per


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last version of each key."""
    return best_per(df, keys, *order)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Target with changes laid over it: new keys are added, a changed column that is not null replaces the old one."""
    columns = [c for c in target.columns if c not in keys]
    t, s = target.alias("t"), changes.alias("s")
    joined = t.join(s, keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) for c in columns))


def delta(source: DataFrame, modified: str, watermark: DataFrame) -> DataFrame:
    """Rows changed after the watermark, a frame of one row and column; all rows if it is null."""
    (name,) = watermark.columns
    return source.join(F.broadcast(watermark)).filter(F.col(name).isNull() | (F.col(modified) > F.col(name))).drop(name)


def cache_status(age: Column, memory_seconds: int, ttl_seconds: Column) -> Column:
    """Where a cached row is served from, by its age in seconds; no ttl is the default of a day, 0 is always stale."""
    ttl = F.coalesce(ttl_seconds, F.lit(86_400))
    return F.when(age.isNull(), "MISS").when(age < memory_seconds, "HIT_MEM").when(age >= ttl, "MISS_STALE").otherwise("HIT_DB")
