"""Reads through two tiers of cache, as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a loaded key stays in memory, that a stored one is good for, after which an unused key is forgotten.
MEMORY_SECONDS, STORED_SECONDS, FORGOTTEN_SECONDS = 20_000, 86_400, 90 * 86_400
READS = "event_id long, status string"


def _reads(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, memory: int, stored: int) -> Iterator[pd.DataFrame]:
    """The status of a key's reads in order of time; a read that finds it in the store puts it in memory, one that doesn't into both."""
    if state.hasTimedOut:
        state.remove()
        return
    in_memory, in_store = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values(["seconds", "event_id"])
    out = []
    for at, write in zip(rows["seconds"].tolist(), rows["write"].tolist()):
        if write:
            status = "WRITE"
        elif in_store is None:
            status = "MISS"
        elif at - in_memory < memory:
            status = "HIT_MEM"
        else:
            status = "HIT_DB" if at - in_store < stored else "MISS_STALE"
        if status != "HIT_MEM":
            in_memory = at
        if status in ("WRITE", "MISS", "MISS_STALE"):
            in_store = at
        out.append(status)
    state.update((in_memory, in_store))
    last = int(rows["seconds"].iloc[-1]) * 1000
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + FORGOTTEN_SECONDS * 1000)
    yield pd.DataFrame({"event_id": rows["event_id"], "status": out})


def tiered(events: DataFrame, key: str, is_write, memory: int = MEMORY_SECONDS, stored: int = STORED_SECONDS) -> DataFrame:
    """SRC-34, STM-08, REM-18: event_id and status of each read of a key: HIT_MEM, HIT_DB, MISS_STALE, MISS, or WRITE.

    The state is two times for each key, with a time-out by event time; reads that come in a later batch than younger ones are judged
    as they come. Memory here is bounded by time, not by size: a bound on the size over all keys would need one task.
    """
    own = events.withWatermark("ts", "1 day").select(F.col(key).alias("key"), "event_id", "ts", F.unix_timestamp("ts").alias("seconds"), is_write.alias("write"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _reads(k, frames, state, memory, stored)

    return own.groupBy("key").applyInPandasWithState(run, READS, "memory long, store long", "append", GroupStateTimeout.EventTimeTimeout)
