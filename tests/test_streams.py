"""Places of rows, tiers of cache, bounded flushes."""

import random

import pytest
from pyspark.sql import functions as F

from loredeck.operators import places
from loredeck.operators.places import placed
from loredeck.streaming.counters import flushed
from loredeck.streaming.tiers import tiered


@pytest.mark.parametrize("within", [None, "g"])
def test_places_equal_a_sort(spark, monkeypatch, within):
    monkeypatch.setattr(places, "RANGES", 5)
    monkeypatch.setattr(places, "SAMPLED", 4)
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), "same" if i % 3 else rng.choice([None, "a", "b"]), i) for i in range(200)]
    got = placed(spark.createDataFrame(rows, "g string, t string, id int"), ["t", "id"], within=within).collect()
    order = lambda r: (r[1] is not None, r[1] or "", r[2])
    groups = {None: rows} if within is None else {g: [r for r in rows if r[0] == g] for g in ("x", "y", None)}
    want = {(r, k + 1) for own in groups.values() for k, r in enumerate(sorted(own, key=order))}
    assert {((r.g, r.t, r.id), r.place) for r in got} == want and got[0].__fields__ == ["g", "t", "id", "place"]
    assert placed(spark.createDataFrame([], "g string, t string, id int"), ["t"], within=within).count() == 0


def plain_tiers(rows, memory, stored):
    out, state = {}, {}
    for at, i, key, write in sorted(rows):
        m, s = state.get(key, (None, None))
        status = "WRITE" if write else "MISS" if s is None else "HIT_MEM" if at - m < memory else "HIT_DB" if at - s < stored else "MISS_STALE"
        state[key] = (m if status == "HIT_MEM" else at, at if status in ("WRITE", "MISS", "MISS_STALE") else s)
        out[i] = status
    return out


def test_tiers_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([1, 5, 40, 300])
        rows.append((at, i, rng.randrange(4), rng.random() < 0.1))
    for k in range(3):
        part = [(i, at, key, w) for at, i, key, w in rows[100 * k : 100 * (k + 1)]]
        spark.createDataFrame(part, "event_id long, s long, user long, w boolean").select("event_id", F.timestamp_seconds("s").alias("ts"), "user", "w").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp, user long, w boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    stream = tiered(source, "user", F.col("w"), memory=30, stored=900)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_tiers(rows, 30, 900) and set(got.values()) == {"WRITE", "MISS", "HIT_MEM", "HIT_DB", "MISS_STALE"}


def test_flush_is_bounded_and_a_replay_writes_nothing_twice(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + (100 if k < 2 else 7)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "flush")
    ledger = sorted(tuple(r) for r in flushed(source(), ["id"], root, str(tmp_path / "s1"), most=8, room=50).collect())
    assert sorted(x[1:] for x in ledger) == [(1, 7, 0), (7, 50, 50), (7, 50, 50)]
    rows = spark.read.parquet(f"{root}/rows/*")
    before = {f for f in rows.inputFiles()}
    assert rows.count() == 107 and rows.groupBy("batch").count().filter("batch < 1").first()["count"] == 23
    again = sorted(tuple(r) for r in flushed(source(), ["id"], root, str(tmp_path / "s2"), most=8, room=50).collect())
    assert again == ledger and set(spark.read.parquet(f"{root}/rows/*").inputFiles()) == before
