"""Bounded samples, intermediate tables and the table of words."""

import os

import numpy as np
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import bounded_sample, delete, materialise


def test_sample_of_null_hot_and_repeated_keys(spark):
    nulls = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    assert bounded_sample(nulls, 100, "text").count() == 100
    hot = nulls.select(F.lit(7).cast("long").alias("doc_id"), "text")
    assert bounded_sample(hot, 5000, "text").count() == 5000
    repeated = hot.limit(10).crossJoin(spark.range(500)).drop("id")
    assert bounded_sample(repeated, 100).count() == 10
    assert bounded_sample(repeated.unionByName(nulls), 50).count() == 50
    assert bounded_sample(nulls.limit(0), 5).count() == 0


def test_sample_is_the_same_for_any_layout_and_bounded_in_bytes(spark):
    rows = spark.range(3000).select("id", F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    one = sorted(r.id for r in bounded_sample(rows.coalesce(1), 200, "text").collect())
    assert one == sorted(r.id for r in bounded_sample(rows.repartition(7), 200, "text").collect()) and len(one) == 200
    held = bounded_sample(rows, 2000, "text", max_bytes=1000).collect()
    assert 0 < sum(len(r.text) for r in held) <= 1000
    long = rows.select("id", F.repeat(F.lit("y"), 5000).alias("text"))
    assert bounded_sample(long, 2000, "text", max_bytes=1000).count() == 1


def test_deleted_tables_are_gone(spark):
    df = materialise(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    delete(df, spark.range(3))
    assert not os.path.exists(path)


def test_word_table_gives_back_what_was_put_in():
    rng = np.random.default_rng(8)
    table = words.WordTable("<u2", slots=64, ids=90)
    calls = []

    def ids_of(h):
        return (np.arange(int(h % 5)) + int(h % 1000)).astype("<u2")

    for _ in range(60):
        hashed = rng.integers(1, 70, rng.integers(0, 90)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def encode(new, hashed=hashed):
            found = [ids_of(h) for h in hashed[new]]
            calls.append(len(new))
            return np.array([len(x) for x in found], np.int64), np.concatenate(found)

        ids, size = words.encoded(table, hashed, encode)
        want = [ids_of(h) for h in hashed]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x.tolist()]
    assert 0 < sum(calls) < 2700
