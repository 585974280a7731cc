"""The stored index against a scan of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from loredeck.operators.ranking import bm25
from loredeck.sources import index as stored
from loredeck.sources.index import Pieces, StoredIndex, ranked


def texts(seed, n=150):
    rng = random.Random(seed)
    syllables = ["ab", "ba", "aa", "Çe", "x", "thé", " ", "\n", "of the"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(rng.randint(0, 8))), "".join(rng.choice(syllables) for _ in range(rng.randint(0, 90)))) for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", "a"), (n + 2, "ab", None), (None, "ab", "thé")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(texts(1), "id long, title string, body string")


@pytest.fixture
def index(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "BUCKET_ROWS", 40)
    monkeypatch.setattr(stored, "BLOCK_ROWS", 7)
    return StoredIndex.build(docs, "id", ["title", "body"], str(tmp_path / "index"))


@pytest.mark.parametrize("keywords", [["aba"], ["aaa", "çe"], ["of the", "x"], ["a"], ["thé thé"], ["abab", "aa"], ["nowhere"]])
def test_ranked_equals_the_scan(docs, index, keywords):
    want = {r.id: round(r.relevance, 9) for r in bm25(docs.filter("id is not null"), keywords, ["title", "body"]).collect()}
    got = {r.key: round(r.relevance, 9) for r in ranked(index, keywords).collect()}
    assert got == want


def test_hits_inside_a_column_and_counts(docs, index):
    got = {r.key: r.counts for r in index.hits(["the"], ("aa",), inside="body").filter("key is not null").collect()}
    want = {i: [b.lower().count("the"), b.lower().count("aa")] for i, _, b in texts(1) if i is not None and b and "the" in b.lower()}
    assert got == want and len(got) > 10


def test_pieces_equal_the_cuts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "BLOCK_ROWS", 7)
    rows = [(i, t) for i, _, t in texts(2) if i is not None]
    df = spark.createDataFrame(rows, "id long, body string")
    index = StoredIndex.build(df, "id", ["body"], str(tmp_path / "index"))
    cuts = []
    for i, t in rows:
        t = t or ""
        for k in range(max(1, -(-(len(t) - 10) // 30))):
            piece = t[30 * k : 30 * k + 40]
            if len(piece) >= 5:
                cuts.append((i, k, piece))
    frame = spark.createDataFrame(cuts, "id long, k int, piece string")
    for keywords in (["aba"], ["aa", "x"], ["of the"]):
        want = {(r.id, r.k): round(r.relevance, 9) for r in bm25(frame, keywords, ["piece"]).collect()}
        got = {(r.key, r.piece): round(r.relevance, 9) for r in ranked(index, keywords, pieces=Pieces("body", 40, 30, 5)).collect()}
        assert got == want and got


def test_changed_rows_replace_their_buckets_only(spark, docs, index):
    before = {r.bucket: r.n for r in index.rows().groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    now = docs.filter("id is null or id <> 3").withColumn("body", F.when(F.col("id") == 5, "a wholly new body").otherwise(F.col("body")))
    now = now.unionByName(spark.createDataFrame([(900, "new", "another new body")], "id long, title string, body string"))
    index.refresh(now, spark.createDataFrame([(3,), (5,), (900,)], "id long"))
    assert {r.key for r in index.hits(["new"]).filter("key is not null").collect()} == {5, 900}
    for keywords in (["aba"], ["new body"]):
        want = {r.id: round(r.relevance, 9) for r in bm25(now.filter("id is not null"), keywords, ["title", "body"]).collect()}
        assert {r.key: round(r.relevance, 9) for r in ranked(index, keywords).collect()} == want
    index.refresh(now.limit(0), now.select("id"))
    assert index.hits(["aba"]).filter("key is not null").count() == 0 and len(before) > 1


def test_a_search_reads_the_row_groups_of_its_trigrams(index):
    plan = index.hits(["aba"])._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualTo(gram,),EqualTo(gram,aba))]" in plan or "In(gram" in plan
