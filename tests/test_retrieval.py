"""Documents that hold most words of a passage, against counting all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loredeck.operators import retrieval


def words(c):
    return F.array_distinct(F.split(F.col(c), " "))


def plain(docs, passages, k, share):
    out = {}
    for item, text in passages:
        if item is None or text is None:
            continue
        asked = set(text.split(" "))
        hits = sorted((-len(asked & set(t.split(" "))), d) for d, t in docs if d is not None and t is not None)
        hits = [(-h, d) for h, d in hits if h]
        if hits:
            out[item] = (len(asked), sum(h >= share * len(asked) for h, _ in hits), hits[:k])
    return out


@pytest.mark.parametrize("block, dense, cells", [(1 << 20, 1024, 1 << 20), (40, 2, 64)])
def test_best_documents_equal_all_pairs(spark, monkeypatch, block, dense, cells):
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", block)
    monkeypatch.setattr(retrieval, "DENSE", dense)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)] + [(None, "w1 w2"), (900, None), (901, "")]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(1000, docs[7][1])]  # ties, one id twice
    passages = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(50, docs[7][1]), (51, "nothing"), (52, None), (None, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    p = spark.createDataFrame(passages, "item_id long, text string")
    rows = retrieval.best_documents(d, words("text"), p, words("text"), 4, 0.7).collect()
    got = {r.item_id: (r["size"], r.enough, [(h.hits, h.doc_id) for h in r.top]) for r in rows}
    assert got == plain(docs, passages, 4, 0.7)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, passages in ((d, full), (full, d), (d, d)):
        assert retrieval.best_documents(docs, words("text"), passages.withColumnRenamed("doc_id", "item_id"), words("text"), 3).collect() == []
