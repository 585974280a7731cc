"""Texts that come in one large batch are handled in parts of bounded size."""

import pyarrow as pa

from loredeck import registry
from loredeck.functions import batches
from loredeck.operators import dictionary
from loredeck.plans import textops


def test_parts_hold_all_rows_in_order():
    texts = ["a" * n for n in (3, 0, 4, 30, 1, 0, 9, 2)] + [None, "b"]
    got = [p.to_pylist() for p in batches.parts(pa.array(texts, pa.string()), 10)]
    assert sum(got, []) == texts and [sum(len(t or "") for t in p) for p in got] == [7, 30, 10, 3]
    assert list(batches.parts(pa.array([], pa.string()), 10)) == []


def test_a_batch_is_searched_in_parts(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "SLICE_CHARS", 64)
    docs = spark.range(300).selectExpr("id", "if(id % 7 = 0, null, concat('ab cd ', id)) text").coalesce(1)
    rules = spark.createDataFrame([(1, "cd"), (2, "ab"), (3, "ab cd")], "rule long, pattern string")
    got = {r.id: [tuple(s) for s in r.spans] for r in dictionary.occurrences(docs, "text", rules).collect()}
    assert got == {i: [] if i % 7 == 0 else [(0, 5, 3), (0, 2, 2), (3, 5, 1)] for i in range(300)}


def test_markup_in_parts_equals_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textops, "MARKUP_BYTES", 50)
    spark.range(200).selectExpr("id page_id", "'' url", "if(id % 9 = 0, null, concat('<h1>', id, '</h1><p>text</p>')) html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.markdown for r in registry.queries()["html_to_markdown"](spark, str(tmp_path)).collect()}
    assert got == {i: "" if i % 9 == 0 else f"# {i}\n\ntext" for i in range(200)}
