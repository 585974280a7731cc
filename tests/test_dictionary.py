"""Patterns of a table in texts, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from loredeck.operators import dictionary
from loredeck.operators.dictionary import first_rule, leftmost_longest, occurrences, replaced


def plain(text, rules, whole, any_case):
    text = (text or "").lower() if any_case else text or ""
    out = set()
    least = {}
    for r, p in rules:
        if p:
            p = p.lower() if any_case else p
            least[p] = min(r, least.get(p, r))
    for p, r in least.items():
        for i in range(len(text) - len(p) + 1):
            if text.startswith(p, i) and (not whole or not (i and text[i - 1].isalnum()) and not text[i + len(p) : i + len(p) + 1].isalnum()):
                out.add((i, i + len(p), r))
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("any_case", [True, False])
def test_occurrences_equal_a_plain_search(spark, monkeypatch, whole, any_case):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abAB é가 .") for _ in range(n))
    rules = [(i, make(rng.randint(1, 5)).strip()) for i in range(60)] + [(70, None), (71, "")]
    texts = [(i, make(rng.randint(0, 60))) for i in range(80)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame(rules, "rule long, pattern string")
    for chars, part in ((1 << 20, 1 << 20), (50, 40)):
        monkeypatch.setattr(dictionary, "SLICE_CHARS", chars)
        monkeypatch.setattr(dictionary, "PART_CHARS", part)
        got = {r.id: sorted(map(tuple, r.spans)) for r in occurrences(docs, "text", table, whole, any_case).collect()}
        assert got == {i: plain(t, rules, whole, any_case) for i, t in texts}


def test_leftmost_longest_replacement_and_remainder(spark):
    rules = spark.createDataFrame([(1, "new york"), (2, "york city"), (3, "new"), (4, "new york city hall"), (5, "hall")], "rule long, pattern string")
    docs = spark.createDataFrame([(1, "In New York City, a new hall"), (2, "new York city hall"), (3, "renew"), (4, None)], "id long, text string")
    put = F.create_map(F.lit(1).cast("long"), F.lit("NY"), F.lit(3).cast("long"), F.lit("fresh"))
    found = occurrences(docs, "text", rules).withColumn("spans", leftmost_longest(F.col("spans")))
    got = {r.id: (r.a, r.b, r.f) for r in found.select("id", replaced(F.col("text"), F.col("spans"), put).alias("a"), replaced(F.col("text"), F.col("spans")).alias("b"), first_rule(F.col("spans")).alias("f")).collect()}
    assert got == {1: ("In NY City, a fresh ", "In  City, a  ", 1), 2: ("", "", 4), 3: ("renew", "renew", None), 4: ("", "", None)}


def test_texts_whose_length_changes_in_lower_case(spark):
    docs = spark.createDataFrame([(1, "İİ Ab cd")], "id long, text string")
    rules = spark.createDataFrame([(1, "ab")], "rule long, pattern string")
    assert [tuple(s) for s in occurrences(docs, "text", rules).first().spans] == [(3, 5, 1)]
