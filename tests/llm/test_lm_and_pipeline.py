"""Attention scoring against plain counts and a step-by-step model; the pipeline against its stages' rules."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from loredeck.llm import op4_attention_lm as lm

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def plain_base(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [[w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if w] + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    c = collections.Counter(w for x, h in zip(words, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(str(d), h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for (d, _), h, x in zip(rows, held, words)]


def close(got, want):
    key = lambda r: str(r[:5]) + f"{r[5]:.6f}"
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def row(r):
    return (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)


def test_base_equals_plain_counts_and_the_model_learns(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 40_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = lm.scores(docs, PATH).collect()
    close([row(r) for r in got], plain_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    mean = sum(r.score for r in got) / sum(r.n_tokens for r in got)
    assert -9 < mean < -3 and all(r.score < 0 for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "The the THE"), (4, "the the the"), (None, "no id"), (5, "É é x\x0by"), (6, "long " * 70_000), (7, "z" * 5000)]
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, score int, word string")
    close([row(r) for r in lm.scores(docs, PATH).collect()], plain_base(rows))
    assert lm.scores(docs.limit(0), PATH).count() == 0
    alone = spark.createDataFrame([(d, "only held out") for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in lm.scores(alone, PATH).collect()} == {(0, 0, 0.0)}


def test_many_rows_without_words_in_one_partition(spark):
    rows = [(d, None) for d in range(70_000)] + [(70_000, "one two two"), (70_001, "two three"), (70_002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    close([row(r) for r in lm.scores(docs, PATH).collect()], plain_base(rows))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    m = lm.Attention.fresh(np.bincount(rng.integers(0, 3000, 5000), minlength=4000), rng.integers(0, 9, (lm.CLASSES, lm.CLASSES)))
    for k, w in m.weights.items():
        m.weights[k] = (w + 0.1 * rng.normal(size=w.shape)).astype(np.float64)
    return m


def test_every_id_is_scored_once_by_what_stands_before_it(model):
    """One id at a time, with the context its window gives it."""
    rng = np.random.default_rng(2)
    lengths = [1, 5, 24, 25, 130]
    texts = [np.append(rng.integers(1, 4000, n - 1), lm._END) for n in lengths]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    got = model.score(np.concatenate(texts), offsets, batch=3)
    w, step, context = model.weights, lm.WINDOW - lm.CONTEXT, lm.CONTEXT
    for ids, total in zip(texts, got):
        c, want = model.classes[ids], 0.0
        before = np.append(model.classes[lm._END], c[:-1])
        for i in range(len(ids)):
            t = i % step + context
            begin = max(0, i - t)
            x = w["embed"][before[begin : i + 1]]
            place = np.arange(t - (i - begin), t + 1)
            a = x @ w["k"] @ (x[-1] @ w["q"]) * lm.WIDTH**-0.5 + w["place"][t, place]
            if i < step:
                a = a[-(t - context + 1) :]
                x = x[-len(a) :]
            a = np.exp(a) / np.exp(a).sum()
            y = x[-1] + a @ (x @ w["v"]) @ w["o"]
            z = y + np.maximum(y @ w["up"], 0) @ w["down"]
            g, m = divmod(c[i], lm.MEMBERS)
            told = model.group_told[before[i]], model.member_told[g][before[i]]
            for logits, k in ((z @ w["group"] + w["group_bias"] + told[0], g), (z @ w["member"][g] + w["member_bias"][g] + told[1], m)):
                want += logits[k] - np.log(np.exp(logits).sum())
            want += model.rest[ids[i]] if c[i] == lm.CLASSES - 1 else 0
        assert np.isclose(total * np.log(10), want)


def test_probabilities_of_all_ids_add_up_to_one(model):
    z = np.random.default_rng(3).normal(size=(1, lm.WIDTH))
    log, _ = model.heads(np.repeat(z, lm.CLASSES, 0), np.arange(lm.CLASSES), np.full(lm.CLASSES, 7))
    p = np.exp(log)[model.classes] * np.where(model.classes == lm.CLASSES - 1, np.exp(model.rest), 1)
    assert np.isclose(p.sum(), 1, atol=1e-5)


def test_gradients_equal_differences(model):
    rng = np.random.default_rng(4)
    ids = np.append(rng.integers(0, 1000, 60), lm._END)
    before, after, first, _ = lm.windows(model.classes[ids], np.array([0, 61]))
    _, g = model.gradients(before, after, first)
    for name, w in model.weights.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old = w[at]
        losses = []
        for e in (1e-5, -1e-5):
            w[at] = old + e
            losses.append(model.gradients(before, after, first)[0])
        w[at] = old
        assert np.isclose(g[name][at], (losses[0] - losses[1]) / 2e-5, rtol=1e-3, atol=1e-6), name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {"": {r.doc_id for r in docs.select("doc_id").collect()}}
    at, last = docs, ""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialise(stage(spark, at, SMALL), name)
        assert at.columns == docs.columns
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        assert kept[name] <= kept[last] and len(kept[name]) == at.count() > 0.5 * len(kept[last])
        last = name
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == kept[last]


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "the cat sat on the mat and looked at the sun", "en"), (4, "the cat sat on the mat and looked at the sun", "en"), (None, "the dog of the house and the garden of the town", "en"), (3, "the cat sat on the mat and looked at the sun", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n_tokens int")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
        assert at.columns == docs.columns
    assert sorted(str(r.doc_id) for r in at.collect()) == ["3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
