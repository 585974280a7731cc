"""Quality, language and toxicity: held-out accuracy, leakage, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from loredeck.llm import op3_quality, op6_language, op9_toxicity

SMALL = "/root/testdata/sf0.01"
ODD = [None, "", " \n ", "123 !!", "a", "word " * 5000, "Ünï çødé 中文"]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in labels.collect()}, {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(10_000 + i, t, None, "x", 1.0) for i, t in enumerate(ODD)] + [(10_004, "a", "en", "again", None), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


def held(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_quality_held_out(tables):
    docs, labels, truth, _ = tables
    vectors = op3_quality.measured(docs)
    rows = op3_quality.score(vectors, op3_quality.fit(vectors, labels)).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = [(r.predicted, truth[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in kept]) > 0.9


def test_quality_of_odd_rows_and_labels(spark, tables, odd):
    _, labels, _, _ = tables
    vectors = op3_quality.measured(odd)
    rows = op3_quality.score(vectors, op3_quality.fit(vectors, labels)).collect()
    assert len(rows) == len(ODD) + 2 and {r.score for r in rows} == {0.5}  # no label, so the prior
    assert not [r for r in rows if r.doc_id is None][0].held_out
    own = spark.createDataFrame([(10_000 + i, 1, 0) for i in range(7)] + [(None, 1, 1), (10_001, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in op3_quality.score(vectors, op3_quality.fit(vectors, own)).collect()} == {1.0}
    assert op3_quality.measured(odd.limit(0)).count() == 0


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(1)
    x, y = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))]), np.repeat([0, 1], [200, 300])
    m = op3_quality.discriminant(np.array([200.0, 300.0]), np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)]))
    covariances = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = np.diag((200 * covariances[0].diagonal() + 300 * covariances[1].diagonal()) / 500 + op3_quality.FLOOR)
    logs = []
    for c in (0, 1):
        s = (1 - op3_quality.SHRINKAGE) * covariances[c] + op3_quality.SHRINKAGE * pooled
        d = x - x[y == c].mean(0)
        logs.append(np.log((200, 300)[c] / 500) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_language_held_out_and_calibrated(tables):
    docs, _, _, lang = tables
    rows = op6_language.identify(docs, op6_language.learned(docs)).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out]
    accuracy = np.mean([r.lang_pred == lang[r.doc_id] for r in kept])
    assert accuracy > 0.97 and abs(np.mean([r.score for r in kept]) - accuracy) < 0.05


def test_language_learns_nothing_from_held_out_rows(spark):
    rows = [(i, "aaa bbb" if held(i, 4, 2) else "xyz uvw", "aa" if held(i, 4, 2) else "xx") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert op6_language.learned(docs).languages == ["xx"]


def test_language_of_odd_rows(tables, odd):
    docs, _, _, _ = tables
    model = op6_language.learned(docs)
    rows = op6_language.identify(odd, model).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    assert all((by[10_000 + i].lang_pred, by[10_000 + i].score) == ("und", 0.0) for i in range(4))
    assert all(by[10_000 + i].lang_pred != "und" for i in (4, 5, 6))
    assert op6_language.keep_identified(odd, model).columns == odd.columns
    empty = op6_language.learned(odd.filter("false"))
    assert {r.lang_pred for r in op6_language.identify(odd, empty).collect()} == {"und"}
    assert op6_language.identify(odd.limit(0), model).count() == 0


def test_grams_of_a_text_dont_depend_on_its_neighbours():
    alone, together = op6_language.grams(["Straße 5"]), op6_language.grams(["x", "", "Straße 5", "y"])
    a, z = together[1][2], together[1][3]
    assert (together[0][:, a:z] == alone[0]).all() and together[2].tolist() == [True, False, True, True]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = op9_toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), op9_toxicity.learned(docs, labels)).collect()
    kept = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert np.mean([a == b for a, b in kept]) > 0.97 and np.mean([a for a, b in kept if not b]) < 0.02


def test_machine_learns_pairs_that_weights_cannot():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        rows.append((int(a == b), np.unique([1 + a, 3 + b, 10 + rng.integers(5)])))
    m = op9_toxicity.Machine(*([np.arange(op9_toxicity.BUCKETS)] + [0.0, np.zeros(op9_toxicity.BUCKETS), None]))
    chosen = op9_toxicity.select_features
    try:
        op9_toxicity.select_features = lambda rows: np.arange(20)
        m = op9_toxicity.train(rows)
    finally:
        op9_toxicity.select_features = chosen
    owner = np.repeat(np.arange(len(rows)), [len(i) for _, i in rows])
    p = m.raw(owner, m.feature[np.concatenate([i for _, i in rows])], len(rows)) > 0
    assert np.mean(p == [y for y, _ in rows]) > 0.95


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(3)
    m = op9_toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    i = np.array([0, 3, 7])
    want = 0.3 + m.weight[i].sum() + sum(m.factor[a] @ m.factor[b] for a, b in [(0, 3), (0, 7), (3, 7)])
    assert np.isclose(m.raw(np.zeros(3, int), i, 1)[0], want)


def test_toxicity_of_odd_rows(spark, odd):
    none = op9_toxicity.learned(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = op9_toxicity.score(odd, none).collect()
    assert len(rows) == len(ODD) + 2 and {r.predicted for r in rows} == {0}
    assert op9_toxicity.keep_civil(odd, none).columns == odd.columns
    assert op9_toxicity.score(odd.limit(0), none).count() == 0
    assert len(op9_toxicity.terms(pa.array([None, "", "a-b"], pa.string()))[0]) == 2


def test_follow_the_leader_equals_a_plain_loop():
    op, rng = op6_language, np.random.default_rng(12)
    state, z, n = op.FollowTheLeader(3), {}, {}

    def weight(i, c):
        at = z.get((i, c), 0.0)
        return 0.0 if abs(at) <= op.L1 else -(at - np.sign(at) * op.L1) / ((op.BETA + n.get((i, c), 0.0) ** 0.5) / op.ALPHA + op.L2)

    for _ in range(60):
        features, x, y = rng.choice(40, 6, replace=False), rng.uniform(-1, 2, 6), int(rng.integers(0, 3))
        state.learn(features, x, y)
        w = {(i, c): weight(i, c) for i in features.tolist() for c in range(3)}
        raw = [sum(w[i, c] * v for i, v in zip(features.tolist(), x)) for c in range(3)]
        p = [np.exp(r - max(raw)) for r in raw]
        for c in range(3):
            for i, v in zip(features.tolist(), x):
                g = v * (p[c] / sum(p) - (c == y))
                was = n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / op.ALPHA * w[i, c]
                n[i, c] = was + g * g
    assert any(abs(v) > op.L1 for v in z.values())
    for (i, c), v in z.items():
        assert np.isclose(state.z[i, c], v) and np.isclose(state.n[i, c], n[i, c])
        assert np.isclose(state.weights(slice(None))[i, c], weight(i, c))
