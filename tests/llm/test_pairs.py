"""N-gram join, nearest neighbours, decontamination: against brute force, odd rows."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loredeck.llm import op7_jaccard, op8_neighbours, op10_decontaminate


def brute_components(rows):
    sets = dict(enumerate(op7_jaccard.sets_of(pa.array([t for _, t in rows], pa.string()))))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, x in sets.items():
        for s in x.tolist() if rows[i][0] is not None else []:
            where[s].append(i)
    for i, x in sets.items():
        if rows[i][0] is None:
            continue
        for j, n in collections.Counter(j for s in x.tolist() for j in where[s] if j < i).items():
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), least[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, copies=14):
    """Groups of texts that grow apart word by word, a passage in many texts, exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(6, 160))]
        for k in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t + (passage if k % 3 == 0 else [])))
            if k % 2:
                base = t
    return [*texts, *texts[:10], *[" ".join(passage) + f" {i}" for i in range(30)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(seed))]
    got = op7_jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_join_where_every_shingle_meets_many(spark, monkeypatch):
    monkeypatch.setattr(op7_jaccard, "FEW", 2)
    monkeypatch.setattr(op7_jaccard, "CELL_SETS", 5)
    monkeypatch.setattr(op7_jaccard, "SPLIT", 4)
    monkeypatch.setattr(op7_jaccard, "LOCAL_COUNT", 1)
    monkeypatch.setattr(op7_jaccard, "FREQUENT", 3)
    rows = [(i, t) for i, t in enumerate(corpus(3, groups=4, copies=30))]
    got = op7_jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_join_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One two"), (2, "one TWO"), (7, "one two three"), (8, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (6, "z " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, component_id int")
    got = op7_jaccard.linked_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    kept = op7_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert op7_jaccard.linked_components(docs.limit(0)).count() == 0


def test_one_of_a_group_stays_and_rows_that_only_share_an_id(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "a"), (1, text, "b"), (1, "quite another text that stands under the same number", "c"), (2, text, "d"), (3, "", "e"), (3, "", "e"), (None, text, "f"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string")
    kept = sorted((str(r.doc_id), r.text[:5], r["__gone"]) for r in op7_jaccard.keep_one(docs).collect())
    assert [k[:2] for k in kept] == [("1", "one t"), ("1", "quite"), ("3", ""), ("3", ""), ("None", "one t"), ("None", "one t")]
    again = sorted((str(r.doc_id), r.text[:5], r["__gone"]) for r in op7_jaccard.keep_one(docs.repartition(3, "__gone")).collect())
    assert again == kept
    assert op7_jaccard.keep_one(docs.limit(0)).count() == 0


def test_prefix_tree_equals_comparing_each():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(5000, 300, replace=False)).astype(np.int64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 300), replace=False), rng.choice(5000, rng.integers(0, 60))])) for _ in range(60)] + [base, base]
    got = sorted(op7_jaccard.PrefixTree(sets).linked(base))
    assert got == [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(x, base)) >= 80 * len(np.union1d(x, base))] and len(got) > 5


def brute_nearest(rows, queries):
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        other = ids != q
        yield q, ids[other][np.lexsort((ids[other], d[other]))[:10]].tolist(), d


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 32))).astype(np.float32)
    x[500:1500] = x[500]  # a third of the rows are one vector
    rows = [(i, x[i].tolist()) for i in range(3000)]
    got = collections.defaultdict(list)
    for r in op8_neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    found = []
    for q, want, d in brute_nearest(rows, range(0, 3000, 100)):
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        found.append(len({v for _, v, _ in own} & set(want)) / 10)
        if 500 <= q < 1500:
            assert [v for _, v, _ in own] == want
    assert np.mean(found) >= 0.9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in op8_neighbours.search(docs, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 8), (0, 3, 100), (100, 1, 1), (100, 2, 8), (100, 3, 0)]
    assert op8_neighbours.search(docs.limit(0), F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n))
    items = [(i, text(rng.randint(16, 55))) for i in range(60)]
    docs, want = [], {}
    for d in range(240):
        t = text(rng.randint(5, 400)).split()
        if d % 4 == 0:
            item, at = d % 60, rng.randrange(len(t))
            w = [rng.choice(words) if rng.random() < (0, 0.1, 0.2)[d // 4 % 3] else x for x in items[item][1].upper().split()]
            t[at:at] = w
            want[d] = item
        docs.append((d, " ".join(t)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_leaks_are_found_and_clean_documents_left(leaks):
    docs, items, want = leaks
    got = {(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, items).collect()}
    assert {d for d, _ in got} <= set(want)
    assert len({d for d, i in got if want[d] == i}) >= 0.93 * len(want)
    assert {r.doc_id for r in op10_decontaminate.keep_clean(docs, items).collect()} == set(range(240)) - {d for d, _ in got}


def test_leaks_with_blocks_of_passages(leaks, monkeypatch):
    docs, items, want = leaks
    whole = {(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(op10_decontaminate, "BLOCK_PIECES", 25)
    monkeypatch.setattr(op10_decontaminate, "COMPARED_PIECES", 7)
    assert {(r.doc_id, r.item_id) for r in op10_decontaminate.leaks(docs, items).collect()} == whole


def test_leaks_of_odd_rows(spark):
    passage = "Quick brown foxes jump over many lazy dogs near that old river bank at dawn"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  ", 0), (4, passage, 0), (4, passage, 1), (None, "x " * 50 + passage, 0), (5, "words of no interest " * 5000, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, passage.lower())], "item_id long, text string")
    got = op10_decontaminate.leaks(docs, items).collect()
    assert {r.doc_id for r in got} == {4, None} and {r.item_id for r in got} == {1, None} and len(got) == 9
    assert op10_decontaminate.keep_clean(docs, items).columns == docs.columns
    assert op10_decontaminate.keep_clean(docs, items).count() == 4
    assert op10_decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert op10_decontaminate.leaks(docs.limit(0), items).count() == 0


def test_common_share_equals_a_plain_subsequence():
    rng = np.random.default_rng(8)
    idf = np.ones(op10_decontaminate.BUCKETS)
    for _ in range(30):
        a, b = (rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64) << np.uint64(50) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in np.ndindex(len(a), len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert np.isclose(op10_decontaminate.common_share([a], [b], idf)[0], best[-1, -1] / len(a))


def test_basis_equals_the_exact_decomposition(leaks):
    docs, items, _ = leaks
    idf = np.ones(op10_decontaminate.BUCKETS)
    basis = op10_decontaminate.latent_basis(items, idf, rank=5, extra=40)
    texts = [r.text for r in items.collect()]
    row, col, value = op10_decontaminate.sparse_rows(pa.array(texts), idf)
    a = np.zeros((len(texts), op10_decontaminate.BUCKETS))
    a[row, col] = value
    exact = np.linalg.svd(a, full_matrices=False)[1][:5]
    assert np.allclose(np.linalg.norm(a @ basis, axis=0), exact, rtol=0.02)


def test_words_that_stand_together_find_a_paraphrase_without_a_common_word(spark):
    """What the decomposition is for: with the identity in its place the cosine would be nought."""
    op, rng = op10_decontaminate, random.Random(17)
    topics = [[f"t{k}w{i}" for i in range(24)] for k in range(8)]
    texts = [" ".join(rng.sample(topics[k % 8], 12)) for k in range(160)]
    idf = np.ones(op.BUCKETS)
    used = np.unique(op.bucket(op.word_hashes(pa.array(texts))[0]))
    basis = op.latent_basis(spark.createDataFrame([(t,) for t in texts], "text string"), idf, rank=8, used=used)
    block = op.Passages.of([[k] for k in range(160)], texts, idf, basis, used)
    other = " ".join(w for w in topics[3] if w not in texts[3].split())
    found = {i: c for _, _, _, i, c in zip(*block.candidates(*op.word_hashes(pa.array([other]))))}
    assert found[3] > 0.8 and set(found) == {k for k in range(160) if k % 8 == 3}
    identity = op.Passages.of([[k] for k in range(160)], texts, idf, np.eye(len(used)), used)
    assert 3 not in {i for _, _, _, i, _ in zip(*identity.candidates(*op.word_hashes(pa.array([other]))))}


def test_every_copy_is_found_however_many_passages(spark):
    rng = random.Random(19)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(6000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(15, 60))) for i in range(600)]
    docs = [(i, f"{text(100)} {passage} {text(rng.randint(90, 110))}") for i, passage in items]
    schema = "{} long, text string".format
    got = {(r.doc_id, r.item_id): r.cosine for r in op10_decontaminate.leaks(spark.createDataFrame(docs, schema("doc_id")), spark.createDataFrame(items, schema("item_id"))).collect()}
    assert set(got) >= {(i, i) for i in range(600)}
    for block in op10_decontaminate.blocks(spark.createDataFrame(items, schema("item_id")), spark.createDataFrame(items, schema("doc_id"))):
        assert block.latent.shape[1] == op10_decontaminate.RANK
        texts = [dict(items)[i] for (i,) in block.ids]
        text, begin, _, item, cosine = block.candidates(*op10_decontaminate.word_hashes(pa.array(texts)))
        own = {t: c for t, a, i, c in zip(text, begin, item, cosine) if t == i and a == 0 and len(texts[t].split()) <= 32}
        assert np.allclose(list(own.values()), 1, atol=1e-4)  # each passage finds itself whole


def test_long_passages_and_other_scripts_are_found(spark):
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(20_000)]
    letters = "абвгдежзиклмн"
    text = lambda n: " ".join(rng.sample(words, n))
    items = [(i, text(n)) for i, n in enumerate([40, 65, 400, 700, 1000, 2000])]
    items += [(10, " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(20))), (11, "天地玄黄 宇宙洪荒 日月盈昃 辰宿列张 寒来暑往 秋收冬藏 闰余成岁 律吕调阳")]
    docs = [(i, f"{text(300)} {passage} {text(107)}") for i, passage in items] + [(99, text(3000)), (98, "-- ?! ...")]
    items += [(20, "?! -- ..."), (21, " \n")]
    schema = "{} long, text string".format
    got = op10_decontaminate.leaks(spark.createDataFrame(docs, schema("doc_id")), spark.createDataFrame(items, schema("item_id"))).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items[:8]}
    assert len(got) == 8 and all(r.score > 0.999 for r in got)


def test_candidates_equal_all_windows_by_all_passages():
    """Latent cosines of windows computed one by one."""
    op, rng = op10_decontaminate, random.Random(11)
    words = [f"q{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(40)]
    docs = []
    for k in range(30):
        t = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(t))
        docs.append(" ".join(t[:at] + (texts[k].split() if k % 2 else []) + t[at:]))
    idf = np.random.default_rng(1).uniform(0.5, 5, op.BUCKETS)
    row, col, value = op.sparse_rows(pa.array(texts), idf)
    a = np.zeros((len(texts), op.BUCKETS))
    a[row, col] = value
    basis = np.linalg.svd(a, full_matrices=False)[2][:16].T
    block = op.Passages.of([[k] for k in range(len(texts))], texts, idf, basis)
    whole = a @ basis
    size = np.linalg.norm(whole, axis=1) * op.vector_lengths(pa.array(texts), idf)
    whole /= np.linalg.norm(whole, axis=1)[:, None]
    hashed, first = op.word_hashes(pa.array(docs))
    got = {(t, begin, i) for t, begin, _, i, _ in zip(*(x.tolist() for x in block.candidates(hashed, first)))}
    sure, near = set(), set()
    for t in range(len(docs)):
        own = op.bucket(hashed[first[t] : first[t + 1]])
        for begin in range(0, len(own), op.HALF):
            w = np.bincount(own[begin : begin + 2 * op.HALF], minlength=op.BUCKETS) * idf
            v = w @ basis
            for i, c in enumerate((whole @ v / np.linalg.norm(v)).tolist() if v.any() else []):
                least = max(op.LEAST_COSINE, op.LEAST_REACH * size[i] / np.linalg.norm(v))
                (sure if c >= least + 1e-4 else near if c >= least - 1e-4 else set()).add((t, begin, i))
    assert len(sure) > 60 and sure <= got <= sure | near
