"""Hard negatives, repeated passages, conversation repair: against brute force, odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loredeck.llm import op11_negatives, op12_suffixes, op13_conversations

SMALL = "/root/testdata/sf0.001"


# ---- repeated passages


def brute_repeats(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept hash of rows (doc_id, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int.from_bytes(hashlib.md5((r[1] or "").encode()).digest()[:4])))
    seen, out = set(), []
    for d, t in order:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((str(d), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts.append(s[a : a + rng.randint(50, 300)] if rng.random() < 0.5 else s)
            if rng.random() < 0.3:
                parts.append(s)
        rng.shuffle(parts)
        rows.append((i * 2 + 1, rng.choice([" ", "", "|"]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(8)]
    rows += [(2000, "x" * 700), (2001, "ab" * 300), (2002, "x" * 250 + "y"), (2003, None), (2004, ""), (2005, "é" * 49 + "e"), (2006, "é" * 49 + "e")]
    return rows


def digests(spark, rows, monkeypatch=None, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, hash int, copy int").repartition(parts)
    monkeypatch = monkeypatch or pytest.MonkeyPatch()
    with monkeypatch.context() as m:
        m.setattr(op12_suffixes, "table", lambda *_: docs)
        return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffixes.op12_suffix_dedup(spark, "").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = passages(seed)
    got = digests(spark, rows)
    assert got == brute_repeats(rows) and sum(g[2] > 0 for g in got) > 20


def test_repeats_through_queues_on_disk_pieces_and_without_filter(spark, monkeypatch):
    rows = passages(3, 40) + [(3000 + i, f"{i} " + "the same line of words stands in every one of these documents, and then " * 2 + str(i)) for i in range(150)]
    want = brute_repeats(rows)
    monkeypatch.setattr(op12_suffixes, "HELD", 40)
    assert digests(spark, rows) == want
    monkeypatch.setattr(op12_suffixes, "PIECE", 130)
    assert digests(spark, rows) == want
    monkeypatch.setattr(op12_suffixes, "BLOOM_MOST", 1)
    assert digests(spark, rows) == want


def test_disk_order_equals_memory_order(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    n = 300
    base = rng.integers(0, 2, (6, op12_suffixes.BEFORE + op12_suffixes.AFTER)).astype(np.uint8)
    around = base[rng.integers(0, 6, n)]
    flip = rng.random(n) < 0.5
    around[flip, rng.integers(0, around.shape[1], n)[flip]] ^= 1
    least, most = rng.integers(0, 30, n), rng.integers(30, op12_suffixes.PLACES, n)
    age = rng.permutation(n)
    want = op12_suffixes.sorted_in_memory(np.zeros(n, int), around, least, most, age)
    brute = np.zeros_like(want)
    for d in range(op12_suffixes.PLACES):
        first = {}
        for i in np.argsort(age):
            if least[i] <= d <= most[i]:
                w = around[i, op12_suffixes.BEFORE - d : op12_suffixes.BEFORE - d + 100].tobytes()
                brute[i, d] = w in first
                first[w] = True
    assert (want == brute).all() and brute.any() and not brute.all()
    monkeypatch.setattr(op12_suffixes, "HELD", 37)
    own = op12_suffixes.OnDisk(str(tmp_path))
    own.add(around, least, most)
    own.opened(age)
    assert (np.array(own.sort()) == brute).all()


def test_repeats_of_odd_rows(spark):
    text = "a text of its own that is repeated in rows, long enough to be a window of one hundred bytes and some more of them"
    rows = [(1, text), (1, text), (1, text), (None, text), (None, None), (2, text[:99]), (2, text[:99]), (3, text + text)]
    got = digests(spark, rows)
    n = len(text)
    assert got == brute_repeats(rows) and [g[2] for g in got] == [n, n, n, 0, 0, 2 * n, 0, 0]
    assert digests(spark, rows, parts=1) == got
    spans = op12_suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(str(r.doc_id), len(r.text), len(r.kept), len(r.spans)) for r in spans.collect()} >= {("3", 2 * n, 0, 1), ("None", n, n, 0)}
    assert op12_suffixes.without_repeats(spans.limit(0)).count() == 0


def test_rows_that_share_an_id_in_any_layout(spark):
    texts = [f"text {i} " + "with a passage that all of the rows share, which is longer than a hundred bytes so that it counts as repeated" for i in range(9)]
    rows = [(7, t) for t in texts]
    got = digests(spark, rows, parts=1)
    assert got == digests(spark, rows[::-1], parts=5) and sum(g[2] > 0 for g in got) == 8


def test_repeats_of_a_whole_table_against_the_plain_rule(spark):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op12_suffixes.op12_suffix_dedup(spark, SMALL).collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got == brute_repeats(docs)


# ---- hard negatives


def brute_negatives(rows, anchors):
    """rows: id -> (label, vector of whole numbers)."""
    out = []
    for a in anchors:
        label, v = rows[a]
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in rows.items() if b != a}
        best = lambda ids: sorted(ids, key=lambda b: (-score[b], b))
        for p in best(b for b in score if rows[b][0] == label)[:5]:
            fits = [b for b in score if rows[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(best(fits)[:3])]
    return sorted(out)


def vectors(seed, n=400, dims=7):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims))
    kind = rng.integers(0, 6, n)
    x = (centre[kind] + 0.4 * rng.normal(size=(n, dims))).round(1)
    return [(i, (kind[i] + rng.integers(0, 2)).item() % 4, [int(y) for y in np.floor(256 * x[i])]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op11_negatives, "AIM", 8)
    monkeypatch.setattr(op11_negatives, "FIT_ROWS", 64)
    monkeypatch.setattr(op11_negatives, "PART_ROWS", 10)
    monkeypatch.setattr(op11_negatives, "BLOCK_ANCHORS", 4)
    rows = vectors(seed)
    own = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = op11_negatives.mined(own, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives({i: (k, v) for i, k, v in rows}, range(0, 400, 10))


def test_negatives_of_hot_odd_and_few_rows(spark):
    x = [0.5, 0.25, -0.5]
    rows = [(i, 1 if i % 3 else 2, x) for i in range(0, 300)]
    rows += [(1000, None, x), (1001, 1, None), (None, 1, x), (1002, 1, [0.1, None, 0.2]), (1003, 1, [float("nan"), 0.0, 0.0]), (1004, 1, [float("inf"), 0.0, 0.0])]
    rows += [(1005, 1, [0.5, 0.5]), (1006, 1, [0.0, 0.0, 0.0]), (1050, 2, [0.3, 0.2, -0.4]), (1050, 2, [0.3, 0.2, -0.4]), (1050, 3, x)]
    rows += [(1051, 2, [0.4, 0.2, -0.4]), (1052, 1, [0.4, 0.2, -0.4]), (1052, 1, [0.41, 0.2, -0.4])]
    table = spark.createDataFrame([(*r, 0, "") for r in rows], "vec_id long, label int, embedding array<float>, cell int, low string")
    got = sorted(tuple(r) for r in op11_negatives.mined(op11_negatives.usable(table), F.col("vec_id") % 50 == 0).collect())
    whole = {}
    for i, k, v in rows:
        if None not in (i, k, v) and len(v) == 3 and None not in v and np.isfinite(v).all():
            whole[i] = min(whole.get(i, (9, [])), (k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()))
    assert got == brute_negatives(whole, [i for i in whole if i % 50 == 0]) and len(got) > 10
    assert op11_negatives.mined(op11_negatives.usable(table.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    alone = op11_negatives.usable(table.filter("vec_id = 50"))
    assert op11_negatives.mined(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_whole_numbers_beyond_exact_doubles():
    big = np.array([[3037000499, 1], [94906267, 94906269]], np.int64)
    assert op11_negatives.products(big, big).tolist() == [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for b in big.tolist()] for a in big.tolist()]


def test_heap_gives_cells_by_falling_bound_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 6))
    own = op11_negatives.Index(3, [], [], np.arange(500), np.zeros(500), x, np.zeros((8, 8), int))
    own.codes = [op11_negatives.centres(h, 8, rng) for h in own.halves(x)]
    (i, j), far = own.nearest(x)
    np.add.at(own.parts, (i, j), 1)
    own.radii = [np.array([d[k == c].max(initial=0) for c in range(8)]) for k, d in zip((i, j), far)]
    cells = list(own.visit(x[0], -1e18))
    assert sorted(c for c, _, _ in cells) == np.flatnonzero(own.parts).tolist() and [u for _, u, _ in cells] == sorted((u for _, u, _ in cells), reverse=True)
    bound = {c: (low, up) for c, up, low in cells}
    for k in range(500):
        low, up = bound[i[k] * 8 + j[k]]
        assert low <= x[k] @ x[0] <= up
    assert [c for c, _, _ in own.visit(x[0], 1000.0)] == [c for c, u, _ in cells if u >= 1000.0]


def test_negatives_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    got = op11_negatives.op11_hard_negatives(spark, SMALL)
    want = db.execute(op11_negatives.SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


# ---- conversations


def brute_repair(rows):
    """Least (cost, audit) over all edit strings with at most two insertions in a row."""
    best = None
    pattern = re.compile(r"(s?(ua)+)?\Z")

    def options(row):
        initial, doomed, cut = row
        yield "D", 4, ""
        if not doomed:
            yield "K", 3 * cut, initial
            yield "R", 3 + 3 * cut, "u"
            yield "R", 3 + 3 * cut, "a"

    inserts = [("", 0, "")] + [("I", 3, r) for r in "ua"] + [("II", 6, a + b) for a in "ua" for b in "ua"]
    for chosen in itertools.product(*[[(i, o) for i in inserts for o in options(r)] for r in rows], inserts):
        last = chosen[-1]
        flat = [x for i, o in chosen[:-1] for x in (i, o)] + [last]
        roles = "".join(x[2] for x in flat)
        if pattern.match(roles):
            found = (sum(x[1] for x in flat), "".join(x[0] for x in flat))
            best = found if best is None else min(best, found)
    return best


def test_repair_equals_brute_force():
    rng = random.Random(4)
    for _ in range(120):
        rows = [(rng.choice("suuaat"), rng.random() < 0.2, False) for _ in range(rng.randint(0, 3))]
        rows = [(r, d, not d and rng.random() < 0.3) for r, d, _ in rows]
        assert op13_conversations.cheapest(rows) == brute_repair(rows), rows


def test_repair_of_long_conversations_is_least():
    """Against a table of the best (cost, audit) by row and place."""
    rng = random.Random(9)
    for n in (0, 1, 40, 700):
        rows = [(rng.choice("suuaaat"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(n)]
        now = {0: (0, "")}
        insert = lambda t: {p: min(x for x in (t.get(p), *((t[q][0] + 3, t[q][1] + "I") for q in t if op13_conversations.ASKED[q][0] == p)) if x) for p in range(4) if p in t or any(op13_conversations.ASKED[q][0] == p for q in t)}
        now = insert(insert(now))
        for row in rows:
            new = {}
            for p, (c, a) in now.items():
                for letter, cost, to in op13_conversations.edits(p, *row):
                    new[to] = min(new.get(to, (1 << 60, "")), (c + cost, a + letter))
            now = insert(insert(new))
        assert op13_conversations.cheapest(rows) == min(now[p] for p in (0, 3) if p in now)


def plain_judgement(rows):
    """rows (role, text, turn) in order: gaps, blank, duplicate, truncated, illegal and what cheapest() gets."""
    seen, found, counts = set(), [], [0, 0, 0]
    for role, text, _ in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        found.append((role[:1], fault in (0, 1), fault == 2))
    turns = {t for _, _, t in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:])), found


def plain_query(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        held = by[conv]
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        role = "user" if key == 4 else role
        held += [(role, text, turn)] * (0 if key == 0 else 2 if key == 3 else 1)
    out = []
    for conv, held in by.items():
        held.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
        *head, found = plain_judgement(held)
        cost, audit = op13_conversations.cheapest(found)
        fixed = op13_conversations.applied(audit, [(r, t) for r, t, _ in held])
        initials = "".join(r[:1] for r, _ in fixed)
        assert re.fullmatch("(s?(ua)+)?", initials)
        out.append((str(conv), *head, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out)


def test_repair_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in op13_conversations.op13_conversation_repair(spark, SMALL).collect())
    assert got == plain_query(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", " \t\n", "", None, "é!\n"])) for c in [*range(30), None] for _ in range(5)]
    rows += [(100, t, "user", "x" * 100_000 + ".") for t in range(3)]
    table = spark.createDataFrame([(*r, 1, "") for r in rows], "conv_id long, turn long, role string, text string, copy int, there string")
    monkeypatch.setattr(op13_conversations, "table", lambda *_: table)
    got = sorted((str(r[0]), *r[1:]) for r in op13_conversations.op13_conversation_repair(spark, "").collect())
    assert got == plain_query(rows)
    monkeypatch.setattr(op13_conversations, "table", lambda *_: table.limit(0))
    assert op13_conversations.op13_conversation_repair(spark, "").count() == 0
    whole = op13_conversations.repaired(table.select("conv_id", "turn", "role", "text")).collect()
    assert len(whole) == 32 and all(re.fullmatch("(s?(ua)+)?", "".join(m.role[:1] for m in r.repaired)) for r in whole)


def test_conversation_whose_rows_are_all_absent(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    r = op13_conversations.repaired(rows, F.lit(False)).collect()
    assert [tuple(x) for x in r] == [(1, 0, 0, 0, 0, 0, 0, "", [])]
