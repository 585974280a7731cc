"""Byte-level BPE, token files and URL rules: against the public libraries, exact round trips, odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from loredeck.llm import op1_url, op2_bpe, op5_token_files, words

BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdeABC 'stllmd  \t\n\x0b\x0c\x1c\x1f\x85\xa0​0129½².,!?-éñßΣσςİЖ中字🙂́한ﬁ<|>"
ODD = [None, "", " ", "\n\n", "a", "<|endoftext|>", "x" * 3000, "the " * 2000, "The END. The END."]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD)] + [(3, "\n\n", "again"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_bpe_equals_the_library(library):
    rng = random.Random(1)
    ours = op2_bpe.coder(BPE)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80)))
        ids = ours.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_long_matches_take_the_other_path_to_the_same_ids(library):
    ours = op2_bpe.coder(BPE)
    rng = random.Random(2)
    for n in (65, 200, 5000):
        word = "".join(rng.choice("abcthe") for _ in range(n))
        assert ours.merge(word.encode()) == library.encode_ordinary(word)


def test_segment_tree_gives_the_leftmost_minimum():
    tree = op2_bpe.SegmentTree([5, 2, 7, 2])
    assert tree.best() == (2, 1)
    tree.put(1, op2_bpe.NONE)
    assert tree.best() == (2, 3)
    tree.put(3, 9)
    assert tree.best() == (5, 0)


def test_bpe_of_odd_rows(odd_docs, library):
    for r in op2_bpe.digests(odd_docs, BPE).collect():
        text = (ODD + ["no id"])[-1 if r.doc_id is None else r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert op2_bpe.digests(odd_docs, BPE).count() == len(ODD) + 2
    assert op2_bpe.digests(odd_docs.limit(0), BPE).count() == 0
    assert op2_bpe.encode_documents(odd_docs, BPE).count() == len(ODD) + 2


def test_word_table_equals_the_library():
    rng = random.Random(3)
    library, ours = Tokenizer.from_file(WORDS), op5_token_files.WordTokenizer(WORDS)
    assert ours.by_words
    ours.table = words.WordTable(ours.dtype, slots=128, ids=300)  # starts anew again and again
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", "<|STARTOFTEXT|>"]) for _ in range(rng.randint(0, 60)))
        ids, offsets = ours.encode(pa.array([text, None, text]))
        want = library.encode(text, add_special_tokens=False).ids + [op5_token_files.END_ID]
        assert ids.tolist() == want + [op5_token_files.END_ID] + want and offsets.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_codes_give_back_any_token():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = rng.choice([0, 1, 255, 256, 65535, 65536, 2**31], n).astype(np.uint32)
        codes = op5_token_files.Codes.encode(ids)
        assert (codes.decode() == ids).all() and len(codes) == n
        for i in rng.integers(0, n, 50) if n else []:
            assert codes.get(int(i)) == ids[i]
            assert (codes.decode(int(i), n) == ids[i:]).all()
        doc_ids, lengths, again = op5_token_files.read_file(op5_token_files.write_file([4, None], [ids, ids[:3]]))
        assert doc_ids == [4, None] and lengths.tolist() == [n, min(3, n)] and (again.decode() == np.concatenate([ids, ids[:3]])).all()
    with pytest.raises(ValueError):
        op5_token_files.read_file(b"nothing at all")


def test_token_files_of_odd_rows(odd_docs, monkeypatch):
    monkeypatch.setattr(op5_token_files, "RANGE_BYTES", 3000)
    monkeypatch.setattr(op5_token_files, "FILE_TOKENS", 1000)
    library = Tokenizer.from_file(WORDS)
    rows = sorted(op5_token_files.read(op5_token_files.write(odd_docs, WORDS)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    at = 0
    for r in rows:
        ids = library.encode("no id" if r.doc_id is None else ODD[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert op5_token_files.read(op5_token_files.write(odd_docs.limit(0), WORDS)).count() == 0


URLS = [
    ("http://A.NET/x", "a.net", "/x", "net/", "block"), ("http://www.Example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"), ("http://m.example.com/de/3", "m.example.com", "/de/3", "example.com/de/", "block"),
    ("http://badexample.com/de/3", "badexample.com", "/de/3", None, None), ("http://x.org/fr/a/b", "x.org", "/fr/a/b", "org/fr/", "allow"), ("http://x.org/FR/a", "x.org", "/FR/a", None, None),
    ("http://a.net", "a.net", "", None, None), ("http://a.net?b/c", "a.net", "", None, None), (None, "", "", None, None), ("a.net/x", "", "", None, None), ("", "", "", None, None), ("x://h/p://q/en/", "h", "/p://q/en/", None, None),
]


def test_url_rules_and_odd_urls(spark):
    rows = [(i, u[0], "clash", None) for i, u in enumerate(URLS)] + [(0, URLS[0][0], "again", None), (None, "http://q.org/fr/", "x", None)]
    got = op1_url.judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            url, host, path, rule, verdict = URLS[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule), url
            assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_url_models_tell_the_kinds_apart(spark):
    kinds = [("allow", "shop{}.example.net/en/good{}"), ("block", "casino{}.x.net/win{}")]
    seen = [(v, "http://" + p.format(i % 7, i)) for i in range(400) for v, p in kinds]
    new = [("allow", "http://shop.example.org/en/good1"), ("block", "http://casino.x.info/win2")]
    got = {r.page_id: r for r in op1_url.judge(spark.createDataFrame([(i, u) for i, (_, u) in enumerate(seen + new)], "page_id long, url string")).collect()}
    assert all(got[len(seen) + i].verdict == v and got[len(seen) + i].rule is None for i, (v, _) in enumerate(new))
    assert op1_url.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_markov_is_a_distribution_and_equals_a_plain_count():
    import pyarrow as pa

    from loredeck.llm.common import text_bytes

    model = op1_url.Markov(*text_bytes(pa.array(["abab", "abc"])), order=2)
    raw = np.array([97], np.uint8)
    total = 0.0
    for c in range(256):
        total += np.exp(model.log_likelihood(np.array([97, c], np.uint8), np.array([0, 2])) - model.log_likelihood(raw, np.array([0, 1])))[0]
    assert abs(total - 1) < 1e-9
