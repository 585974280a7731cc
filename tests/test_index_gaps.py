"""Places of the stored index are kept as gaps."""

import random

import numpy as np

from loredeck.sources import index as stored


def test_gaps_come_back():
    rng = np.random.default_rng(1)
    gaps = np.concatenate([[0, 1, 127, 128, 16383, 16384, (1 << 40) + 5], rng.integers(0, 1 << 20, 500)])
    raw, width = stored.packed_gaps(gaps)
    assert len(raw) == width.sum() and (stored.unpacked_gaps(raw.tobytes()) == gaps).all()
    assert len(stored.unpacked_gaps(b"")) == 0


def test_a_place_takes_two_bytes_at_most():
    rng = random.Random(2)
    texts = [["".join(rng.choice("abcdef ") for _ in range(500))] for _ in range(60)]
    rows = stored._gram_rows(0, 0, list(range(60)), texts)
    kept = sum(len(v or b"") for c in ("docs", "places") if c in rows.schema.names for v in rows.column(c).to_pylist())
    assert kept <= 2 * 500 * 60
