"""Training of the attention model looks at every window of every training document."""

import tracemalloc

import numpy as np

from loredeck.llm import op4_attention_lm as lm


def test_every_window_is_learnt_from_once(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([1, 20, 24, 25, 100, 3000, 1, 5000])
    ids = rng.integers(1, 4000, lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids[offsets[1:] - 1] = lm._END
    model = lm.Attention.fresh(np.bincount(ids, minlength=4000))
    seen = []
    monkeypatch.setattr(lm.Training, "step", lambda self, before, after, first: seen.extend(map(tuple, np.concatenate([before, after, first[:, None]], 1))))
    for turn in range(lm.ROUNDS):
        task = lm.Training(model, turn)
        task.learn(ids, offsets, np.arange(len(lengths)) + (3 << 32))
        task.finish()
    before, after, first, _ = lm.windows(model.classes[ids], offsets)
    assert sorted(seen) == sorted(map(tuple, np.concatenate([before, after, first[:, None]], 1)))


def test_windows_of_two_byte_classes_stay_small():
    """Both sides of all windows, and what making them needs, within 4 times the windows' own two bytes a place."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 4000, 200)
    ids = rng.integers(1, 4000, lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids[offsets[1:] - 1] = lm._END
    classes = lm.classes_of(np.bincount(ids, minlength=4000))[0].astype(np.int16)[ids]
    tracemalloc.start()
    before, after, _, _ = lm.windows(classes, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert before.dtype == after.dtype == np.int16
    assert peak < 4 * (before.nbytes + after.nbytes)


def test_rows_without_a_target_have_no_part_in_the_heads():
    rng = np.random.default_rng(7)
    model = lm.Attention.fresh(np.bincount(rng.integers(0, 3000, 5000), minlength=4000))
    z, target, last = rng.normal(size=(300, lm.WIDTH)).astype(np.float32), rng.integers(0, lm.CLASSES, 300), rng.integers(0, lm.CLASSES, 300)
    some = rng.integers(0, 3, 300) > 0
    alone, _ = model.heads(z[some], target[some], last[some])
    among, _ = model.heads(z, np.where(some, target, -1), last)
    assert np.allclose(among[some], alone, atol=1e-5) and not among[~some].any()
