"""URL models: learned from all URLs with a rule, whatever their number."""

import numpy as np
import pyarrow as pa

from loredeck.llm import op1_url
from loredeck.llm.common import text_bytes


def judged(spark, rows):
    return spark.createDataFrame([(f"http://{h}{p}", h, p, v) for h, p, v in rows], "url string, host string, path string, verdict string")


def test_every_labelled_url_is_counted(spark, monkeypatch):
    monkeypatch.setattr(op1_url, "FIT_ROWS", 20, raising=False)
    monkeypatch.setattr(op1_url, "CALIBRATION_ROWS", 5, raising=False)
    rows = [(f"h{i % 13}.net", f"/{'xyz'[i % 3]}{i}", "block" if i % 3 else "allow") for i in range(900)]
    df = judged(spark, rows * 2).repartition(3)
    ratio = op1_url.fit(df)
    held = {r.url for r in df.selectExpr("url", "pmod(xxhash64(url), 5) = 0 as held").collect() if r.held}
    for model, verdict in ((ratio.accepted, "allow"), (ratio.rejected, "block")):
        want = op1_url.Markov(*text_bytes(pa.array([h + p for h, p, v in rows if v == verdict and f"http://{h}{p}" not in held])))
        assert all(np.array_equal(a, b) for x, y in zip(model.levels, want.levels, strict=True) for a, b in zip(x, y, strict=True))


def test_the_threshold_is_the_cut_with_the_fewest_errors(spark):
    rows = [(f"a{i}.net", "/good/" + "ab"[i % 2] * (i % 5), "allow") for i in range(200)] + [(f"b{i}.net", "/bad/" + "ab"[i % 2] * (i % 7), "block") for i in range(300)]
    df = judged(spark, rows)
    ratio = op1_url.fit(df)
    held = [r for r in df.selectExpr("concat(host, path) text", "verdict", "pmod(xxhash64(url), 5) = 0 as held").collect() if r.held]
    s, ok = ratio.score(pa.array([r.text for r in held])), np.array([r.verdict == "allow" for r in held])
    lost = lambda t: np.mean(s[ok] < t) + np.mean(s[~ok] >= t)
    assert lost(ratio.threshold) <= min(map(lost, s)) + 1e-9
