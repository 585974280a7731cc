"""What a parse lost, against counting line by line."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loredeck.operators.losses import lines_of, losses


def plain(reference, kept):
    of = lambda t: Counter(x.strip() for x in (t or "").split("\n") if len(x.strip()) >= 6)
    kept_lines = {}
    for k, t in kept:
        kept_lines.setdefault(k, Counter()).update(of(t))
    out = {}
    for k, t in reference:
        a, b = of(t), kept_lines.get(k, Counter())
        extra = b - a
        lost = a - b
        cut = sum(n for line, n in lost.items() if any(line.startswith(e) for e in extra))
        n = sum(a.values())
        loss = round((sum(lost.values()) - cut) / n, 6) if n else 0.0
        out[k] = (n, sum(lost.values()), cut, sum(extra.values()), loss, "BLOCK" if loss > 0.01 else "PASS")
    return out


def test_losses_equal_counting(spark):
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(3, 9)))
    reference = [(i, "\n".join(f" {line()}\t" for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "long enough\n" * 3), (103, "truncated here")]
    kept = [(k, "\n".join(x[: rng.choice((99, 7))] for x in t.split("\n") if rng.random() < 0.8)) for k, t in reference if t and k < 100 and k % 7] + [(102, "long enough"), (103, "truncat"), (103, None)]
    table = lambda rows: spark.createDataFrame(rows, "k long, t string").select("k", lines_of(F.col("t")).alias("lines"))
    got = {r.k: (r.lines, r.lost, r.cut, r.extra, r.loss, r.verdict) for r in losses(table(reference), table(kept), "k").collect()}
    assert got == plain(reference, kept)
    assert got[102] == (3, 2, 0, 0, 0.666667, "BLOCK") and got[103] == (1, 1, 1, 1, 0.0, "PASS")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, t string").select("k", lines_of(F.col("t")).alias("lines"))
    assert losses(none, none, "k").collect() == []
