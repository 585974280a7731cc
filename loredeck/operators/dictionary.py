"""Many patterns sought in texts at once: spans, the text with them replaced, and what remains.

All patterns of one length are compared in one go: the text's windows of that length have hashes that follow from one
running sum, a window whose hash is a pattern's is compared character by character. So the work for a text grows with
its length and the number of different pattern lengths, not with the number of patterns.

The patterns come from a table. They are sent to the tasks in parts of bounded size; a text is searched once for each
part, and the parts' findings are put together before any choice is made, so the bound changes nothing but the time.

Cases: null and empty texts have no spans; null and empty patterns are left out; a pattern that stands in the table
more than once counts as its smallest rule; without regard to case both sides are lower-cased (in texts whose length
this changes, nothing is lower-cased but characters that stay one).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loredeck.functions.batches import parts as batches_of

#: Characters of patterns in a part, bytes of text searched at once (a longer text alone).
PART_CHARS, SLICE_CHARS = 4 << 20, 1 << 18
BASE = 0x9E3779B97F4A7C15
SPANS = "array<struct<start:int,stop:int,rule:long>>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))


@dataclass
class Patterns:
    """Patterns by length: sorted hashes, characters and rules."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    whole_words: bool
    any_case: bool

    @classmethod
    def of(cls, rules: Iterable[tuple[int, str]], whole_words: bool, any_case: bool) -> Patterns:
        least: dict[str, int] = {}
        for rule, pattern in rules:
            pattern = _lower(pattern) if any_case else pattern
            least[pattern] = min(rule, least.get(pattern, rule))
        groups: dict[int, list[str]] = {}
        for p in least:
            groups.setdefault(len(p), []).append(p)
        out = {}
        for n, group in groups.items():
            codes = np.stack([_codes(p) for p in group])
            up, _ = _powers(1 << (n - 1).bit_length() if n > 1 else 1)
            hashed = (codes.astype(np.uint64) * up[:n]).sum(1, dtype=np.uint64)
            order = np.argsort(hashed, kind="stable")
            out[n] = hashed[order], codes[order], np.array([least[p] for p in group], np.int64)[order]
        return cls(out, whole_words, any_case)

    def occurrences(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Text, start, stop and rule of all occurrences."""
        codes = _codes("\u0003".join(texts))
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        up, down = _powers(1 << max(1, len(codes)).bit_length())
        total = np.append(np.uint64(0), np.cumsum(codes * up[: len(codes)], dtype=np.uint64))
        if self.whole_words:
            kinds, at = np.unique(codes, return_inverse=True)
            inside = np.array([chr(c).isalnum() for c in kinds.tolist()], bool)[at] if len(kinds) else np.zeros(0, bool)
            edge = np.concatenate([[True], ~inside, [True]])  # before each place, and after the last
        found = []
        for n, (hashed, patterns, rules) in self.by_length.items():
            if n > len(codes):
                continue
            own = (total[n:] - total[:-n]) * down[: len(codes) - n + 1]
            k = np.searchsorted(hashed, own)
            hit = np.flatnonzero(hashed[np.minimum(k, len(hashed) - 1)] == own)
            if self.whole_words:
                hit = hit[edge[hit] & edge[hit + n + 1]]
            for s in range(0, len(hit), 1 << 16):
                at = hit[s : s + (1 << 16)]
                at = at[(codes[at[:, None] + np.arange(n)] == patterns[k[at]]).all(1)]
                found.append((at, np.full(len(at), n), rules[k[at]]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        at, n, rule = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((rule, -n, at))
        return text[order], (at - begin[text])[order], (at - begin[text] + n)[order], rule[order]


def column(parts: list[Patterns], text: Column) -> Column:
    """All occurrences of the patterns of all parts in each text; of a part by start, longer ones first."""

    def find(texts: list[str]) -> pa.Array:
        found = [p.occurrences([(_lower(t) if p.any_case else t) for t in texts]) for p in parts]
        of, start, stop, rule = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(of, kind="stable")
        spans = pa.StructArray.from_arrays([pa.array(x[order], kind) for x, kind in ((start, pa.int32()), (stop, pa.int32()), (rule, pa.int64()))], names=["start", "stop", "rule"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[order], np.arange(len(texts) + 1)), pa.int32()), spans)

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in batches_of(batch, SLICE_CHARS):
                yield find(some.fill_null("").to_pylist())
            pa.default_memory_pool().release_unused()  # workers live on for other tasks

    return run(text)


def parts_of(rules: DataFrame, whole_words: bool, any_case: bool) -> list[Patterns]:
    """The table's patterns (rule, pattern) in parts of PART_CHARS characters on average; one comes to the driver at a time."""
    known = rules.filter("pattern <> '' and rule is not null").select(F.col("rule").cast("long").alias("rule"), "pattern")
    chars = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-chars // PART_CHARS))
    part = F.pmod(F.xxhash64(F.lower("pattern")), F.lit(n))
    return [Patterns.of([tuple(r) for r in (known.filter(part == i) if n > 1 else known).collect()], whole_words, any_case) for i in range(n)]


def occurrences(docs: DataFrame, text: str, rules: DataFrame, whole_words: bool = True, any_case: bool = True) -> DataFrame:
    """docs with `spans`: every occurrence of every pattern (start and stop in characters, from 0)."""
    return docs.withColumn("spans", column(parts_of(rules, whole_words, any_case), F.col(text)))


def leftmost_longest(spans: Column) -> Column:
    """STR-13: of overlapping spans the one that starts first, of those the longest, then of the smallest rule."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["rule"].alias("rule"))))
    none = F.lit([]).cast(SPANS)

    def step(kept: Column, s: Column) -> Column:
        last = F.when(F.size(kept) > 0, F.element_at(kept, -1)["stop"]).otherwise(0)
        span = F.struct(s["start"].alias("start"), (-s["back"]).alias("stop"), s["rule"].alias("rule"))
        return F.when(s["start"] >= last, F.array_append(kept, span)).otherwise(kept)

    return F.aggregate(ordered, none, step)


def replaced(text: Column, spans: Column, put: Column | None = None) -> Column:
    """STR-13/14: the text with spans (in order, apart) replaced by what a map of rule to text says, or by nothing (the remainder)."""
    whole = F.coalesce(text, F.lit(""))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        between = F.substring(whole, done["at"] + 1, s["start"] - done["at"])
        new = F.coalesce(F.element_at(put, s["rule"]), F.lit("")) if put is not None else F.lit("")
        return F.struct(s["stop"].alias("at"), F.concat(done["out"], between, new).alias("out"))

    return F.aggregate(spans, state, step, lambda d: F.concat(d["out"], F.substring(whole, d["at"] + 1, F.length(whole))))


def first_rule(spans: Column) -> Column:
    """FLT-18: the smallest rule that a pattern of was found; null if none."""
    return F.array_min(F.transform(spans, lambda s: s["rule"]))
