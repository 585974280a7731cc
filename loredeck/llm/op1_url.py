"""URL filter: host and path rules, and for URLs without a rule a character language-model ratio.

Two variable-order Markov models over the bytes of host and path, one learned from URLs that the rules allow and
one from those they block, give each URL a log-likelihood; their difference, divided by the length, is compared
with a threshold calibrated on rule-labelled URLs left out of the fit. Orders are interpolated by Witten-Bell
weights: an unseen context passes all its mass to the next shorter one, down to uniform bytes.

All distinct URLs with a rule are learned from or calibrated on: Spark counts their grams, then folds them by a hash into
tables of a fixed number of slots, so the models' size has a bound that leaves no URL out; scores of those held out
are counted in bins of fixed width, each with its least and its greatest score.

Rules: host and path prefix; a rule fits its host and all subdomains if the path starts with the rule's; the
longest wins. Cases: a null URL, or one without ://, has empty host and path, fits no rule and is judged by the
models like any other text; repeated pages are judged row by row; with no labelled URL of one kind the models
can't tell and every unruled URL is allowed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm.common import materialise, slices, table, text_bytes
from loredeck.llm.words import mix

#: (host, path, verdict); the rule's name is host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Longest context in bytes; a context and the next byte fit one 64-bit key.
ORDER = 5
#: Slots that the grams of an order and their contexts are folded into; bins of a score of 1.
SLOTS, CONTEXT_SLOTS, BINS = 1 << 20, 1 << 18, 4096
KINDS = ("allow", "block")
_STRIP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _STRIP, _STRIP.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte the key of its last `order` + 1 bytes within its row; bytes before a row's start count as 0."""
    at = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = np.zeros(len(raw), np.int64)
    for k in range(order, -1, -1):
        byte = np.zeros(len(raw), np.int64)
        byte[k:] = raw[: len(raw) - k]
        key = key << 8 | np.where(at >= k, byte, 0)
    return key


def folded(key: np.ndarray, size: int, slots: int) -> np.ndarray:
    """The slot of keys of `size` bytes: themselves if there are slots for all, else by hash."""
    return key if 256**size <= slots else (mix(key.astype(np.uint64)) % np.uint64(slots)).astype(np.int64)


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)).astype(np.int64) for v in values)


class Markov:
    """Interpolated variable-order model: for each order sorted slots of grams with counts, and of contexts with counts and kinds of next bytes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        for k in range(order + 1):
            keys, n = np.unique(grams(raw, offsets, k), return_counts=True)
            self.levels.append((*added(folded(keys, k + 1, SLOTS), n), *added(folded(keys >> 8, k, CONTEXT_SLOTS), n, np.ones(len(n)))))

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, ...]]) -> Markov:
        own = cls.__new__(cls)
        own.order, own.levels = len(levels) - 1, levels
        return own

    def taught(self) -> bool:
        return len(self.levels[0][0]) > 0

    def log_likelihood(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log-likelihood of each row."""
        p = np.full(len(raw), 1 / 256)
        for k, (keys, n, context, total, kinds) in enumerate(self.levels):
            if not len(keys):
                continue
            gram = grams(raw, offsets, k)
            key, before = folded(gram, k + 1, SLOTS), folded(gram >> 8, k, CONTEXT_SLOTS)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            j = np.minimum(np.searchsorted(context, before), len(context) - 1)
            seen = np.minimum(np.where(keys[i] == key, n[i], 0), total[j])  # a slot that grams share may hold more
            known = context[j] == before
            p = np.where(known, (seen + kinds[j] * p) / np.where(known, total[j] + kinds[j], 1), p)
        out = np.zeros(len(offsets))
        np.cumsum(np.log(p), out=(c := np.zeros(len(raw) + 1))[1:])
        out = c[offsets[1:]] - c[offsets[:-1]]
        return out


class Ratio:
    """Both models and the threshold on their length-normalised log-likelihood difference (accepted minus rejected)."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected = accepted, rejected
        self.threshold = 0.0 if accepted.taught() and rejected.taught() else -np.inf

    def score(self, column: pa.Array) -> np.ndarray:
        raw, offsets = text_bytes(column)
        return (self.accepted.log_likelihood(raw, offsets) - self.rejected.log_likelihood(raw, offsets)) / np.maximum(1, np.diff(offsets))

    def calibrate(self, low: np.ndarray, high: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> None:
        """The cut between bins with the fewest errors, each kind of error weighed by its class; the middle of its gap.

        Bins in the order of scores, with the least and the greatest score and the numbers of both kinds.
        """
        if np.isinf(self.threshold) or not accepted.sum() or not rejected.sum():
            return
        lost = np.concatenate([[0], np.cumsum(accepted / accepted.sum() - rejected / rejected.sum())])  # accepted lost less rejected caught below the cut
        cuts = np.concatenate([[low[0] - 1e-9], (low[1:] + high[:-1]) / 2, [high[-1] + 1e-9]])
        self.threshold = float(cuts[int(np.argmin(lost))])


def counted(urls: DataFrame) -> DataFrame:
    """kind, level, whether of contexts, slot, n and kinds: the tables of both models, over all rows (text, verdict)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for kind, verdict in enumerate(KINDS):
                raw, offsets = text_bytes(b.column("text").filter(pc.equal(b.column("verdict"), verdict)))
                for k in range(ORDER + 1 if len(raw) else 0):
                    gram, n = np.unique(grams(raw, offsets, k), return_counts=True)
                    of = [pa.array(np.full(len(gram), x, np.int32)) for x in (kind, k)]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(gram), pa.array(n)], names=["kind", "level", "gram", "n"])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, level, gram, n = (b.column(c).to_numpy() for c in ("kind", "level", "gram", "n"))
            for x, k in set(zip(kind.tolist(), level.tolist())):
                of = (kind == x) & (level == k)
                for contexts, slot in enumerate((folded(gram[of], k + 1, SLOTS), folded(gram[of] >> 8, k, CONTEXT_SLOTS))):
                    slot, total, kinds = added(slot, n[of], np.ones(of.sum()))
                    own = [pa.array(np.full(len(slot), v, np.int32)) for v in (x, k, contexts)]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v.astype(np.int64)) for v in (slot, total, kinds))], names=["kind", "level", "contexts", "slot", "n", "kinds"])

    exact = urls.mapInArrow(count, "kind int, level int, gram long, n long").groupBy("kind", "level", "gram").agg(F.sum("n").alias("n"))
    parts = exact.mapInArrow(fold, "kind int, level int, contexts int, slot long, n long, kinds long")
    return parts.groupBy("kind", "level", "contexts", "slot").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))


def fit(judged: DataFrame) -> Ratio:
    """judged: url, host, path, verdict of URLs that a rule decides."""
    held = (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held")
    urls = materialise(judged.distinct().select(F.concat("host", "path").alias("text"), "verdict", held), "urls")
    rows = counted(urls.filter("not held")).toArrow()
    kind, level, contexts, slot, n, kinds = (rows.column(c).to_numpy() for c in ("kind", "level", "contexts", "slot", "n", "kinds"))

    def tables(x: int, k: int) -> Iterator[np.ndarray]:
        for c in (0, 1):
            own = np.flatnonzero((kind == x) & (level == k) & (contexts == c))
            own = own[np.argsort(slot[own])]
            yield from (slot[own], n[own], kinds[own])[: 2 + c]

    ratio = Ratio(*(Markov.of([tuple(tables(x, k)) for k in range(ORDER + 1)]) for x in range(len(KINDS))))
    shared = judged.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(b.column("text"))), b.column("verdict")], names=["score", "verdict"])

    scores = urls.filter("held").select("text", "verdict").mapInArrow(score, "score double, verdict string")
    of = [F.count_if(F.col("verdict") == v).alias(v) for v in KINDS]
    bins = scores.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.min("score").alias("low"), F.max("score").alias("high"), *of).orderBy("bin").toArrow()
    ratio.calibrate(*(bins.column(c).to_numpy() for c in ("low", "high", *KINDS)))
    shared.destroy()
    return ratio


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the models' score of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("hit", ruled(F.col("host"), F.col("path"), rules))
    model = pages.sparkSession.sparkContext.broadcast(fit(parts.filter("hit is not null").select("url", "host", "path", "hit.verdict")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = model.value.score(b.column("text"))
            rule, verdict = b.column("rule"), b.column("verdict").to_pylist()
            verdict = [v or ("allow" if s >= model.value.threshold else "block") for v, s in zip(verdict, score.tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), rule, pa.array(verdict, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return parts.select("page_id", "host", "path", "hit.rule", "hit.verdict", F.concat("host", "path").alias("text")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
