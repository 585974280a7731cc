"""Full-text ranking and result shaping."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loredeck.functions.text import has, occurrences, trigrams

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weight of a hit by folder role and chunk origin (fixed values).
WEIGHTS = {
    "planning": {"sheet": 1.4, "table": 1.4, "section": 1.2, "sliding": 0.9, "preamble": 1.0, "legacy": 0.8},
    "qa_result": {"sheet": 1.3, "table": 1.4, "section": 1.1, "sliding": 0.9, "preamble": 1.0, "legacy": 0.8},
    "live_issue": {"sheet": 0.9, "table": 1.0, "section": 1.4, "sliding": 1.2, "preamble": 1.1, "legacy": 0.8},
    "dashboard": {"sheet": 1.0, "table": 1.1, "section": 1.2, "sliding": 1.0, "preamble": 1.0, "legacy": 0.8},
    "game_data": {"sheet": 1.5, "table": 1.4, "section": 0.9, "sliding": 0.7, "preamble": 1.0, "legacy": 0.7},
    "unknown": {"sheet": 1.0, "table": 1.0, "section": 1.0, "sliding": 1.0, "preamble": 1.0, "legacy": 0.8},
}


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def matches(keywords: list[str], columns: list[str]) -> Column:
    """Every keyword stands in one of the columns."""
    return all_of([any_of([has(c, k) for c in columns]) for k in keywords])


def bm25(df: DataFrame, keywords: list[str], columns: list[str]) -> DataFrame:
    """Rows in which every keyword stands, with relevance (higher is better) over trigram tokens.

    One pass for the statistics, which are a single row, and one for the scores.
    """
    length = functools.reduce(operator.add, (trigrams(c) for c in columns))
    stats = df.agg(F.count("*").alias("N"), F.avg(length).alias("avgdl"), *(F.count_if(any_of([has(c, k) for c in columns])).alias(f"n{i}") for i, k in enumerate(keywords)))
    found = df.filter(matches(keywords, columns)).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, k in enumerate(keywords):
        f = functools.reduce(operator.add, (occurrences(c, k) for c in columns)).cast("double")
        idf = F.greatest(F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("avgdl")))
    return found.withColumn("relevance", score).drop("N", "avgdl", *(f"n{i}" for i in range(len(keywords))))


def bm25_sql(table: str, keywords: list[str], columns: list[str], keep: str) -> str:
    """The same in SQL: `keep` columns and relevance."""
    low = lambda c: f"lower(coalesce({c}, ''))"
    has_ = lambda k: "(" + " OR ".join(f"contains({low(c)}, '{k}')" for c in columns) + ")"
    f = lambda k: "(" + " + ".join(f"(length({low(c)}) - length(replace({low(c)}, '{k}', ''))) / {len(k)}.0" for c in columns) + ")"
    length = " + ".join(f"greatest(length(coalesce({c}, '')) - 2, 0)" for c in columns)
    stats = f"SELECT count(*) AS N, avg({length}) AS avgdl, " + ", ".join(f"count(*) FILTER ({has_(k)}) AS n{i}" for i, k in enumerate(keywords)) + f" FROM {table}"
    parts = [f"greatest(ln((N - n{i} + 0.5) / (n{i} + 0.5)), {LEAST_IDF}) * {f(k)} * {K1 + 1} / ({f(k)} + {K1} * ({1 - B} + {B} * ({length}) / avgdl))" for i, k in enumerate(keywords)]
    return f"SELECT {keep}, {' + '.join(parts)} AS relevance FROM {table}, ({stats}) WHERE {' AND '.join(map(has_, keywords))}"


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def weights_frame(df: DataFrame) -> DataFrame:
    """The weight matrix as rows; of fixed size."""
    rows = [(r, o, w) for r, by in WEIGHTS.items() for o, w in by.items()]
    return df.sparkSession.createDataFrame(rows, "folder_role string, chunk_origin string, weight double")


def weighted(df: DataFrame) -> DataFrame:
    """Rows with score = relevance times weight; 1 for a pair not in the matrix, 0 for no relevance."""
    return df.join(F.broadcast(weights_frame(df)), ["folder_role", "chunk_origin"], "left").withColumn("score", F.coalesce(F.col("relevance"), F.lit(0.0)) * F.coalesce("weight", F.lit(1.0)))


def ladder(levels: list[DataFrame], key: str | None = None) -> DataFrame:
    """Rows of the first level that has any (of each key, if given), tagged with the level; one plan for all levels."""
    tagged = functools.reduce(DataFrame.unionByName, (d.withColumn("level", F.lit(i)) for i, d in enumerate(levels)))
    if key:
        first = tagged.groupBy(key).agg(F.min("level").alias("__first"))
        return tagged.join(first, key).filter("level = __first").drop("__first")
    return tagged.join(F.broadcast(tagged.agg(F.min("level").alias("__first")))).filter("level = __first").drop("__first")


def first_rung(df: DataFrame, rungs: list[Column], key: str | None = None) -> DataFrame:
    """FTS-07..11: the rows that fit the first rung of a ladder that any row (of the same key, if given) fits, with the rung as level.

    All rungs are conditions on one row, so the rows are read with a mask of them; a null key is a key of its own.
    """
    masked = df.withColumn("__rungs", F.array(*(F.coalesce(c, F.lit(False)) for c in rungs))).filter(F.exists("__rungs", lambda x: x))
    least = F.min((F.array_position("__rungs", True) - 1).cast("int")).alias("level")
    first = masked.groupBy(F.col(key).alias("__key")).agg(least) if key else masked.agg(least)
    joined = masked.join(first, F.col(key).eqNullSafe(F.col("__key"))).drop("__key") if key else masked.join(F.broadcast(first))  # one row
    return joined.filter(F.get("__rungs", F.col("level"))).drop("__rungs")

