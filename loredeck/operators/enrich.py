"""Enrichment of nodes: labels from paths, dates from names, summaries and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least text that is enriched, most characters of a summary, most keywords (fixed values).
LEAST_BODY, MOST_SUMMARY, MOST_KEYWORDS = 20, 300, 10
#: Letters of each script, and the least and most of them in a keyword (fixed values).
SCRIPTS = [("A-Za-z", 3, ""), ("가-힣", 2, 6)]


def sentences(text: Column, n: int) -> Column:
    """STR-05: the first n sentences, joined by a full stop and a space, though they keep their own end."""
    marked = F.regexp_replace(text, r"([.?!])\s+", "$1\u0001")  # where a sentence ends
    parts = F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(F.slice(parts, 1, n), ". "), 1, MOST_SUMMARY)


def reference_date(path: Column, title: Column) -> Column:
    """DT-05: the date in the deepest folder that holds one, else in the title: eight digits, else six; null if none is valid."""

    def dated(c: Column) -> Column:
        eight = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(20\d{6})(?!\d)"), F.lit(1)), lambda x: x)
        six = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1)), lambda x: F.concat(F.when(F.substring(x, 1, 2).cast("int") < 70, "20").otherwise("19"), x))
        dates = F.filter(F.transform(F.concat(eight, six), lambda x: F.try_to_date(x, "yyyyMMdd")), lambda d: d.isNotNull())
        return F.get(dates, 0)

    places = F.concat(F.reverse(F.split(path, "/")), F.array(title))
    return F.get(F.filter(F.transform(places, dated), lambda d: d.isNotNull()), 0)


def path_tokens(path: Column) -> Column:
    """STR-09: words of a path: no extension, no numbers, two characters at least."""
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", "")
    return F.array_distinct(F.filter(F.split(bare, r"[/\\@_\-\s]+"), lambda x: (F.length(x) >= 2) & ~x.rlike(r"^\d+$")))


def category(path: Column) -> Column:
    """STR-09: the first two segments."""
    return F.array_join(F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, 2), " / ")


def first_by_lower(words: Column, most: int = MOST_KEYWORDS) -> Column:
    """STR-08, SET-05: words without repeats whatever the case, in order of first appearance."""
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda a, x: F.when(F.array_contains(F.transform(a, lambda y: F.lower(y)), F.lower(F.trim(x))) | (F.trim(x) == ""), a).otherwise(F.concat(a, F.array(F.trim(x)))))
    return F.slice(kept, 1, most)


def enriched(nodes: DataFrame) -> DataFrame:
    """REM-03, STR-07: nodes (source_type, title, path, body) with summary and keywords; both null for a body too short."""
    body = F.trim(F.coalesce("body", F.lit("")))
    long_enough = F.length(body) >= LEAST_BODY
    summary = F.when(F.col("source_type") == "wiki", sentences(body, 3)).when(F.col("source_type") == "gdi", F.substring(F.concat(F.lit("["), category(F.col("path")), F.lit("] "), sentences(body, 2)), 1, MOST_SUMMARY)).otherwise(sentences(body, 2))
    word = "|".join(f"[{letters}]{{{least},{most}}}" for letters, least, most in SCRIPTS)
    words = lambda c, n: F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(word), F.lit(0))), 1, n)
    keywords = first_by_lower(F.concat(path_tokens(F.coalesce("path", F.lit(""))), words(F.coalesce("title", F.lit("")), 3), words(body, MOST_KEYWORDS)))
    return nodes.withColumn("summary", F.when(long_enough, summary)).withColumn("keywords", F.when(long_enough, keywords))
