"""Retrieval quality: coverage, recall, precision, nDCG, losses, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.operators.retrieval import best_documents
from loredeck.registry import operator
from loredeck.sources.tables import EVENTS_SQL, events, read

K = 10
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}'))"
#: Passages as queries: documents ranked by how many of a passage's words they hold; the expected ones hold nearly all.
_RANKED = f"""q AS (SELECT item_id, unnest({_WORDS}) AS word FROM benchmark), n AS (SELECT item_id, count(*) AS size FROM q GROUP BY item_id),
  d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), h AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (word) GROUP BY ALL),
  r AS (SELECT item_id, doc_id, hits, size, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM h JOIN n USING (item_id)),
  e AS (SELECT item_id, doc_id FROM r WHERE hits >= 0.9 * size)"""


def words(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]{4,}"), F.lit(0)))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, size, enough and top: of each passage the ten documents with most of its words, and how many are expected."""
    return best_documents(read(spark, sf, "documents"), words("text"), read(spark, sf, "benchmark"), words("text"), K)


def expected(hit: Column) -> Column:
    return hit["hits"] >= 0.9 * F.col("size")


def got() -> Column:
    """How many of the returned documents are expected."""
    return F.size(F.filter("top", expected))


@operator("ingest_coverage", f"WITH {_RANKED} SELECT item_id, round(max(hits) / CAST(max(size) AS DOUBLE), 6) AS coverage FROM r GROUP BY item_id")
def ingest_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-03: the share of a query's words found in its best document."""
    return ranked(spark, sf).select("item_id", F.round(F.col("top")[0]["hits"] / F.col("size"), 6).alias("coverage"))


@operator("recall_precision_at_k", f"WITH {_RANKED}, x AS (SELECT item_id, count(*) AS n, count(*) FILTER (rank <= {K}) AS got FROM r JOIN e USING (item_id, doc_id) GROUP BY item_id), t AS (SELECT item_id, least(count(*), {K}) AS returned FROM r GROUP BY item_id) SELECT item_id, round(got / CAST(n AS DOUBLE), 6) AS recall, round(got / CAST(returned AS DOUBLE), 6) AS precision FROM x JOIN t USING (item_id)")
def recall_precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-01/02/04, SET-04: of the expected, and of the returned, those found among the first ten."""
    return ranked(spark, sf).filter("enough > 0").select("item_id", F.round(got() / F.col("enough"), 6).alias("recall"), F.round(got() / F.size("top"), 6).alias("precision"))


@operator("ndcg_at_k", f"WITH {_RANKED}, x AS (SELECT item_id, count(*) AS n, sum(CASE WHEN rank <= {K} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN e USING (item_id, doc_id) GROUP BY item_id), i AS (SELECT item_id, sum(1 / log2(p + 1)) AS ideal FROM (SELECT item_id, unnest(range(1, least(n, {K}) + 1)) AS p FROM x) GROUP BY item_id) SELECT item_id, round(dcg / ideal, 6) AS ndcg FROM x JOIN i USING (item_id)")
def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-06, WIN-03, MTH-03: discounted gain over the best possible."""
    gain = lambda p: 1 / F.log2(p + 1)
    places = F.transform("top", lambda hit, i: F.when(expected(hit), gain(i + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("enough"), F.lit(K)).cast("int")), F.lit(0.0), lambda a, p: a + gain(p))
    return ranked(spark, sf).filter("enough > 0").select("item_id", F.round(F.aggregate(places, F.lit(0.0), lambda a, g: a + g) / ideal, 6).alias("ndcg"))


@operator("routing_hit", f"WITH {_RANKED} SELECT item_id, max(CASE WHEN rank = 1 AND e.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM r LEFT JOIN e USING (item_id, doc_id) GROUP BY item_id")
def routing_hit(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-05/14: whether the first document is an expected one."""
    return ranked(spark, sf).select("item_id", F.when(expected(F.col("top")[0]), 1).otherwise(0).alias("hit"))


@operator("stratum_means", "SELECT lang, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS stratum, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def stratum_means(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-22, EVL-07: means of each stratum, unknown values left out."""
    stratum = F.when(F.col("n_chars") < 800, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").groupBy("lang", stratum.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@operator("kpi_miss_rate", f"WITH {_RANKED}, x AS (SELECT n.item_id, max(CASE WHEN e.doc_id IS NOT NULL AND rank <= {K} THEN 1 ELSE 0 END) AS hit FROM n LEFT JOIN r USING (item_id) LEFT JOIN e USING (item_id, doc_id) GROUP BY n.item_id) SELECT CAST(count(*) AS BIGINT) AS queries, round((1 - avg(hit)) * 100, 3) AS miss_rate FROM x")
def kpi_miss_rate(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-21, EVL-11: queries whose first ten hold nothing expected."""
    q = read(spark, sf, "benchmark").filter(F.size(words("text")) > 0).select("item_id")
    hit = ranked(spark, sf).select("item_id", F.when(got() > 0, 1).otherwise(0).alias("hit"))
    return q.join(hit, "item_id", "left").agg(F.count("*").alias("queries"), F.round((1 - F.avg(F.coalesce("hit", F.lit(0)))) * 100, 3).alias("miss_rate"))


@operator("token_set_loss", "SELECT page_id, CAST(len(a) AS BIGINT) AS words, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS lost FROM (SELECT page_id, list_distinct(regexp_extract_all(lower(html), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(regexp_replace(html, '<[^>]+>', ' ', 'g')), '[a-z]{3,}')) AS b FROM pages)")
def token_set_loss(spark: SparkSession, sf: str) -> DataFrame:
    """SET-03: tokens of the source missing in the result."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)))
    a, b = tokens(F.col("html")), tokens(F.regexp_replace("html", "<[^>]+>", " "))
    return read(spark, sf, "pages").select("page_id", F.size(a).cast("long").alias("words"), F.size(F.array_except(a, b)).cast("long").alias("lost"))


@operator("regression_gate", f"WITH {EVENTS_SQL}, d AS (SELECT event_type, day, avg(value) AS v FROM ev GROUP BY ALL), w AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM d) SELECT event_type, day, CASE WHEN b IS NULL THEN 'PASS' WHEN v - b < -0.1 * b THEN 'BLOCK' WHEN v - b < -0.05 * b THEN 'WARN' ELSE 'PASS' END AS gate FROM w")
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-09/10: a fall below the baseline blocks or warns."""
    d = events(spark, sf).groupBy("event_type", "day").agg(F.avg("value").alias("v"))
    b = F.avg("v").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-7, -1))
    return d.withColumn("b", b).select("event_type", "day", F.when(F.col("b").isNull(), "PASS").when(F.col("v") - F.col("b") < -0.1 * F.col("b"), "BLOCK").when(F.col("v") - F.col("b") < -0.05 * F.col("b"), "WARN").otherwise("PASS").alias("gate"))


@operator("before_after_delta", f"WITH {EVENTS_SQL}, m AS (SELECT user_id, avg(value) FILTER (day < '2024-01-16') AS before, avg(value) FILTER (day >= '2024-01-16') AS after FROM ev GROUP BY user_id) SELECT user_id, round(after - before, 6) AS delta FROM m")
def before_after_delta(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-13, WIN-11: change of each key between two runs."""
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    return events(spark, sf).groupBy("user_id").agg(F.round(mean(F.col("day") >= "2024-01-16") - mean(F.col("day") < "2024-01-16"), 6).alias("delta"))


@operator("gold_strata", "SELECT CASE WHEN regexp_matches(lower(text), '(the|and|of)') THEN 'en' ELSE 'other' END AS stratum, CAST(count(*) AS BIGINT) AS n, count(*) >= 5 AS enough, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark GROUP BY 1")
def gold_strata(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-07/08: strata of the query set and whether each is large enough."""
    stratum = F.when(F.lower("text").rlike("(the|and|of)"), "en").otherwise("other")
    return read(spark, sf, "benchmark").groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), (F.count("*") >= 5).alias("enough"), F.sum(F.length("text")).alias("chars"))
