"""What answers are made of: claims by category, folder listings, ranked ids, logs written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.operators.ranking import best_per, bm25_sql, top
from loredeck.registry import operator
from loredeck.sources.index import ranked
from loredeck.sources.shared import shared_folder
from loredeck.sources.sinks import write_log
from loredeck.sources.tables import CHUNK_PIECES, CHUNKS_SQL, EVENTS_SQL, events, pages, read, text_index

# Categories of claims in the order they are shown in, and the first words that name them; the last takes the rest.
CATEGORIES = ("버그", "UI", "밸런스", "기타")
FIRST_WORDS = {"error": "버그", "view": "UI", "click": "UI", "purchase": "밸런스"}


@operator(
    "claim_counts",
    f"""WITH {EVENTS_SQL}, c AS (SELECT day, CASE split_part(concat(event_type, ' ', user_id), ' ', 1) WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS place FROM ev)
SELECT day, place, [{', '.join(f"'{c}'" for c in CATEGORIES)}][place] AS category, count(*) AS claims FROM c GROUP BY day, place""",
)
def claim_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-30, STR-37: claims of each day by category, in the fixed order, categories without claims left out."""
    claim = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in FIRST_WORDS.items() for x in pair)), F.lower(F.regexp_extract(claim, r"^(\S*)", 1)))
    category = F.coalesce(known, F.lit(CATEGORIES[-1]))
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col("category")).cast("int")
    return events(spark, sf).groupBy("day", category.alias("category")).agg(F.count("*").alias("claims")).select("day", place.alias("place"), "category", "claims")


_LISTING = 10


@operator(
    "folder_listing",
    f"""WITH f AS (SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages WHERE contains(url, '/'))
SELECT folder, CAST(place AS INTEGER) AS place, name, page_id, total FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name, page_id) AS place, count(*) OVER (PARTITION BY folder) AS total FROM f) WHERE place <= {_LISTING}""",
)
def folder_listing(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-17: the first page of each folder's files by name, and how many there are; files are counted before, so a large folder isn't ordered whole."""
    f = pages(spark, sf).filter(F.col("url").contains("/")).select("page_id", F.regexp_extract("url", "^(.*/)", 1).alias("folder"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    totals = f.groupBy("folder").agg(F.count("*").alias("total"))
    first = f.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("name", "page_id"))).filter(F.col("place") <= _LISTING)
    return first.join(totals, "folder").select("folder", "place", "name", "page_id", "total")


@operator(
    "adapter_search",
    f"WITH {CHUNKS_SQL}, hits AS ({bm25_sql('chunks', ['ation', 'the'], ['chunk'], 'node_id, seq')}), best AS (SELECT node_id, max(relevance) AS relevance FROM hits GROUP BY node_id) SELECT CAST(row_number() OVER (ORDER BY relevance DESC, node_id) AS INTEGER) AS rank, node_id FROM best QUALIFY rank <= 10",
)
def adapter_search(spark: SparkSession, sf: str) -> DataFrame:
    """REM-34: distinct nodes in the order of their best chunk, the first ten."""
    hits = ranked(text_index(spark, sf), ["ation", "the"], pieces=CHUNK_PIECES)
    best = top(best_per(hits, "key", F.desc("relevance"), F.col("piece")), 10, F.desc("relevance"), F.col("key"))
    order = Window.orderBy(F.desc("relevance"), "key")  # ten rows
    return best.select(F.row_number().over(order).alias("rank"), F.col("key").alias("node_id"))


@operator(
    "token_log_round_trip",
    f"WITH {EVENTS_SQL} SELECT source, count(*) AS calls, sum(user_id) AS tokens_in, sum(event_id) AS tokens_out, sum(user_id + event_id) AS tokens FROM ev GROUP BY source",
)
def token_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """REM-40, SRC-19, AGG-12: calls written as lines of the token log, read back by key and value."""
    at = f"{shared_folder(spark)}/loredeck-tokens-{uuid.uuid4().hex}"
    number = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string")).alias(name)
    e = events(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")
    write_log(e.select(stamp, "source", number("in", F.col("user_id")), number("out", F.col("event_id")), number("total", F.col("user_id") + F.col("event_id"))), at)
    fields = F.split("value", r" \| ")
    pairs = F.map_from_entries(F.transform(F.slice(fields, 3, 3), lambda f: F.struct(F.split_part(f, F.lit("="), F.lit(1)), F.split_part(f, F.lit("="), F.lit(2)).cast("long"))))
    read_back = spark.read.text(at).select(F.get(fields, F.lit(1)).alias("source"), pairs.alias("n"))
    return read_back.groupBy("source").agg(F.count("*").alias("calls"), F.sum("n.in").alias("tokens_in"), F.sum("n.out").alias("tokens_out"), F.sum("n.total").alias("tokens"))


MISS_LINE = r"^([^|]*) \| ([A-Z_]+) \| user=(.*?)\((\d*)\) \| page=(.*) \(id=(\d+)\) \| question=(.*) \| stages=(.*)$"


@operator(
    "miss_log_round_trip",
    "SELECT CASE WHEN length(text) < 60 THEN 'CACHE_MISS' ELSE 'ALL_MISS' END AS level, concat(role, conv_id % 3) AS user, count(*) AS misses, sum(conv_id) AS pages, sum(length(text)) AS chars FROM conversations WHERE text <> '' GROUP BY ALL",
)
def miss_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """REM-40, SRC-16: answer misses written as lines of their log and read back; no question can end its field or line."""
    at = f"{shared_folder(spark)}/loredeck-misses-{uuid.uuid4().hex}"
    c = read(spark, sf, "conversations").filter("text <> ''")
    level = F.when(F.length("text") < 60, "CACHE_MISS").otherwise("ALL_MISS")
    user = F.format_string("user=%s%d(%d)", "role", F.col("conv_id") % 3, "turn")
    page = F.format_string("page=page %d (id=%d)", "turn", "conv_id")
    write_log(c.select(F.lit("2024-01-01 00:00:00").alias("at"), level.alias("level"), user.alias("user"), page.alias("page"), F.concat(F.lit("question="), "text").alias("question"), F.lit("stages=1>2").alias("stages")), at)
    part = lambda k: F.regexp_extract("value", MISS_LINE, k)
    m = spark.read.text(at).select(part(2).alias("level"), part(3).alias("user"), part(6).cast("long").alias("page"), F.length(part(7)).alias("chars"))
    return m.groupBy("level", "user").agg(F.count("*").alias("misses"), F.sum("page").alias("pages"), F.sum("chars").alias("chars"))
