"""Tables of a knowledge base over the given Parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.sources.index import Pieces, StoredIndex
from loredeck.sources.shared import shared_folder

#: Folder role of a document by its language (fixed values).
ROLES = {"en": "planning", "de": "qa_result", "fr": "live_issue", "es": "game_data"}
#: Result of a response event, and outcome of a cache event, by event type (fixed values).
OUTCOMES = {"view": "hit", "click": "miss", "signup": "fallback"}
RESULTS = {"purchase": "success", "error": "fail", "signup": "partial"}

NODES_SQL = """nodes AS (SELECT doc_id AS node_id, left(text, 40) AS title, text AS body, source AS space_key, lang,
  CASE lang WHEN 'en' THEN 'planning' WHEN 'de' THEN 'qa_result' WHEN 'fr' THEN 'live_issue' ELSE 'game_data' END AS folder_role FROM documents)"""
CHUNK_SIZE, CHUNK_STEP, CHUNK_LEAST = 800, 700, 50
CHUNKS_SQL = f"""chunks AS (SELECT * FROM (SELECT doc_id AS node_id, seq, substr(text, CAST(1 + {CHUNK_STEP} * seq AS BIGINT), {CHUNK_SIZE}) AS chunk, lang, source FROM (
  SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 100) / {CHUNK_STEP}.0) AS BIGINT), 1))) AS seq FROM documents)) WHERE length(chunk) >= {CHUNK_LEAST})"""


#: The same cuts, of the index's places.
CHUNK_PIECES = Pieces("body", CHUNK_SIZE, CHUNK_STEP, CHUNK_LEAST)
_INDEXES: dict[str, StoredIndex] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes: the first 40 characters are the title."""
    role = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in ROLES.items() if k != "es"), F.lit("game_data"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.col("source").alias("space_key"), "lang", role.alias("folder_role"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into overlapping chunks; short remains are dropped."""
    # pieces of one step, each with the beginning of the next; the text itself goes no further
    pieces, size = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % CHUNK_STEP), F.lit(0)), F.length("text")
    last = F.greatest(F.ceil((size - 100) / F.lit(CHUNK_STEP)), F.lit(1)) - 1
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), "lang", "source", pieces.alias("pieces"), last.cast("int").alias("last"))
    piece = lambda i: F.coalesce(F.get("pieces", i), F.lit(""))
    cut = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.concat(piece(i), F.substring(piece(i + 1), 1, CHUNK_SIZE - CHUNK_STEP)))
    out = d.select("node_id", F.posexplode(cut).alias("seq", "chunk"), "lang", "source")
    return out.select("node_id", F.col("seq").cast("long").alias("seq"), "chunk", "lang", "source").filter(F.length("chunk") >= CHUNK_LEAST)


def text_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The index of titles and bodies of nodes; built by the first search of an application, kept in the shared folder."""
    name = f"{shared_folder(spark)}/loredeck-index/{spark.sparkContext.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    if name not in _INDEXES:
        _INDEXES[name] = StoredIndex.build(nodes(spark, sf_dir), "node_id", ["title", "body"], name)
    return _INDEXES[name]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues, with the customer as assignee and the market segment as project."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("issue_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("updated"), F.col("c_name").alias("assignee"), F.col("c_mktsegment").alias("project"), F.col("o_totalprice").alias("price"))


ISSUES_SQL = """issues AS (SELECT o_orderkey AS issue_key, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS updated, c_name AS assignee, c_mktsegment AS project, o_totalprice AS price
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the day and the source they are counted under."""
    return read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string")).withColumn("source", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))


EVENTS_SQL = "ev AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, concat('s', CAST(user_id % 3 AS VARCHAR)) AS source FROM events)"


def by_type(mapping: dict[str, str], other: str | None = None):
    """A column of the mapped event type."""
    out = F.lit(other)
    for k, v in mapping.items():
        out = F.when(F.col("event_type") == k, F.lit(v)).otherwise(out)
    return out


def by_type_sql(mapping: dict[str, str], other: str | None = None) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + (f" ELSE '{other}'" if other else "") + " END"
