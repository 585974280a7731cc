"""What is lost between a text and what is stored of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.operators.losses import ALLOWED, LEAST, line_differences, lines_of, losses, with_origin
from loredeck.registry import operator
from loredeck.sources.tables import CHUNKS_SQL, chunks, read

_LINES = rf"unnest(list_filter(list_transform(string_split({{c}}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= {LEAST}))"
_DIFFERENCES = f"""{CHUNKS_SQL}, a AS (SELECT doc_id AS node_id, {_LINES.format(c='text')} AS line FROM documents), b AS (SELECT node_id, {_LINES.format(c='chunk')} AS line FROM chunks),
  d AS (SELECT node_id, line, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL),
  lost AS (SELECT node_id, line, n AS lost, EXISTS (SELECT 1 FROM d e WHERE e.node_id = d.node_id AND e.n < 0 AND starts_with(d.line, e.line)) AS cut FROM d WHERE n > 0)"""


def two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, and of their chunks."""
    reference = read(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), lines_of(F.col("text")).alias("lines"))
    return reference, chunks(spark, sf).select("node_id", lines_of(F.col("chunk")).alias("lines"))


@operator("lost_lines", f"WITH {_DIFFERENCES} SELECT node_id, line, lost, cut FROM lost")
def lost_lines(spark: SparkSession, sf: str) -> DataFrame:
    """REM-36: lines of documents that no chunk has whole, how often, and whether a chunk ends within them."""
    return with_origin(line_differences(*two(spark, sf), "node_id"), "node_id")


@operator(
    "parse_losses",
    f"""WITH {_DIFFERENCES}, l AS (SELECT node_id, sum(lost) AS lost, sum(CASE WHEN cut THEN lost ELSE 0 END) AS cut FROM lost GROUP BY node_id), x AS (SELECT node_id, -sum(n) AS extra FROM d WHERE n < 0 GROUP BY node_id), s AS (SELECT node_id, count(*) AS lines FROM a GROUP BY node_id),
  t AS (SELECT doc_id AS node_id, coalesce(lines, 0) AS lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost, CAST(coalesce(cut, 0) AS BIGINT) AS cut, CAST(coalesce(extra, 0) AS BIGINT) AS extra FROM documents LEFT JOIN s ON s.node_id = doc_id LEFT JOIN l ON l.node_id = doc_id LEFT JOIN x ON x.node_id = doc_id),
  u AS (SELECT *, CASE WHEN lines > 0 THEN round((lost - cut) / lines, 6) ELSE 0.0 END AS loss FROM t)
SELECT *, CASE WHEN loss > {ALLOWED} THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM u""",
)
def parse_losses(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-12/13, REM-37: lines each document loses as chunks, cut ones aside, and whether that blocks."""
    return losses(*two(spark, sf), "node_id")
