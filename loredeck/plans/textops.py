"""Text preparation: markup, sentences, keywords, chunks, entities, labels, export guards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.functions import markup
from loredeck.functions.batches import parts
from loredeck.functions.chunker import chunked
from loredeck.functions.text import STRIP_HTML_SQL, content_hash, guarded_csv, log_field, strip_html
from loredeck.operators.ranking import top
from loredeck.registry import operator
from loredeck.sources.tables import CHUNKS_SQL, chunks, pages, read

#: Markup that a task converts at once.
MARKUP_BYTES = 1 << 20


@operator("strip_html_regex", f"SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, {STRIP_HTML_SQL} AS t FROM pages)")
def strip_html_regex(spark: SparkSession, sf: str) -> DataFrame:
    """STR-01: markup to text by patterns."""
    t = pages(spark, sf).select("page_id", strip_html("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@operator("html_to_markdown")
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """STR-02, SRC-30: markup to Markdown by its structure."""

    @F.arrow_udf("string")
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for html in parts(batch, MARKUP_BYTES):
                yield pa.array([markup.to_markdown(h) for h in html.fill_null("").to_pylist()], pa.string())
            pa.default_memory_pool().release_unused()  # workers live on for other tasks

    return pages(spark, sf).select("page_id", convert("html").alias("markdown"))


@operator("first_sentences", r"SELECT doc_id, left(array_to_string(list_filter(regexp_extract_all(text, '[^.?!\s][^.?!]*[.?!]'), lambda x: length(trim(x)) > 0)[1:3], ' '), 300) AS summary FROM documents")
def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """STR-05/07/11: the first three sentences, cut at 300 characters."""
    s = F.filter(F.regexp_extract_all("text", F.lit(r"[^.?!\s][^.?!]*[.?!]"), F.lit(0)), lambda x: F.length(F.trim(x)) > 0)
    return read(spark, sf, "documents").select("doc_id", F.substring(F.array_join(F.slice(s, 1, 3), " "), 1, 300).alias("summary"))


@operator("freq_keywords_top8", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(left(text, 5000)), '[a-z]{3,}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ('the', 'and', 'for', 'with', 'that', 'der', 'die', 'das', 'und', 'les', 'des', 'que', 'los', 'las') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rn FROM c) SELECT doc_id, word, CAST(n AS BIGINT) AS n, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 8")
def freq_keywords_top8(spark: SparkSession, sf: str) -> DataFrame:
    """STR-06/08/17, AGG-27: frequent words of a text."""
    stop = ["the", "and", "for", "with", "that", "der", "die", "das", "und", "les", "des", "que", "los", "las"]
    w = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.substring("text", 1, 5000)), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).filter(~F.col("word").isin(stop))
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))).filter("rn <= 8")


@operator("content_hash", "SELECT doc_id, left(sha256(text), 16) AS hash, length(text) > 5000 AS truncated, least(length(text), 5000) AS kept FROM documents WHERE text <> ''")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """STR-10/11, SNK-03/05: content hash and truncation flag."""
    n = F.length("text").cast("long")
    return read(spark, sf, "documents").filter("text <> ''").select("doc_id", content_hash("text").alias("hash"), (n > 5000).alias("truncated"), F.least(n, F.lit(5000).cast("long")).alias("kept"))


@operator("sliding_chunks", f"WITH {CHUNKS_SQL} SELECT node_id, CAST(seq AS BIGINT) AS seq, length(chunk) AS chars, md5(chunk) AS digest FROM chunks")
def sliding_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """STR-42, WIN-05, SNK-11: overlapping chunks in order."""
    return chunks(spark, sf).select("node_id", "seq", F.length("chunk").cast("long").alias("chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


@operator("chunk_stats", f"WITH {CHUNKS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT node_id) AS BIGINT) AS nodes, round(avg(length(chunk)), 2) AS mean_chars, CAST(max(seq) AS BIGINT) AS last_seq FROM chunks GROUP BY source")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-03: chunks and distinct nodes."""
    return chunks(spark, sf).groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("node_id").alias("nodes"), F.round(F.avg(F.length("chunk")), 2).alias("mean_chars"), F.max("seq").alias("last_seq"))


_TRIM = "trim({}, concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11)))"
_HELD = "CASE WHEN s.held <> '' THEN list_append(s.out, s.held) ELSE s.out END"
SEMANTIC_SQL = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(string_split({_TRIM.format('text')}, concat(chr(10), chr(9))),
    lambda x: string_split({_TRIM.format('x')}, concat(chr(10), chr(10))))), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS parts FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(parts, lambda x: {{'held': x, 'size': length(x), 'out': []::VARCHAR[]}}), lambda s, x: CASE
    WHEN x.size > 800 THEN {{'held': '', 'size': 0, 'out': list_append({_HELD}, x.held)}}
    WHEN s.size + x.size + 2 > 800 AND s.held <> '' THEN {{'held': x.held, 'size': x.size, 'out': {_HELD}}}
    ELSE {{'held': CASE WHEN s.held <> '' THEN concat(s.held, chr(10), chr(10), x.held) ELSE x.held END, 'size': s.size + x.size + 2, 'out': s.out}} END,
  {{'held': '', 'size': 0::BIGINT, 'out': []::VARCHAR[]}}) AS s FROM p),
g AS (SELECT doc_id, unnest({_HELD}) AS part, unnest(range(len({_HELD}))) AS n FROM f),
w AS (SELECT doc_id, n, CASE WHEN length(part) <= 800 THEN 'preamble' ELSE 'sliding' END AS origin, k,
  CASE WHEN length(part) <= 800 THEN part ELSE substr(part, CAST(1 + 700 * k AS BIGINT), 800) END AS chunk
  FROM (SELECT *, unnest(range(CASE WHEN length(part) <= 800 THEN 1 ELSE 1 + CAST(ceil((length(part) - 800) / 700.0) AS BIGINT) END)) AS k FROM g))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS seq, chunk, origin FROM w WHERE length(chunk) >= 50"""


@operator("semantic_chunks", SEMANTIC_SQL)
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-15, REM-04..06, STR-42: chunks of whole documents by sheets, tables, paragraphs and windows, one row function in the JVM.

    The SQL has the rules for text without sheets, tables and markers, as the documents are; `tests/test_chunker.py` has all.
    """
    found = read(spark, sf, "documents").select("doc_id", F.posexplode(chunked(F.col("text"))).alias("seq", "c"))
    return found.select("doc_id", "seq", "c.chunk", "c.origin")


_HEAD = "| order | day | priority |\n|---|---|---|"


@operator(
    "sheet_chunks",
    f"""WITH r AS (SELECT c_custkey, any_value(c_name) AS name, list(concat('| ', o_orderkey, ' | ', strftime(o_orderdate, '%Y-%m-%d'), ' | ', o_orderpriority, ' |') ORDER BY o_orderkey) AS rows
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey),
f AS (SELECT c_custkey, name, list_reduce(list_transform(rows, lambda x: {{'held': x, 'size': length(x) + 1, 'out': []::VARCHAR[]}}), lambda s, x:
    CASE WHEN {len(_HEAD) + 1} + s.size + x.size > 800 AND s.size > 0 THEN {{'held': x.held, 'size': x.size, 'out': list_append(s.out, s.held)}}
    ELSE {{'held': CASE WHEN s.size > 0 THEN concat(s.held, chr(10), x.held) ELSE x.held END, 'size': s.size + x.size, 'out': s.out}} END, {{'held': '', 'size': 0::BIGINT, 'out': []::VARCHAR[]}}) AS s FROM r),
g AS (SELECT c_custkey, name, unnest(list_append(s.out, s.held)) AS part, unnest(range(len(s.out) + 1)) AS seq FROM f)
SELECT c_custkey, seq, concat('Sheet:', name) AS section, 'table' AS origin,
  concat(CASE WHEN seq = 0 THEN concat('## Sheet:', name, chr(10)) ELSE '' END, '| order | day | priority |', chr(10), '|---|---|---|', chr(10), part) AS chunk FROM g""",
)
def sheet_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """STR-42, WIN-15, REM-06: each customer's orders as a sheet with one table; its chunks repeat the table's heading."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer").select("c_custkey", "c_name")
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), "o_orderpriority", F.lit(" |"))
    rows = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("rows"))
    sheet = F.concat(F.lit("## Sheet: "), "c_name", F.lit(f"\n{_HEAD}\n"), F.array_join("rows.row", "\n"))
    found = rows.join(c, "c_custkey").select("c_custkey", F.posexplode(chunked(sheet)).alias("seq", "c"))
    return found.select("c_custkey", "seq", "c.section", "c.origin", "c.chunk")


@operator("entity_extract", r"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS value, 'mail' AS kind FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\d{4}-\d{2}-\d{2}')), 'date' FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{2,10}-\d{1,6}')), 'issue' FROM documents) SELECT doc_id, kind, value, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    """STR-16: entities of each kind, once a document, with their count."""
    kinds = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "date": r"\d{4}-\d{2}-\d{2}", "issue": r"[A-Z]{2,10}-\d{1,6}"}

    def each(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.concat(*(each(k, p) for k, p in kinds.items()))
    return read(spark, sf, "documents").select("doc_id", F.explode(found).alias("e")).groupBy("doc_id", "e.kind", "e.value").agg(F.count("*").alias("n"))


#: Aliases, longest first (fixed values of this query).
ALIASES = [("with the", "w/t"), ("of the", "o/t"), ("and the", "a/t"), ("for", "4")]


@operator("alias_rewrite", "SELECT conv_id, turn, " + "".join("replace(" for _ in ALIASES) + "lower(text)" + "".join(f", '{a}', '{b}')" for a, b in ALIASES) + " AS rewritten FROM conversations")
def alias_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """STR-13/14, JOIN-11: aliases rewritten, the longest first."""
    c = F.lower("text")
    for a, b in ALIASES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return read(spark, sf, "conversations").select("conv_id", "turn", c.alias("rewritten"))


@operator("path_labels", r"SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'planning' WHEN regexp_matches(url, '/de/') THEN 'qa_result' WHEN regexp_matches(url, '/fr/') THEN 'live_issue' ELSE 'unknown' END AS role, CASE WHEN regexp_matches(url, '\.html') THEN 'page' WHEN regexp_matches(url, '/$') THEN 'folder' WHEN regexp_matches(url, '[?#]') THEN 'view' ELSE 'other' END AS kind, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', 1) AS alias FROM pages")
def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    """STR-15/23, SNK-13, FLT-17: role, kind and alias from the path."""
    u = F.col("url")
    role = F.when(u.rlike("/en/"), "planning").when(u.rlike("/de/"), "qa_result").when(u.rlike("/fr/"), "live_issue").otherwise("unknown")
    kind = F.when(u.rlike(r"\.html"), "page").when(u.rlike("/$"), "folder").when(u.rlike("[?#]"), "view").otherwise("other")
    return pages(spark, sf).select("page_id", role.alias("role"), kind.alias("kind"), F.split_part(F.regexp_extract(u, "://([^/?#]*)", 1), F.lit("."), F.lit(1)).alias("alias"))


@operator("normalize_dates", r"SELECT o_orderkey, concat(s[1], lpad(s[2], 2, '0'), lpad(s[3], 2, '0')) AS compact FROM (SELECT o_orderkey, str_split(CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y/%-m/%-d') ELSE strftime(o_orderdate, '%Y.%m.%d') END, CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '.' END) AS s FROM orders)")
def normalize_dates(spark: SparkSession, sf: str) -> DataFrame:
    """DT-04: spellings of a date as eight digits."""
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    part = lambda i: F.regexp_extract(written, r"(?<!\d)(20\d\d|19\d\d)[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", i)
    return read(spark, sf, "orders").select("o_orderkey", F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).alias("compact"))


@operator("csv_guard", "SELECT page_id, CASE WHEN left(x, 1) IN ('=', '+', '-', '@') THEN concat('''', x) ELSE x END AS field FROM (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' ELSE '' END, url) AS x FROM pages)")
def csv_guard(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-18: fields that a spreadsheet would run are quoted."""
    first = F.element_at(F.array(F.lit("="), F.lit("+"), F.lit("@"), F.lit(""), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    return pages(spark, sf).select("page_id", guarded_csv(F.concat(first, F.col("url"))).alias("field"))


@operator("log_sanitize", "SELECT doc_id, replace(replace(replace(text, '|', '｜'), chr(10), ' '), chr(13), ' ') AS field FROM documents")
def log_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-23: a field that can't end a log field or line."""
    return read(spark, sf, "documents").select("doc_id", log_field(F.col("text")).alias("field"))


@operator("header_dedupe_suffix", "SELECT conv_id, turn, CASE WHEN rn = 1 THEN role ELSE concat(role, '_', rn) END AS header FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations)")
def header_dedupe_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-06: repeated headers get numbers."""
    rn = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return read(spark, sf, "conversations").withColumn("rn", rn).select("conv_id", "turn", F.when(F.col("rn") == 1, F.col("role")).otherwise(F.concat_ws("_", "role", F.col("rn").cast("string"))).alias("header"))


@operator("fill_down", "SELECT l_orderkey, l_linenumber, last_value(flag IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS category, l_partkey FROM (SELECT *, CASE WHEN l_quantity > 30 THEN l_returnflag END AS flag FROM lineitem)")
def fill_down(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-07: a blank cell takes the last one above it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf, "lineitem").withColumn("flag", F.when(F.col("l_quantity") > 30, F.col("l_returnflag"))).select("l_orderkey", "l_linenumber", F.last("flag", ignorenulls=True).over(w).alias("category"), "l_partkey")


@operator("xml_and_cell_escape", r"SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS xml, CASE WHEN length(text) > 80 THEN concat(left(replace(replace(text, '|', '\|'), chr(10), ' '), 79), '…') ELSE replace(replace(text, '|', '\|'), chr(10), ' ') END AS cell FROM documents")
def xml_and_cell_escape(spark: SparkSession, sf: str) -> DataFrame:
    """STR-28/29/30: text for XML and for a table cell."""
    x = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    cell = F.replace(F.replace(F.col("text"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return read(spark, sf, "documents").select("doc_id", x.alias("xml"), F.when(F.length("text") > 80, F.concat(F.substring(cell, 1, 79), F.lit("…"))).otherwise(cell).alias("cell"))


@operator("key_value_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('k: ', json_extract_string(props, '$.k')) AS line FROM events WHERE event_type = 'view'")
def key_value_parse(spark: SparkSession, sf: str) -> DataFrame:
    """STR-31, JSN-01, ARR-01/02: nested values, a null for what can't be read."""
    m = F.from_json("props", "map<string,long>")
    return read(spark, sf, "events").filter("event_type = 'view'").select("event_id", m["k"].alias("k"), F.concat(F.lit("k: "), m["k"].cast("string")).alias("line"))


@operator("context_budget_prefix", "SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(max(total) AS BIGINT) AS chars FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents) WHERE total <= 20000 GROUP BY source")
def context_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-12/13, STR-39: the longest prefix within a budget of characters."""
    d = read(spark, sf, "documents").select("source", "doc_id", "n_chars", F.floor(F.col("doc_id") / 512).alias("range"))
    # whole ranges of ids first; only those that begin within the budget are looked at row by row
    ranges = d.groupBy("source", "range").agg(F.sum("n_chars").alias("chars"))
    before = F.sum("chars").over(Window.partitionBy("source").orderBy("range")) - F.col("chars")
    ranges = ranges.withColumn("before", before).filter("before <= 20000").select("source", "range")
    total = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    return d.join(ranges, ["source", "range"]).withColumn("total", total).filter("total <= 20000").groupBy("source").agg(F.count("*").alias("docs"), F.max("total").alias("chars"))


@operator("answer_rendering", "SELECT source, string_agg(concat('- ', left(text, 30)), chr(10) ORDER BY doc_id) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5 GROUP BY source")
def answer_rendering(spark: SparkSession, sf: str) -> DataFrame:
    """STR-35/36, REM-19/20, WIN-14: the first five hits of each group as a list."""
    d = read(spark, sf, "documents").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("rn <= 5")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 30).alias("s")))), lambda x: F.concat(F.lit("- "), x["s"]))
    return d.groupBy("source").agg(F.array_join(lines, "\n").alias("answer"))


@operator("deterministic_sample", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h LIMIT 20")
def deterministic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-14: a sample that any layout gives."""
    return top(read(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")), 20, F.col("h"))


@operator("typo_ratio")
def typo_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """STR-24: part names nearly equal to another of the same brand, by the ratio of matching blocks; the best ratio of each part."""
    return nearly_equal(read(spark, sf, "part")).select("p_partkey", "ratio")


def nearly_equal(parts: DataFrame, least: float = 0.6, salts: int = 16) -> DataFrame:
    """Parts with the best ratio, of at least `least`, of their name to another name of the brand.

    Each distinct name of a brand meets every other whose length allows the ratio; a brand's names are dealt over `salts` tasks.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([markup.ratio(x, y) for x, y in zip(a, b)], dtype=float)

    names = parts.filter("p_name is not null").select("p_brand", "p_name").distinct()
    left = names.withColumn("salt", F.pmod(F.xxhash64("p_name"), F.lit(salts)))
    right = names.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("to"))
    n, m = F.length("p_name"), F.length("other")
    pairs = left.join(right, F.col("p_brand").eqNullSafe(F.col("brand")) & (F.col("salt") == F.col("to")) & (F.col("p_name") != F.col("other")) & (2 * F.least(n, m) >= (n + m) * F.lit(least - 1e-9)))
    best = pairs.select("brand", F.col("p_name").alias("name"), ratio("p_name", "other").alias("ratio")).filter(F.col("ratio") >= least).groupBy("brand", "name").agg(F.max("ratio").alias("ratio"))
    return parts.join(best, F.col("p_brand").eqNullSafe(F.col("brand")) & (F.col("p_name") == F.col("name"))).drop("brand", "name")
