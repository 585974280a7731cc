"""Audits, batches, states from logs, and the shaping of chunks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.operators.places import placed
from loredeck.operators.measures import percent
from loredeck.plans.issues import fixed, values
from loredeck.registry import operator
from loredeck.sources.tables import CHUNKS_SQL, EVENTS_SQL, NODES_SQL, chunks, events, nodes, read


@operator(
    "intent_distribution",
    f"WITH {EVENTS_SQL}, g AS (SELECT source AS domain, event_type AS request_type, count(*) AS n, count(*) FILTER (value > 80) AS failed FROM ev GROUP BY ALL) SELECT domain, request_type, n, round(100.0 * failed / n, 1) AS fail_pct FROM g",
)
def intent_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-20: requests by domain and type, and the share that failed."""
    g = events(spark, sf).groupBy(F.col("source").alias("domain"), F.col("event_type").alias("request_type")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 80).alias("failed"))
    return g.select("domain", "request_type", "n", percent(F.col("failed"), F.col("n"), 1).alias("fail_pct"))


_BODY = "CASE WHEN body IS NULL THEN 'null' WHEN body = '' THEN 'empty' WHEN length(body) < 100 THEN 'short' ELSE 'ok' END"


@operator("body_status_by_space", f"WITH {NODES_SQL} SELECT space_key, count(*) FILTER (s = 'null') AS none, count(*) FILTER (s = 'empty') AS empty, count(*) FILTER (s = 'short') AS short, count(*) FILTER (s = 'ok') AS ok FROM (SELECT space_key, {_BODY} AS s FROM nodes) GROUP BY space_key")
def body_status_by_space(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-24/25: bodies that are null, empty, short or well, by space."""
    status = F.when(F.col("body").isNull(), "null").when(F.col("body") == "", "empty").when(F.length("body") < 100, "short").otherwise("ok")
    n = nodes(spark, sf).select("space_key", status.alias("s"))
    return n.groupBy("space_key").agg(*(F.count_if(F.col("s") == s).alias(c) for s, c in (("null", "none"), ("empty", "empty"), ("short", "short"), ("ok", "ok"))))


def pure_text(c: Column) -> Column:
    """STR-27: text without table rules, list marks and blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[|\-]{2,}", ""), "(?m)^- ", ""), r"\s+", "")


_PURE = r"regexp_replace(regexp_replace(regexp_replace({c}, '[|\-]{{2,}}', '', 'g'), '(?m)^- ', '', 'g'), '\s+', '', 'g')"


@operator(
    "parser_compare",
    rf"""WITH {NODES_SQL}, two AS (SELECT node_id, space_key, body AS old, CASE node_id % 5 WHEN 0 THEN body WHEN 1 THEN concat('- ', replace(body, ' ', '  ')) WHEN 2 THEN left(body, CAST(length(body) // 2 AS BIGINT)) WHEN 3 THEN concat(body, ' more') ELSE '' END AS new FROM nodes WHERE body <> ''),
p AS (SELECT space_key, old, new, {_PURE.format(c='old')} AS a, {_PURE.format(c='new')} AS b FROM two)
SELECT space_key, CASE WHEN old = new THEN 'same' WHEN a = b THEN 'layout' WHEN b = '' THEN 'lost' WHEN contains(a, b) THEN 'shorter' WHEN contains(b, a) THEN 'longer' ELSE 'other' END AS category, count(*) AS n FROM p GROUP BY ALL""",
)
def parser_compare(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-28, EVL-13, REM-36/37: two parsings of a text by what sets them apart."""
    n = nodes(spark, sf).filter("body <> ''")
    kind = F.col("node_id") % 5
    new = F.when(kind == 0, F.col("body")).when(kind == 1, F.concat(F.lit("- "), F.replace("body", F.lit(" "), F.lit("  "))))
    new = new.when(kind == 2, F.expr("left(body, cast(length(body) div 2 as int))")).when(kind == 3, F.concat("body", F.lit(" more"))).otherwise("")
    p = n.select("space_key", F.col("body").alias("old"), new.alias("new")).withColumns({"a": pure_text(F.col("old")), "b": pure_text(F.col("new"))})
    a, b = F.col("a"), F.col("b")
    category = F.when(F.col("old") == F.col("new"), "same").when(a == b, "layout").when(b == "", "lost").when(a.contains(b), "shorter").when(b.contains(a), "longer").otherwise("other")
    return p.groupBy("space_key", category.alias("category")).agg(F.count("*").alias("n"))


@operator("source_counters", f"WITH {NODES_SQL} SELECT source, count(*) AS items FROM (SELECT space_key AS source FROM nodes UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT role FROM conversations) GROUP BY source")
def source_counters(spark: SparkSession, sf: str) -> DataFrame:
    """SET-07: counters of the sources of several tables."""
    u = nodes(spark, sf).select(F.col("space_key").alias("source")).unionAll(read(spark, sf, "benchmark").select(F.lit("benchmark"))).unionAll(read(spark, sf, "conversations").select("role"))
    return u.groupBy("source").agg(F.count("*").alias("items"))


@operator("ghost_index", f"WITH {NODES_SQL} SELECT doc_id AS node_id, toxic FROM labels WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node_id = doc_id AND node_id % 4 <> 1)")
def ghost_index(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-26: index rows without a node."""
    held = nodes(spark, sf).filter("node_id % 4 <> 1").select(F.col("node_id").alias("doc_id"))
    return read(spark, sf, "labels").join(held, "doc_id", "left_anti").select(F.col("doc_id").alias("node_id"), "toxic")


@operator(
    "keyset_batches",
    """WITH t AS (SELECT d.doc_id, row_number() OVER (ORDER BY d.doc_id) - 1 AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id > 40 AND (l.quality IS NULL OR l.toxic IS NULL))
SELECT n // 64 AS batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS rows FROM t GROUP BY 1""",
)
def keyset_batches(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-05, REM-02, STM-13: documents that lack a label, after the last one done, as the pages of `id > last LIMIT 64` come: all of 64 rows but the last."""
    labels = read(spark, sf, "labels").filter("quality is not null and toxic is not null")
    lacking = read(spark, sf, "documents").filter("doc_id > 40").select("doc_id").join(labels, "doc_id", "left_anti")
    pages_ = placed(lacking, ["doc_id"]).withColumn("batch", F.floor((F.col("place") - 1) / 64))
    return pages_.groupBy("batch").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))


@operator(
    "backfill_status",
    f"WITH {NODES_SQL}, f AS (SELECT node_id, CASE WHEN node_id % 11 = 0 THEN '../up' WHEN node_id % 7 = 0 THEN 'Dir/File.DOC' ELSE 'dir/file.txt' END AS path, body FROM nodes) SELECT CASE WHEN contains(path, '..') THEN 'refused' WHEN lower(path) <> path THEN 'other_case' WHEN body IS NULL THEN 'missing' WHEN body = '' THEN 'empty' WHEN length(body) < 100 THEN 'short' ELSE 'filled' END AS status, count(*) AS n FROM f GROUP BY 1",
)
def backfill_status(spark: SparkSession, sf: str) -> DataFrame:
    """REM-11: what became of each file that was to be read again; paths that lead out of the tree are refused."""
    path = F.when(F.col("node_id") % 11 == 0, "../up").when(F.col("node_id") % 7 == 0, "Dir/File.DOC").otherwise("dir/file.txt")
    f = nodes(spark, sf).select(path.alias("path"), "body")
    status = F.when(F.col("path").contains(".."), "refused").when(F.lower("path") != F.col("path"), "other_case").when(F.col("body").isNull(), "missing")
    status = status.when(F.col("body") == "", "empty").when(F.length("body") < 100, "short").otherwise("filled")
    return f.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@operator("last_state", f"WITH {EVENTS_SQL} SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS value FROM ev WHERE event_type IN ('click', 'view') GROUP BY user_id")
def last_state(spark: SparkSession, sf: str) -> DataFrame:
    """REM-26/27: of each key the state that its last log row gives."""
    e, last = events(spark, sf).filter(F.col("event_type").isin("click", "view")), F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", last).alias("state"), F.max_by("value", last).alias("value"))


@operator("newest_match", f"WITH {EVENTS_SQL}, t AS (SELECT max(ts) AS now FROM ev) SELECT source, arg_max(event_id, (ts, event_id)) AS event_id, true AS any_hit FROM ev, t WHERE event_type = 'purchase' AND ts > now - INTERVAL 7 DAY GROUP BY source")
def newest_match(spark: SparkSession, sf: str) -> DataFrame:
    """REM-30/33: the newest matching row within seven days of the last one."""
    e = events(spark, sf)
    now = e.agg(F.max("ts").alias("now"))
    hit = e.filter("event_type = 'purchase'").join(F.broadcast(now)).filter(F.col("ts") > F.col("now") - F.expr("interval 7 days"))
    return hit.groupBy("source").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.lit(True).alias("any_hit"))


@operator(
    "cache_against_remote",
    f"WITH {EVENTS_SQL}, m AS (SELECT source, avg(value) FILTER (event_type = 'view') AS cached, avg(value) FILTER (event_type = 'purchase') AS remote FROM ev GROUP BY source) SELECT source, round(remote - cached, 2) AS saved, round(CASE WHEN remote > 0 THEN cached / remote ELSE 0 END, 3) AS ratio, concat('source=', source, ' rows=', (SELECT count(*) FROM ev WHERE ev.source = m.source)) AS line FROM m",
)
def cache_against_remote(spark: SparkSession, sf: str) -> DataFrame:
    """REM-39/40: what the cache saves against the remote source, and a key=value line of each."""
    kind = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    m = events(spark, sf).groupBy("source").agg(F.avg(kind("view")).alias("cached"), F.avg(kind("purchase")).alias("remote"), F.count("*").alias("rows"))
    ratio = F.when(F.col("remote") > 0, F.col("cached") / F.col("remote")).otherwise(0.0)
    return m.select("source", F.round(F.col("remote") - F.col("cached"), 2).alias("saved"), F.round(ratio, 3).alias("ratio"), F.concat(F.lit("source="), "source", F.lit(" rows="), F.col("rows").cast("string")).alias("line"))


@operator(
    "grace_passed",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS due, CASE WHEN o_orderkey % 3 = 0 THEN hour(t) >= 11 ELSE t >= o_orderdate + INTERVAL 540 MINUTE + INTERVAL 90 MINUTE END AS passed, strftime(t, '%Y-%m-%d %H:%M:%S') AS shown FROM (SELECT *, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS t FROM orders)",
)
def grace_passed(spark: SparkSession, sf: str) -> DataFrame:
    """DT-11/13: whether a schedule's time (9 o'clock) and its grace of 90 minutes have passed, missions at 11; times as shown."""
    o = read(spark, sf, "orders").withColumn("t", F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int), 0)"))
    passed = F.when(F.col("o_orderkey") % 3 == 0, F.hour("t") >= 11).otherwise(F.col("t") >= F.expr("o_orderdate + interval 630 minutes"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", iso("o_orderdate").alias("due"), passed.alias("passed"), F.replace(iso("t"), F.lit("T"), F.lit(" ")).alias("shown"))


# Losses allowed by file kind and kind of loss.
LOSSES = [("xlsx", "TABLE_LOSS", 0.01), ("xlsx", "FORMULA_LOSS", 0.05), ("xlsx", "IMAGE_LOSS", 0.01), ("xlsx", "STRUCTURE_LOSS", 0.05), ("pptx", "TABLE_LOSS", 0.01), ("pptx", "IMAGE_LOSS", 0.01), ("pptx", "STRUCTURE_LOSS", 0.05), ("tsv", "TABLE_LOSS", 0.01), ("tsv", "ENCODING_LOSS", 0.0), ("tsv", "STRUCTURE_LOSS", 0.05)]
_KINDS = "list_extract(['xlsx', 'pptx', 'tsv', 'docx'], CAST(l_partkey % 4 + 1 AS INTEGER))"
_LOSS = "list_extract(['TABLE_LOSS', 'FORMULA_LOSS', 'IMAGE_LOSS', 'STRUCTURE_LOSS', 'ENCODING_LOSS'], CAST(l_suppkey % 5 + 1 AS INTEGER))"


@operator(
    "loss_thresholds",
    f"WITH {values('x', 'kind, loss, allowed', LOSSES)}, l AS (SELECT {_KINDS} AS kind, {_LOSS} AS loss, l_discount AS share FROM lineitem) SELECT l.kind, l.loss, coalesce(allowed, 0.01)::DOUBLE AS allowed, count(*) AS n, count(*) FILTER (share > coalesce(allowed, 0.01)) AS violations FROM l LEFT JOIN x ON x.kind = l.kind AND x.loss = l.loss GROUP BY ALL",
)
def loss_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """ARR-05, EVL-12: losses against what their kind of file allows, 0.01 where nothing is said."""
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    l = read(spark, sf, "lineitem").select(pick("l_partkey", ["xlsx", "pptx", "tsv", "docx"]).alias("kind"), pick("l_suppkey", ["TABLE_LOSS", "FORMULA_LOSS", "IMAGE_LOSS", "STRUCTURE_LOSS", "ENCODING_LOSS"]).alias("loss"), F.col("l_discount").alias("share"))  # noqa: E741
    allowed = F.coalesce("allowed", F.lit(0.01))
    joined = l.join(fixed(spark, LOSSES, "kind string, loss string, allowed double").drop("k"), ["kind", "loss"], "left")
    return joined.groupBy("kind", "loss", allowed.alias("allowed")).agg(F.count("*").alias("n"), F.count_if(F.col("share") > allowed).alias("violations"))


@operator("mirror_fallback", "SELECT o_orderkey, o_orderstatus AS status, 'primary' AS served FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'mirror' FROM orders WHERE o_custkey % 2 = 1")
def mirror_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-35: rows of the primary source, and of the mirror where the primary has none."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    primary, mirror = o.filter("o_custkey % 2 = 0"), o.select("o_orderkey", "status")
    both = mirror.join(primary.select("o_orderkey", F.col("status").alias("own")), "o_orderkey", "left")
    return both.select("o_orderkey", F.coalesce("own", "status").alias("status"), F.when(F.col("own").isNotNull(), "primary").otherwise("mirror").alias("served"))


@operator("grid_summary", f"WITH {NODES_SQL}, g AS (SELECT lang, folder_role, count(*) AS n, max(node_id) AS newest FROM nodes GROUP BY ALL) SELECT lang, folder_role, n, newest, row_number() OVER (PARTITION BY lang ORDER BY n DESC, folder_role) AS place FROM g QUALIFY place <= 8")
def grid_summary(spark: SparkSession, sf: str) -> DataFrame:
    """REM-24: the most frequent kinds of each group, counted before they are ranked."""
    from pyspark.sql import Window

    g = nodes(spark, sf).groupBy("lang", "folder_role").agg(F.count("*").alias("n"), F.max("node_id").alias("newest"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "folder_role"))).filter("place <= 8")


#: Marks that a reader puts before chunks of sheets and slides, lines it puts before those of tables.
META_LINE = r"(?m)^(?:index_mode|file_type|content_type): .+\n?"
BLANKS = r"[ \t\n\r\f\x0B]+"


def clean_chunk(chunk: Column) -> Column:
    """STR-12: a chunk without lines of metadata; of what stands before a sheet's row or a slide only the sheet or the slide's number, in brackets.

    What stands before is a list of fields, "name: value", joined by " > ". A slide's tail without notes goes; nulls stay null.
    """
    bare = F.regexp_replace(chunk, META_LINE, "")
    fields = F.split(bare, " > ")
    place = lambda test: F.coalesce(F.array_position(F.transform(fields, test), True), F.lit(0)).cast("int")
    rest = lambda k: F.array_join(F.slice(fields, k + 1, F.greatest(F.size(fields) - k, F.lit(0))), " > ")
    row, kind = place(lambda f: f.startswith("Row: ")), F.get(fields, F.lit(0))
    sheets = F.filter(F.slice(fields, F.lit(1), F.greatest(row, F.lit(1))), lambda f: f.startswith("Sheet: "))
    sheet = F.coalesce(F.substring(F.element_at(F.array_append(F.array(F.lit("Sheet: ")), F.get(sheets, F.size(sheets) - 1)), -1), 8, 1 << 20), F.lit(""))
    of_sheet = F.concat(F.lit("["), sheet, F.lit("] "), rest(row))
    content = place(lambda f: f == "ContentType: generic_pptx")
    number = F.regexp_extract(F.coalesce(F.get(fields, content), F.lit("")), "^Slide: ([0-9]+)$", 1)
    of_slide = F.concat(F.lit("[Slide "), number, F.lit("] "), F.regexp_replace(rest(content + 1), r"\n?### Notes:\s*$", ""))
    is_slide = (kind == "Mode: generic_pptx") & F.get(fields, F.lit(1)).startswith("FileType: ") & (content > 2) & (number != "") & (F.size(fields) > content + 1)
    cleaned = F.when(is_slide, of_slide).when(bare.startswith("Mode: generic_xlsx") & (row > 0), of_sheet).otherwise(bare)
    return F.regexp_replace(cleaned, f"^{BLANKS}|{BLANKS}$", "")


@operator(
    "chunk_prefix_cleanup",
    f"""WITH {CHUNKS_SQL} SELECT node_id, seq, trim(concat(CASE (node_id + seq) % 5 WHEN 1 THEN concat('[', source, '] ') WHEN 2 THEN concat('[Slide ', seq, '] ') ELSE '' END, chunk), concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11))) AS chunk FROM chunks""",
)
def chunk_prefix_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """STR-12: chunks without what their reader put before them: of tables, of a sheet named by the source, of slides numbered by the chunk, or nothing."""
    kind, seq = (F.col("node_id") + F.col("seq")) % 5, F.col("seq").cast("string")
    file = F.concat(F.col("source"), F.lit("-"), F.col("node_id").cast("string"))
    lines = F.concat(F.lit("index_mode: generic_tsv\nfile_type: "), file, F.lit(".tsv\ncontent_type: generic_tsv\n"), "chunk")
    sheet = F.concat(F.lit("Mode: generic_xlsx > FileType: "), file, F.lit(".xlsx > Sheet: "), "source", F.lit(" > Row: "), seq, F.lit(" > "), "chunk")
    slide = F.concat(F.lit("Mode: generic_pptx > FileType: "), file, F.lit(".pptx > ContentType: generic_pptx > Slide: "), seq, F.lit(" > "), "chunk", F.lit("\n### Notes: "))
    text = F.when(kind == 0, lines).when(kind == 1, sheet).when(kind == 2, slide).otherwise(F.col("chunk"))
    return chunks(spark, sf).select("node_id", "seq", clean_chunk(text).alias("chunk"))


@operator(
    "search_hits",
    f"WITH {NODES_SQL} SELECT node_id, CASE WHEN folder_role = 'planning' THEN 'metadata' ELSE 'content' END AS kind, CASE WHEN folder_role = 'planning' THEN 0.0 ELSE CAST(length(body) AS DOUBLE) END AS score, CASE WHEN folder_role <> 'planning' THEN left(body, 50) END AS chunk, concat(left(coalesce(body, ''), 100), CASE WHEN length(body) > 100 THEN concat(' (', length(body) - 100, ' more)') ELSE '' END) AS shown FROM nodes",
)
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-31, STR-39/40: rows as hits; of metadata no score and no chunk; long texts cut with a note of what is left."""
    meta, size = F.col("folder_role") == "planning", F.length("body")
    more = F.when(size > 100, F.concat(F.lit(" ("), (size - 100).cast("string"), F.lit(" more)"))).otherwise("")
    shown = F.concat(F.substring(F.coalesce("body", F.lit("")), 1, 100), more)
    return nodes(spark, sf).select("node_id", F.when(meta, "metadata").otherwise("content").alias("kind"), F.when(meta, 0.0).otherwise(size.cast("double")).alias("score"), F.when(~meta, F.substring("body", 1, 50)).alias("chunk"), shown.alias("shown"))


# First words of a claim, and words of a table's header.
CLAIM_ALIASES = {"bug": "버그", "버그": "버그", "ui": "UI", "balance": "밸런스", "밸런스": "밸런스"}
OTHER_CLAIM = "기타"
CLAIMS = [("bug it fails", "버그", "it fails"), ("UI  button is off ", "UI", "button is off"), ("밸런스", "밸런스", ""), ("no such word", "기타", "no such word"), ("  ", "기타", "")]


@operator("claim_categories", f"WITH {values('x', 'raw, category, content', CLAIMS)} SELECT event_id, category, content FROM events JOIN x ON k = event_id % {len(CLAIMS)}")
def claim_categories(spark: SparkSession, sf: str) -> DataFrame:
    """STR-37: a claim's category by its first word, and the rest; without a known word all of it under the last category."""
    e = read(spark, sf, "events").withColumn("k", (F.col("event_id") % len(CLAIMS)).cast("int")).join(fixed(spark, [x[:1] for x in CLAIMS], "raw string"), "k")
    raw = F.trim("raw")
    known = F.element_at(F.create_map(*(F.lit(x) for pair in CLAIM_ALIASES.items() for x in pair)), F.lower(F.regexp_extract(raw, r"^(\S*)", 1)))
    content = F.when(known.isNotNull(), F.trim(F.regexp_replace(raw, r"^\S+", ""))).otherwise(raw)
    return e.select("event_id", F.coalesce(known, F.lit(OTHER_CLAIM)).alias("category"), content.alias("content"))


HEADER_WORDS = ["id", "no", "no.", "name", "type", "status", "category", "title", "component", "description", "device", "os", "번호", "항목", "분류", "결과", "내용", "구분"]
#: Rows of small tables, and the place of the header (none: null).
TABLES = [([["", "", ""], ["ID", "x", "y"]], 1), ([["1", "2", "3"], ["a", "b", "c"]], 1), ([["a", "a", "a", "b"], ["1", "2", "3", "4"]], 0), ([["1", "2", "3"]], None), ([["x", "y"]], None)]


def header_row(rows: Column) -> Column:
    """STR-33: the first row of three or more cells with a word of headers, else the first that isn't all numbers and is half distinct."""
    cells = lambda r: F.filter(r, lambda v: v != "")
    wide = lambda r: F.size(cells(r)) >= 3
    named = lambda r: wide(r) & F.arrays_overlap(F.transform(cells(r), lambda v: F.lower(F.trim(v))), F.array(*map(F.lit, HEADER_WORDS)))
    worded = lambda r: wide(r) & F.exists(cells(r), lambda v: ~v.rlike(r"^-?[0-9,.]+%?$")) & (2 * F.size(F.array_distinct(cells(r))) >= F.size(cells(r)))
    place = lambda test: F.array_position(F.transform(rows, lambda r: test(r)), F.lit(True)).cast("int")
    return F.coalesce(F.nullif(place(named), F.lit(0)), F.nullif(place(worded), F.lit(0))) - 1


@operator("header_rows", f"WITH {values('x', 'place', [(p,) for _, p in TABLES])} SELECT p_partkey, place FROM part JOIN x ON k = p_partkey % {len(TABLES)}")
def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    """STR-33: where each table's header stands."""
    p = read(spark, sf, "part").withColumn("k", (F.col("p_partkey") % len(TABLES)).cast("int")).join(fixed(spark, [(r,) for r, _ in TABLES], "cells array<array<string>>"), "k")
    return p.select("p_partkey", header_row(F.col("cells")).alias("place"))


#: Arguments of a tool, and whether they pass.
ARGUMENTS = [("{\"q\": \"abc\"}", True), ("{\"path\": \"a/../b\"}", False), ("{\"q\": \"" + "x" * 300 + "\"}", False), ("{\"mode\": \"drop\"}", False), ("{\"mode\": \"list\", \"q\": \"y\"}", True)]


@operator("argument_checks", f"WITH {values('x', 'raw, ok', [(r[:20], o) for r, o in ARGUMENTS])} SELECT user_id, ok, count(*) AS calls FROM events JOIN x ON k = event_id % {len(ARGUMENTS)} GROUP BY ALL".replace("True", "true").replace("False", "false"))
def argument_checks(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-23: arguments of at most 200 characters, without a way up the tree, and of a known mode."""
    e = read(spark, sf, "events").withColumn("k", (F.col("event_id") % len(ARGUMENTS)).cast("int")).join(fixed(spark, [x[:1] for x in ARGUMENTS], "raw string"), "k")
    args = F.map_values(F.from_json("raw", "map<string,string>"))
    mode = F.get_json_object("raw", "$.mode")
    ok = F.forall(args, lambda v: (F.length(v) <= 200) & ~v.contains("..")) & F.coalesce(mode.isin("list", "search", "read"), F.lit(True))
    return e.groupBy("user_id", ok.alias("ok")).agg(F.count("*").alias("calls"))
