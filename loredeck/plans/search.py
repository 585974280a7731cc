"""Full-text search, filters, rules, ladders and re-ranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.functions.text import has
from loredeck.operators.intent import Intent, compile_intent, issue_filter, parse_issue_query
from loredeck.operators.ranking import WEIGHTS, all_of, any_of, best_per, bm25_sql, first_rung, ladder, matches, top, weighted
from loredeck.registry import operator
from loredeck.sources.index import StoredIndex, ranked
from loredeck.sources.tables import CHUNK_PIECES, CHUNKS_SQL, ISSUES_SQL, NODES_SQL, chunks, issues, nodes, pages, read, text_index

KEYWORDS = ["thnd", "ation"]
_ORDER = "ORDER BY relevance DESC, node_id LIMIT 10"


@operator("search_bm25_topk", f"WITH {NODES_SQL}, hits AS ({bm25_sql('nodes', KEYWORDS, ['title', 'body'], 'node_id, title, body')}) SELECT node_id, title, left(body, 200) AS snippet, round(relevance, 6) AS relevance FROM hits {_ORDER}")
def search_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-01/02, FLT-12/30, SRT-01, MTH-02: ranked keyword search with snippets."""
    hits = top(ranked(text_index(spark, sf), KEYWORDS), 10, F.desc("relevance"), F.col("key")).select(F.col("key").alias("node_id"), "relevance").collect()  # ten rows
    best = spark.createDataFrame(hits, "node_id long, relevance double")
    texts = nodes(spark, sf).filter(F.col("node_id").isin([h.node_id for h in hits]))  # so that only their pages of the file are read
    found = top(texts.join(F.broadcast(best), "node_id"), 10, F.desc("relevance"), F.col("node_id"))
    return found.select("node_id", "title", F.substring("body", 1, 200).alias("snippet"), F.round("relevance", 6).alias("relevance"))


@operator("search_like_and", f"WITH {NODES_SQL} SELECT node_id, title FROM nodes WHERE (contains(lower(title), 'th') OR contains(lower(body), 'th')) AND contains(lower(body), 'erest')")
def search_like_and(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-10: every keyword in title or body."""
    return nodes(spark, sf).filter(matches(["th"], ["title", "body"]) & has("body", "erest")).select("node_id", "title")


@operator("search_match_phrase_and", f"WITH {NODES_SQL} SELECT space_key, CAST(count(*) AS BIGINT) AS n, min(node_id) AS first_node FROM nodes WHERE contains(lower(body), 'of the') AND contains(lower(body), 'and') GROUP BY space_key")
def search_match_phrase_and(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-12, FTS-06: phrases joined by AND."""
    hits = text_index(spark, sf).hits(["of the", "and"], inside="body").filter("key is not null").select(F.col("key").alias("node_id"))
    return hits.join(nodes(spark, sf).select("node_id", "space_key"), "node_id").groupBy("space_key").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"))


def routed(index: StoredIndex, keywords: list[str]) -> DataFrame:
    """FTS-03: key and route of the hits of keywords of any length.

    Long keywords by match, short ones (of at most two characters) on what is found; all keywords by likeness in the body
    if that leaves none, or if all are short.
    """
    long, short = [k for k in keywords if len(k) >= 3], [k for k in keywords if len(k) < 3]
    found = index.hits(long or keywords, tuple(short) if long else (), inside=None if long else "body").filter("key is not null")
    if not long:
        return found.select("key", F.lit("all like").alias("route"))
    after = F.forall(F.slice("counts", len(long) + 1, max(1, len(short))), lambda c: c > 0) if short else F.lit(True)
    matched = found.filter(after).select("key", F.lit("A+short" if short else "match").alias("route"))
    like = index.hits(long, inside="body").filter("key is not null").select("key", F.lit("all like").alias("route"))
    return ladder([matched, like]).drop("level") if short else matched


@operator("search_case_abc", f"WITH {NODES_SQL}, a AS ({bm25_sql('nodes', ['reonea'], ['title', 'body'], 'node_id, body, title')}), both_ AS (SELECT node_id FROM a WHERE contains(lower(title), 'è') OR contains(lower(body), 'è')), b AS (SELECT node_id FROM nodes WHERE contains(lower(body), 'reonea')) SELECT node_id, 'A+short' AS route FROM both_ UNION ALL SELECT node_id, 'all like' FROM b WHERE NOT EXISTS (SELECT 1 FROM both_)")
def search_case_abc(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-03, FLT-13/15: long keywords by match, short ones after it, all by LIKE if that leaves none."""
    return routed(text_index(spark, sf), ["reonea", "è"]).select(F.col("key").alias("node_id"), "route")


@operator("search_short_exists_chunk", f"WITH {CHUNKS_SQL} SELECT doc_id, source FROM documents WHERE lang = 'de' AND doc_id IN (SELECT node_id FROM chunks WHERE contains(lower(chunk), 'öß'))")
def search_short_exists_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-07: a short keyword in any chunk, as a semi join on the key."""
    hit = chunks(spark, sf).filter(has("chunk", "öß")).select(F.col("node_id").alias("doc_id"))
    return read(spark, sf, "documents").filter("lang = 'de'").join(hit, "doc_id", "left_semi").select("doc_id", "source")


@operator("chunk_best_per_node", f"WITH {CHUNKS_SQL}, hits AS ({bm25_sql('chunks', ['erest'], ['chunk'], 'node_id, seq')}), best AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY relevance DESC, seq) AS rn FROM hits) SELECT node_id, CAST(seq AS BIGINT) AS seq, round(relevance, 6) AS relevance FROM best WHERE rn = 1 {_ORDER}")
def chunk_best_per_node(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-04, WIN-01/02, JOIN-02: the best chunk of each node, then the best nodes."""
    hits = ranked(text_index(spark, sf), ["erest"], pieces=CHUNK_PIECES).select(F.col("key").alias("node_id"), F.col("piece").cast("long").alias("seq"), "relevance")
    best = best_per(hits, "node_id", F.desc("relevance"), F.col("seq"))
    return top(best, 10, F.desc("relevance"), F.col("node_id")).select("node_id", "seq", F.round("relevance", 6).alias("relevance"))


_ORIGIN = "CASE WHEN seq = 0 THEN 'preamble' WHEN contains(chunk, ' | ') THEN 'table' WHEN contains(chunk, chr(10)) THEN 'section' ELSE 'sliding' END"
_WEIGHTS = ", ".join(f"('{r}', '{o}', {w})" for r, by in WEIGHTS.items() for o, w in by.items())


@operator("rerank_weight_matrix", f"WITH {CHUNKS_SQL}, {NODES_SQL}, w(folder_role, chunk_origin, weight) AS (VALUES {_WEIGHTS}), hits AS (SELECT h.*, {_ORIGIN} AS chunk_origin FROM ({bm25_sql('chunks', ['ent'], ['chunk'], 'node_id, seq, chunk')}) h), s AS (SELECT hits.node_id, seq, relevance * coalesce(weight, 1.0) AS score FROM hits JOIN nodes USING (node_id) LEFT JOIN w USING (folder_role, chunk_origin)), b AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, seq) AS rn FROM s) SELECT node_id, CAST(seq AS BIGINT) AS seq, round(score, 6) AS score FROM b WHERE rn = 1 ORDER BY b.score DESC, node_id LIMIT 20")
def rerank_weight_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-17, SRT-04: relevance times the weight of role and chunk origin; best per node, then the limit."""
    bars, lines = F.col("counts")[1], F.col("counts")[2]
    origin = F.when(F.col("piece") == 0, "preamble").when(bars > 0, "table").when(lines > 0, "section").otherwise("sliding")
    hits = ranked(text_index(spark, sf), ["ent"], (" | ", "\n"), CHUNK_PIECES)
    hits = hits.select(F.col("key").alias("node_id"), F.col("piece").cast("long").alias("seq"), "relevance", origin.alias("chunk_origin")).join(nodes(spark, sf).select("node_id", "folder_role"), "node_id")
    best = best_per(weighted(hits), "node_id", F.desc("score"), F.col("seq"))
    return top(best, 20, F.desc("score"), F.col("node_id")).select("node_id", "seq", F.round("score", 6).alias("score"))


_LEVELS = ["contains(lower(body), 'zzzq') AND contains(lower(title), 'th')", "contains(lower(title), 'th') AND contains(lower(title), 'qqq')", "contains(lower(title), 'th')"]


@operator("ladder_min_level", f"WITH {NODES_SQL}, t AS (" + " UNION ALL ".join(f"SELECT node_id, {i} AS level FROM nodes WHERE {c}" for i, c in enumerate(_LEVELS)) + ") SELECT node_id, CAST(level AS INTEGER) AS level FROM t WHERE level = (SELECT min(level) FROM t)")
def ladder_min_level(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-05/07/11, SET-08: the first level of relaxation that finds anything."""
    n = nodes(spark, sf)
    intent = Intent(title_keywords=("th", "qqq"), body_keywords=("zzzq",))
    levels = [replace(intent, title_keywords=("th",)), replace(intent, body_keywords=()), replace(intent, body_keywords=(), title_keywords=("th",))]
    return first_rung(n, [compile_intent(x) for x in levels]).select("node_id", "level")


@operator("metadata_fallback", f"WITH {NODES_SQL}, t AS (SELECT space_key, node_id, 0 AS level FROM nodes WHERE lang = 'es' AND contains(lower(title), 'que') UNION ALL SELECT space_key, node_id, 1 FROM nodes WHERE contains(lower(body), 'que')), f AS (SELECT space_key, min(level) AS level FROM t GROUP BY space_key) SELECT t.space_key, node_id, CAST(t.level AS INTEGER) AS level FROM t JOIN f ON t.space_key = f.space_key AND t.level = f.level")
def metadata_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-08/13/16: metadata first, content where a key has none."""
    n = nodes(spark, sf).select("space_key", "node_id", "lang", "title", "body")
    return first_rung(n, [(F.col("lang") == "es") & has("title", "que"), has("body", "que")], "space_key").select("space_key", "node_id", "level")


_WEEK, _NEAR = "updated >= DATE '1995-03-01' AND updated < DATE '1995-03-08'", "updated >= DATE '1995-02-22' AND updated < DATE '1995-03-15'"
_RUNGS = [f"status = 'P' AND priority = '1-URGENT' AND {_WEEK}", f"priority = '1-URGENT' AND {_WEEK}", _WEEK, f"priority = '1-URGENT' AND {_NEAR}", _NEAR]


@operator(
    "issue_ladder",
    f"WITH {ISSUES_SQL}, i AS (SELECT * FROM issues WHERE price > 200000), t AS ("
    + " UNION ALL ".join(f"SELECT issue_key, project, {k} AS level FROM i WHERE {c}" for k, c in enumerate(_RUNGS))
    + "), f AS (SELECT project, min(level) AS level FROM t GROUP BY project) SELECT t.issue_key, t.project, CAST(t.level AS INTEGER) AS level FROM t JOIN f ON t.level = f.level AND t.project IS NOT DISTINCT FROM f.project",
)
def issue_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-09: what was asked for, then without the status, then without the priority, then the same with a week more before and after, by project."""
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    between = lambda a, z: (F.col("updated") >= day(a)) & (F.col("updated") < day(z))
    week, near = between("1995-03-01", "1995-03-08"), between("1995-02-22", "1995-03-15")
    status, urgent = F.col("status") == "P", F.col("priority") == "1-URGENT"
    rungs = [status & urgent & week, urgent & week, week, urgent & near, near]
    return first_rung(issues(spark, sf).filter("price > 200000"), rungs, "project").select("issue_key", "project", "level")


@operator("keyword_broadening", "WITH i AS (SELECT item_id, list_filter(str_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) >= 5)[1:3] AS kw FROM benchmark), w AS (SELECT item_id, unnest(kw) AS word, unnest(range(len(kw))) AS pos FROM i), d AS (SELECT DISTINCT doc_id, unnest(str_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents), m AS (SELECT item_id, doc_id, sum(CAST(pow(2, pos) AS BIGINT)) AS mask FROM (SELECT DISTINCT * FROM w) JOIN d USING (word) GROUP BY ALL), n AS (SELECT item_id, doc_id, CASE WHEN mask & 7 = 7 THEN 0 WHEN mask & 3 = 3 THEN 1 WHEN mask & 1 = 1 THEN 2 END AS level FROM m), f AS (SELECT item_id, min(level) AS level FROM n GROUP BY item_id) SELECT n.item_id, CAST(n.level AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS docs FROM n JOIN f ON n.item_id = f.item_id AND n.level = f.level GROUP BY ALL")
def keyword_broadening(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-10: all keywords, the first two, the first one; matched through a word index, not by pairs."""
    split = lambda c: F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " ")
    kw = F.slice(F.filter(split("text"), lambda x: F.length(x) >= 5), 1, 3)
    w = read(spark, sf, "benchmark").select("item_id", F.posexplode(kw).alias("pos", "word")).distinct()
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(split("text"))).alias("word"))
    mask = d.join(w, "word").groupBy("item_id", "doc_id").agg(F.sum(F.pow(F.lit(2), F.col("pos")).cast("long")).alias("mask"))
    rungs = [F.col("mask").bitwiseAND(F.lit(k)) == k for k in (7, 3, 1)]
    return first_rung(mask, rungs, "item_id").groupBy("item_id", "level").agg(F.count("*").alias("docs"))


@operator("role_filter_default_exclusion", f"WITH {NODES_SQL} SELECT folder_role, CAST(count(*) AS BIGINT) AS n FROM nodes WHERE coalesce(folder_role, 'unknown') <> 'game_data' AND NOT contains(lower(title), 'ble') AND (space_key IS NULL OR space_key <> 'src0') GROUP BY folder_role")
def role_filter_default_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-05/06/07/11: default exclusions and null-safe inequality."""
    keep = (F.coalesce("folder_role", F.lit("unknown")) != "game_data") & ~has("title", "ble") & ~F.col("space_key").eqNullSafe("src0")
    return nodes(spark, sf).filter(keep).groupBy("folder_role").agg(F.count("*").alias("n"))


@operator("date_ranges_or", "SELECT o_orderkey FROM orders WHERE (o_orderdate >= '1996-01-01' AND o_orderdate < '1996-02-01') OR (o_orderdate >= '1998-12-25' AND o_orderdate < '1999-01-08')")
def date_ranges_or(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-08/09: half-open ranges of days, any of them."""
    day = F.col("o_orderdate")
    spans = [("1996-01-01", "1996-01-31"), ("1998-12-25", "1999-01-07")]
    return read(spark, sf, "orders").filter(any_of([(day >= F.lit(a).cast("timestamp_ntz")) & (day < F.date_add(F.lit(z).cast("date"), 1).cast("timestamp_ntz")) for a, z in spans])).select("o_orderkey")


@operator("recency_nulls_last", f"WITH {NODES_SQL} SELECT node_id, quality, title FROM nodes LEFT JOIN labels ON node_id = doc_id ORDER BY quality DESC NULLS LAST, title, node_id LIMIT 25")
def recency_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-02/03: order with unknown values last."""
    n, labels = nodes(spark, sf), read(spark, sf, "labels")
    return top(n.join(labels, n.node_id == labels.doc_id, "left"), 25, F.desc_nulls_last("quality"), F.col("title"), F.col("node_id")).select("node_id", "quality", "title")


@operator("grid_first_router", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(error|fail)') THEN 'issue' WHEN regexp_matches(lower(text), '(week|month|day)') THEN 'schedule' WHEN length(text) < 60 THEN 'short' ELSE 'search' END AS route FROM conversations")
def grid_first_router(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-20/33: the first category whose pattern fits."""
    low = F.lower("text")
    route = F.when(low.rlike("(error|fail)"), "issue").when(low.rlike("(week|month|day)"), "schedule").when(F.length("text") < 60, "short").otherwise("search")
    return read(spark, sf, "conversations").select("conv_id", "turn", route.alias("route"))


#: (order, rule, keywords, role it is limited to).
RULES = [(1, "plan", ["thnd", "erest"], None), (2, "data", ["que", "ción"], "es"), (3, "issue", ["ung", "keit"], "de"), (4, "live", ["eau"], None)]


@operator("keyword_rule_match", "SELECT doc_id, CASE " + " ".join(f"WHEN ({' OR '.join(f'contains(lower(text), {chr(39)}{k}{chr(39)})' for k in kws)}){f' AND lang = {chr(39)}{lang}{chr(39)}' if lang else ''} THEN '{name}'" for _, name, kws, lang in RULES) + " END AS rule FROM documents")
def keyword_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-18, SRC-22: the first enabled rule wins, within its scope."""
    out = F.lit(None).cast("string")
    for _, name, kws, lang in reversed(RULES):
        out = F.when(any_of([has("text", k) for k in kws]) & (F.col("lang") == lang if lang else F.lit(True)), F.lit(name)).otherwise(out)
    return read(spark, sf, "documents").select("doc_id", out.alias("rule"))


@operator("page_rule_match", r"SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'startswith' WHEN contains(url, 'utm_source') THEN 'contains' WHEN regexp_matches(url, '/\d+\.html$') THEN 'regex' WHEN regexp_extract(url, '([^/]*)$', 1) = '' THEN 'exact' END AS matched FROM pages")
def page_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-19: rules of four kinds on the path and its leaf."""
    u = F.col("url")
    return pages(spark, sf).select("page_id", F.when(u.startswith("https://m."), "startswith").when(u.contains("utm_source"), "contains").when(u.rlike(r"/\d+\.html$"), "regex").when(F.regexp_extract(u, "([^/]*)$", 1) == "", "exact").alias("matched"))


_JQL = "project = BUILDING AND status NOT IN (F) AND priority IN (1-URGENT, 2-HIGH) AND assignee ~ Customer AND updated >= startOfMonth(-1) AND updated < startOfMonth(1)"


@operator("jql_filter_suite", f"WITH {ISSUES_SQL} SELECT issue_key, status, priority FROM issues WHERE project = 'BUILDING' AND status NOT IN ('F') AND priority IN ('1-URGENT', '2-HIGH') AND contains(lower(assignee), 'customer') AND updated >= '1997-05-01' AND updated < '1997-07-01'")
def jql_filter_suite(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-24/26: an issue query as columns, dates relative to 1997-06-15."""
    return issues(spark, sf).filter(issue_filter(parse_issue_query(_JQL), today="1997-06-15")).select("issue_key", "status", "priority")


@operator("issue_mirror_search", f"WITH {ISSUES_SQL} SELECT issue_key, assignee FROM issues WHERE contains(lower(assignee), '00') AND contains(lower(project), 'auto') ORDER BY updated DESC, issue_key LIMIT 30")
def issue_mirror_search(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-36, REM-18: every word in its column, newest first."""
    return top(issues(spark, sf).filter(all_of([has("assignee", "00"), has("project", "auto")])), 30, F.desc("updated"), F.col("issue_key")).select("issue_key", "assignee")


@operator("write_intent_guard", "SELECT conv_id, turn, nullif(regexp_extract(lower(text), '(delete|update|drop|insert|remove|create)', 1), '') AS verb, regexp_matches(regexp_replace(lower(text), '\\s+', '', 'g'), '(or1=1|;|/\\*)') AS dangerous FROM conversations WHERE role = 'user'")
def write_intent_guard(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-21/22/29: the first write verb, and patterns no query may hold."""
    low = F.lower("text")
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.nullif(F.regexp_extract(low, "(delete|update|drop|insert|remove|create)", 1), F.lit("")).alias("verb"), F.regexp_replace(low, r"\s+", "").rlike(r"(or1=1|;|/\*)").alias("dangerous"))


@operator("relevance_by_terms", f"WITH {NODES_SQL} SELECT node_id, CAST(contains(lower(title), 'th') AS INTEGER) + CAST(contains(lower(title), 'on') AS INTEGER) + CAST(contains(lower(title), 'le') AS INTEGER) AS terms FROM nodes ORDER BY terms DESC, node_id LIMIT 40")
def relevance_by_terms(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-07/08, FTS-18: number of query terms in the name."""
    terms = sum((has("title", k).cast("int") for k in ("th", "on", "le")), F.lit(0))
    return top(nodes(spark, sf).select("node_id", terms.alias("terms")), 40, F.desc("terms"), F.col("node_id"))
