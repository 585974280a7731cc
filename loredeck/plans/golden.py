"""Golden sets taken from logs, their evaluation by answers, and answers as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.functions import render
from loredeck.functions.temporal import means_range
from loredeck.plans.evaluation import _RANKED, ranked
from loredeck.registry import operator
from loredeck.sources.tables import issues, read

#: Entries of each stratum, and nodes that an entry expects at most.
TARGET, NODES = 40, 10
#: Prefixes that a folder not found is looked up under, in this order.
ROOTS = ("http", "https")
_HOST, _LANG, _NAME = r"^[a-z]+://([^/?#]+)", r"^[a-z]+://[^/]+/([a-z]+)/", r"^[a-z]+://[^/]+/[a-z]+/([^/?#]*)"
#: Pages as files, and events that have the number of a page as requests for it, in the order of the log.
_LOG = rf"""files AS (SELECT page_id, split_part(url, ':', 1) AS root, regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(url, '{_LANG}', 1) AS lang, regexp_extract(url, '{_NAME}', 1) AS stem FROM pages),
  named AS (SELECT *, CASE WHEN stem LIKE '%.html' THEN stem ELSE concat(stem, '.html') END AS file FROM files),
  log AS (SELECT event_id + 1 AS line, event_type, f.* FROM events JOIN named f ON event_id = page_id)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    f = read(spark, sf, "pages").select("page_id", F.split_part("url", F.lit(":"), F.lit(1)).alias("root"), part(_HOST).alias("host"), part(_LANG).alias("lang"), part(_NAME).alias("stem"))
    return f.withColumn("file", F.when(F.col("stem").endswith(".html"), F.col("stem")).otherwise(F.concat("stem", F.lit(".html"))))


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """line, handler, status, query and result of a log of requests; what was not found is in it with its question."""
    e = read(spark, sf, "events").select((F.col("event_id") + 1).alias("line"), "event_type", F.col("event_id").alias("page_id")).join(files(spark, sf), "page_id")
    even, shown = F.col("line") % 2 == 0, F.concat(F.lit("찾음\n파일: "), "file", F.lit("\n"))
    kind = lambda name: F.col("event_type") == name
    handler = F.when(kind("view"), "ask_claude").when(kind("click"), "search").when(kind("purchase"), "folder_ai").when(kind("signup"), "miss").otherwise("search")
    asked = F.concat("host", F.when(even, F.concat(F.lit(" \\ what is in "), "file", F.lit(" \\ now"))).otherwise(""))
    crumbs = F.when(even, F.concat_ws(" > ", "root", "host", "lang")).otherwise(F.concat_ws(" > ", "host", "lang"))
    missed = F.concat(F.when(even, F.concat(F.lit("최근 "), (F.col("line") % 9 + 1).cast("string"), F.lit("일 "))).otherwise(""), "host", F.lit(" 목록"))
    query = F.when(kind("view"), asked).when(kind("purchase"), crumbs).when(kind("signup"), missed).otherwise(F.concat(F.lit("in "), "host", F.lit(" ?")))
    result = F.when(kind("view") | even, shown).otherwise("찾음")
    return e.select("line", handler.alias("handler"), F.when(kind("error"), "ERROR").otherwise("OK").alias("status"), query.alias("query"), result.alias("result"))


def file_in(result: Column) -> Column:
    """The first file that a result names on a line of its own: without comma or bar, with an ending of 2 to 5 letters; else null."""
    named = F.transform(F.filter(F.transform(F.split(result, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("파일:")), lambda x: F.trim(F.substring(x, 4, 1 << 20)))
    return F.get(F.filter(named, lambda x: x.rlike(r"^[^,|]+\.[a-zA-Z]{2,5}$")), F.lit(0))


def first_nodes(asked: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key and expected: the first NODES ids of nodes (key, page_id) of each key that is asked for, nodes of a frequent key cut before they are gathered."""
    found = nodes.join(asked.select(key).distinct(), key)
    least = found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("page_id"))).filter(F.col("place") <= NODES)
    return least.groupBy(key).agg(F.array_sort(F.collect_list("page_id")).alias("expected"))


def gold_entries(log: DataFrame, files: DataFrame) -> DataFrame:
    """stratum, line, query and expected nodes: entries of a log (line, handler, status, query, result) that tell what should be found.

    Questions in two parts and searches expect the files of the name shown; searches that show none those of the host
    that their first word of three letters names. Folders expect what is below them, looked up under ROOTS if not
    found as they are. Misses that mean a range of time expect nothing. Each stratum has its first TARGET entries.
    """
    ok = log.filter("status = 'OK'").withColumn("file", file_in(F.col("result"))).withColumn("parts", F.split("query", r"\\"))
    question, key = F.trim(F.get("parts", F.lit(1))), F.trim(F.col("parts")[0])
    two = ok.filter((F.col("handler") == "ask_claude") & F.col("file").isNotNull() & (question != "")).select(F.lit("gold_2part").alias("stratum"), "line", key.alias("query"), "file")
    search = ok.filter("handler = 'search'").withColumn("word", F.get(F.filter(F.split("query", r"\s+"), lambda w: F.length(w) >= 3), F.lit(0)))
    simple = search.select(F.lit("gold_simple").alias("stratum"), "line", F.trim("query").alias("query"), "file", F.when(F.col("file").isNull(), F.col("word")).alias("host"))
    by_file = two.unionByName(simple.filter("file is not null").drop("host"))
    by_file = by_file.join(first_nodes(by_file, files.select("file", "page_id"), "file"), "file").drop("file")
    by_host = simple.filter("host is not null").drop("file")
    by_host = by_host.join(first_nodes(by_host, files.select("host", "page_id"), "host"), "host").drop("host")
    folders = ok.filter((F.col("handler") == "folder_ai") & F.contains("query", F.lit(">"))).select("line", F.array_join(F.filter(F.transform(F.split("query", ">"), lambda x: F.trim(x)), lambda x: x != ""), "/").alias("folder"))
    tried = F.array("folder", *(F.concat(F.lit(r + "/"), "folder") for r in ROOTS))
    tried = folders.select("line", F.posexplode(tried).alias("turn", "folder"))
    above = files.select("page_id", F.explode(F.array("root", F.concat_ws("/", "root", "host"), F.concat_ws("/", "root", "host", "lang"))).alias("folder"))
    by_folder = tried.join(first_nodes(tried, above, "folder"), "folder").groupBy("line").agg(F.min_by(F.struct("folder", "expected"), "turn").alias("f"))
    by_folder = by_folder.select(F.lit("gold_folder").alias("stratum"), "line", F.col("f.folder").alias("query"), "f.expected")
    missed = ok.filter((F.col("handler") == "miss") & means_range(F.col("query"))).select(F.lit("gold_miss_time_range").alias("stratum"), "line", F.trim("query").alias("query"), F.array().cast("array<long>").alias("expected"))
    every = by_file.unionByName(by_host).unionByName(by_folder).unionByName(missed)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("line"))
    return every.withColumn("place", place).filter(F.col("place") <= TARGET)


_LETTERS = {"gold_2part": "R", "gold_simple": "S", "gold_folder": "F", "gold_miss_time_range": "T"}


@operator(
    "gold_set",
    rf"""WITH {_LOG}, above AS (SELECT page_id, unnest([root, concat_ws('/', root, host), concat_ws('/', root, host, lang)]) AS folder FROM named),
  a AS (SELECT 'gold_2part' AS stratum, line, host AS query, file AS key FROM log WHERE event_type = 'view' AND line % 2 = 0 AND stem <> ''
    UNION ALL SELECT 'gold_simple', line, concat('in ', host, ' ?'), CASE WHEN line % 2 = 0 AND stem <> '' THEN file ELSE host END FROM log WHERE event_type = 'click'
    UNION ALL SELECT 'gold_folder', line, concat_ws('/', CASE WHEN line % 2 = 0 THEN root ELSE (SELECT min(b.root) FROM named b WHERE b.host = log.host AND b.lang = log.lang) END, host, lang), concat_ws('/', CASE WHEN line % 2 = 0 THEN root ELSE (SELECT min(b.root) FROM named b WHERE b.host = log.host AND b.lang = log.lang) END, host, lang) FROM log WHERE event_type = 'purchase'),
  n AS (SELECT file AS key, page_id, 'f' AS kind FROM named UNION ALL SELECT host, page_id, 'f' FROM named UNION ALL SELECT folder, page_id, 'd' FROM above),
  k AS (SELECT kind, key, list(page_id ORDER BY page_id)[1:{NODES}] AS expected FROM n GROUP BY ALL),
  g AS (SELECT stratum, line, query, expected FROM a JOIN k USING (key) WHERE (kind = 'd') = (stratum = 'gold_folder')
    UNION ALL SELECT 'gold_miss_time_range', line, concat('최근 ', line % 9 + 1, '일 ', host, ' 목록'), CAST([] AS BIGINT[]) FROM log WHERE event_type = 'signup' AND line % 2 = 0)
SELECT concat(CASE stratum WHEN 'gold_2part' THEN 'R' WHEN 'gold_simple' THEN 'S' WHEN 'gold_folder' THEN 'F' ELSE 'T' END, '-', place) AS id, stratum, line, query, array_to_string(expected, ',') AS expected
FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY line) AS place FROM g) WHERE place <= {TARGET}""",
)
def gold_set(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-08, SRC-15: the four strata of a golden set, from a log of requests."""
    letter = F.create_map(*(F.lit(x) for pair in _LETTERS.items() for x in pair))[F.col("stratum")]
    g = gold_entries(request_log(spark, sf), files(spark, sf))
    return g.select(F.concat(letter, F.lit("-"), F.col("place").cast("string")).alias("id"), "stratum", "line", "query", F.array_join(F.col("expected").cast("array<string>"), ",").alias("expected"))


KINDS = ("metadata", "list", "summary")
_HITS = f"""{_RANKED}, hits AS (SELECT item_id, rank, left(text, 40) AS title, concat_ws('/', source, lang) AS path, left(text, 500) AS snippet, strftime(ts, '%Y-%m-%d') AS modified
  FROM r JOIN documents USING (doc_id) LEFT JOIN events ON event_id = doc_id WHERE rank <= 10),
 asked AS (SELECT item_id, left(text, 60) AS question, regexp_extract(lower(text), '^(\\S+ \\S+)', 1) AS title, regexp_extract_all(lower(text), '[a-zà-ÿ]{{4,}}')[:3] AS keys, ['metadata', 'list', 'summary'][item_id % 3 + 1] AS kind FROM benchmark),
 parts AS (SELECT item_id, count(rank) AS n, any_value(kind) AS kind, any_value(question) AS question, any_value(asked.title) AS wanted, any_value(keys) AS keys,
  string_agg(CASE WHEN rank <= 3 THEN lower(concat(hits.title, chr(10), path)) END, chr(10) ORDER BY rank) AS top3,
  string_agg(CASE WHEN rank = 1 THEN concat('*', hits.title, '* — ', coalesce(concat('최근 수정: ', modified), '메타 정보 없음 (cache backfill 필요)')) END, '') AS of_first,
  string_agg(CASE WHEN rank <= 5 THEN concat('- ', hits.title, coalesce(concat(' (최근 수정: ', modified, ')'), ''), CASE WHEN path <> '' THEN concat(chr(10), '  경로: ', path) ELSE '' END) END, chr(10) ORDER BY rank) AS by_path,
  string_agg(concat(rank, '. ', hits.title, coalesce(concat(' (', modified, ')'), '')), chr(10) ORDER BY rank) AS numbered,
  string_agg(CASE WHEN rank <= 3 AND snippet <> '' THEN concat('*', hits.title, '*', chr(10), left(snippet, 300)) END, chr(10) || chr(10) ORDER BY rank) AS beginnings,
  string_agg(CASE WHEN rank <= 3 THEN concat('- ', hits.title) END, chr(10) ORDER BY rank) AS titles FROM asked LEFT JOIN hits USING (item_id) GROUP BY item_id),
 shown AS (SELECT *, concat('📋 *질문*', chr(10), coalesce(question, ''), chr(10), chr(10), '💬 *답변*', chr(10),
  CASE WHEN n = 0 THEN CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in render.NOTHING.items())} END ELSE CASE kind WHEN 'metadata' THEN of_first WHEN 'list' THEN concat('검색 결과 ', n, '건의 파일이 있습니다.') ELSE coalesce(beginnings, '{render.NOTHING['summary']}') END END,
  CASE WHEN n = 0 THEN '' ELSE concat(chr(10), chr(10), '🔗 *근거*', chr(10), CASE kind WHEN 'metadata' THEN by_path WHEN 'list' THEN numbered ELSE titles END) END, chr(10), chr(10), '📌 *출처*', chr(10), 'wiki') AS answer FROM parts)"""


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, kind, text, hits and answer: every passage as a question, the ten best documents and the answer shown."""
    best = ranked(spark, sf).select("item_id", F.posexplode("top").alias("place", "hit")).select("item_id", "place", "hit.doc_id")
    texts = read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.concat_ws("/", "source", "lang").alias("path"), F.substring("text", 1, 500).alias("snippet"))
    changed = read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("modified"))
    hits = best.join(texts, "doc_id").join(changed, "doc_id", "left")
    # at most ten hits a passage
    lists = hits.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "path", "snippet", "modified"))).alias("hits"))
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("item_id") % 3 + 1).cast("int"))
    q = read(spark, sf, "benchmark").select("item_id", "text", kind.alias("kind")).join(lists, "item_id", "left")
    bare = F.transform("hits", lambda h: F.struct(h["title"].alias("title"), h["path"].alias("path"), h["snippet"].alias("snippet"), h["modified"].alias("modified")))
    return q.withColumn("answer", render.rendered(F.col("kind"), F.substring("text", 1, 60), bare, F.lit("wiki")))


@operator("answers_by_kind", f"WITH {_HITS} SELECT item_id, kind, answer FROM shown")
def answers_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """STR-36, REM-20: the answer to every passage as it is shown, by kind of request."""
    return answered(spark, sf).select("item_id", "kind", "answer")


@operator(
    "golden_evaluation",
    f"""WITH {_HITS} SELECT item_id, n AS result_count, top3_hit, answer_correct, concat(CASE WHEN top3_hit THEN '' ELSE concat('expected=', wanted) END, CASE WHEN answer_correct THEN '' ELSE concat(' | answer_miss=', array_to_string(keys, ',')) END) AS issue
FROM (SELECT *, CASE WHEN wanted = '' THEN n > 0 ELSE coalesce(contains(top3, wanted), false) END AS top3_hit, CASE WHEN len(keys) = 0 THEN length(answer) > 5 ELSE len(list_filter(keys, lambda k: contains(lower(answer), k))) > 0 END AS answer_correct FROM shown)""",
)
def golden_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-14: whether the first three documents have the expected title, and the answer one of the expected words; without expectations any result and any answer will do."""
    a = answered(spark, sf).withColumns({"wanted": F.regexp_extract(F.lower("text"), r"^(\S+ \S+)", 1), "keys": F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0)), 1, 3)})
    n = F.greatest(F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")), F.lit(0)).cast("long")
    named = lambda h: F.contains(F.lower(h["title"]), F.col("wanted")) | F.contains(F.lower(h["path"]), F.col("wanted"))
    top3 = F.coalesce(F.exists(F.slice("hits", 1, 3), named), F.lit(False))
    hit = F.when(F.col("wanted") == "", n > 0).otherwise(top3)
    correct = F.when(F.size("keys") == 0, F.length("answer") > 5).otherwise(F.exists("keys", lambda k: F.contains(F.lower("answer"), k)))
    a = a.select("item_id", n.alias("result_count"), hit.alias("top3_hit"), correct.alias("answer_correct"), "wanted", "keys")
    issue = F.concat(F.when(F.col("top3_hit"), "").otherwise(F.concat(F.lit("expected="), "wanted")), F.when(F.col("answer_correct"), "").otherwise(F.concat(F.lit(" | answer_miss="), F.array_join("keys", ","))))
    return a.select("item_id", "result_count", "top3_hit", "answer_correct", issue.alias("issue"))


_BASE = "https://issues.example.org"


@operator(
    "reply_sections",
    rf"""WITH t AS (SELECT conv_id, turn, text, concat('AB-', turn) AS key FROM conversations WHERE role = 'assistant'),
  s AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 2 THEN text ELSE text || ' **see** ' || key END AS answer, CASE conv_id % 3 WHEN 0 THEN concat('- __', key, '__ and <', '{_BASE}|', key, '>') ELSE '' END AS evidence FROM t),
  c AS (SELECT conv_id, turn, trim(answer, concat(' ', chr(9), chr(10), chr(13))) AS answer, evidence FROM s)
SELECT conv_id, turn, regexp_replace(replace(answer, '**see**', '*see*'), ' (AB-\d+)$', concat(' <{_BASE}/browse/', chr(92), '1|', chr(92), '1>')) AS answer, regexp_replace(replace(evidence, '__', '*'), '\*(AB-\d+)\*', concat('*<{_BASE}/browse/', chr(92), '1|', chr(92), '1>*')) AS evidence FROM c""",
)
def reply_sections(spark: SparkSession, sf: str) -> DataFrame:
    """STR-35, REM-19: replies cut into answer and evidence, strong text in chat markup, issue keys as links."""
    t, key = F.col("text"), F.concat(F.lit("AB-"), F.col("turn").cast("string"))
    kind = F.col("conv_id") % 3
    seen = F.concat(t, F.lit(" **see** "), key)
    evidence = F.concat(F.lit("- __"), key, F.lit(f"__ and <{_BASE}|"), key, F.lit(">"))
    reply = F.when(kind == 0, F.concat(F.lit("생각\n[답변]\n"), seen, F.lit("\n\n[근거]\n"), evidence, F.lit("\n"))).when(kind == 1, seen).otherwise(t)
    s = read(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", render.answer_sections(reply).alias("s"))
    shown = lambda c: render.linked(render.chat_markup(c), _BASE)
    return s.select("conv_id", "turn", shown(F.col("s.answer")).alias("answer"), shown(F.col("s.evidence")).alias("evidence"))


@operator(
    "tabbed_issues",
    """WITH i AS (SELECT project, status, issue_key, priority, assignee FROM (SELECT o_orderkey AS issue_key, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS project, c_name AS assignee, row_number() OVER (PARTITION BY c_mktsegment, o_orderstatus ORDER BY o_orderkey) AS place FROM orders LEFT JOIN customer ON o_custkey = c_custkey) WHERE place <= 8)
SELECT project, status, concat('issues of ', project, chr(10), '| key | priority | assignee |', chr(10), '|---|---|---|', chr(10), string_agg(concat('| ', issue_key, ' | ', priority, ' | ', CASE WHEN issue_key % 4 = 0 THEN '' ELSE assignee END, ' |'), chr(10) ORDER BY issue_key), chr(10), 'end') AS shown FROM i WHERE project IS NOT NULL GROUP BY project, status HAVING count(*) >= 2""",
)
def tabbed_issues(spark: SparkSession, sf: str) -> DataFrame:
    """STR-29: texts with tabbed lines, here the first eight issues of a project and status, with those lines as a table; short lines are filled up."""
    i = issues(spark, sf).filter("project is not null").withColumn("place", F.row_number().over(Window.partitionBy("project", "status").orderBy("issue_key"))).filter("place <= 8")
    line = F.concat_ws("\t", F.col("issue_key").cast("string"), "priority", F.when(F.col("issue_key") % 4 != 0, F.col("assignee")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("issue_key", line.alias("line")))), lambda x: x["line"])
    text = i.groupBy("project", "status").agg(lines.alias("lines")).filter("size(lines) >= 2")
    whole = F.array_join(F.concat(F.array(F.concat(F.lit("issues of "), "project"), F.lit("key\tpriority\tassignee")), F.col("lines"), F.array(F.lit("end"))), "\n")
    return text.select("project", "status", render.tab_tables(whole).alias("shown"))
