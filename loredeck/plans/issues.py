"""Issue texts and issue queries: markup, search text, projections, predicates, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.functions.text import has
from loredeck.operators.ranking import all_of
from loredeck.registry import operator
from loredeck.sources.tables import ISSUES_SQL, NODES_SQL, issues, nodes, read

#: Samples of issue markup, and the text that remains.
MARKUP = [
    ("{code:java}run{code}", "run"), ("h2. Cause", "Cause"), ("see !shot.png|width=3! here", "see here"), ("[the page|https://x.example/a]", "the page"), ("[https://x.example]", "https://x.example"),
    ("*bold* and _slanted_", "bold and slanted"), ("<b>a</b>  &lt;c&gt; &amp; d", "a <c> & d"), ("plain", "plain"),
]


# Marks of issue texts. An entity's character, or nothing for the other kinds.
_EMPHASIS = r"[*_\-]{1,2}[^*_\-]+[*_\-]{1,2}"
_PIECE = r"\{[^}]+\}|h[1-6]\.\s*|![^!|]+\|[^!]*!|\[[^\]]+\]|<[^>]+>|&(?:lt|gt|quot|#39|nbsp|amp);"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def _plain(piece: Column) -> Column:
    """What is left of a piece, by the mark it begins with."""
    mark = F.substring(piece, 1, 1)
    entity = F.element_at(F.create_map(*(F.lit(x) for pair in _ENTITIES.items() for x in pair)), piece)
    inside = F.substring(piece, F.lit(2), F.length(piece) - 2)
    label = F.regexp_extract(inside, r"^([^|]+)\|.", 1)
    return (
        F.when(F.length(piece) == 1, piece).when(mark.isin("{", "<"), " ").when(mark == "[", F.when(label != "", label).otherwise(inside))
        .when(mark == "&", F.coalesce(entity, piece)).when(piece.rlike(r"^h[1-6]\.|^!"), "").otherwise(piece)
    )


def strip_markup(c: Column) -> Column:
    """Issue markup to text: macros and tags become blanks, headings, pictures and emphasis marks go, links keep their text.

    The text is cut into pieces once, each piece is put into words by its kind; emphasis, which may go around other
    pieces, is cut out of the text before.
    """
    cut = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bare = lambda run: F.when(run.rlike(f"^{_EMPHASIS}$"), F.regexp_replace(run, r"^[*_\-]{1,2}|[*_\-]{1,2}$", "")).otherwise(run)
    protected = rf"(?s){_PIECE}|{_EMPHASIS}|."  # marks inside links, tags and macros are no emphasis
    inner = F.array_join(F.transform(cut(c, protected), bare), "")
    out = F.array_join(F.transform(cut(inner, rf"(?s){_PIECE}|[^{{h!\[<&]+|."), _plain), "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A list of fixed length, to be broadcast, numbered by k."""
    return F.broadcast(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}"))


def literal(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of fixed rows, numbered by k, in SQL."""
    return f"{name}(k, {columns}) AS (VALUES {', '.join('(' + ', '.join(literal(v) for v in (k, *r)) + ')' for k, r in enumerate(rows))})"


@operator("strip_issue_markup", f"WITH {values('m', 'raw, plain', MARKUP)} SELECT conv_id, turn, concat(role, ': ', plain) AS text FROM conversations JOIN m ON k = (conv_id + turn) % {len(MARKUP)}")
def strip_issue_markup(spark: SparkSession, sf: str) -> DataFrame:
    """STR-03: text of issue markup."""
    c = read(spark, sf, "conversations").withColumn("k", ((F.col("conv_id") + F.col("turn")) % len(MARKUP)).cast("int")).join(fixed(spark, MARKUP, "raw string, plain string"), "k")
    return c.select("conv_id", "turn", strip_markup(F.concat("role", F.lit(": "), "raw")).alias("text"))


@operator(
    "issue_search_text",
    f"WITH {ISSUES_SQL} SELECT issue_key, concat_ws(chr(10), concat('[', issue_key, ']'), concat('[', project, ']'), status, priority, assignee, CASE WHEN price > 200000 THEN concat('labels: large, ', lower(project)) END) AS search_text FROM issues",
)
def issue_search_text(spark: SparkSession, sf: str) -> DataFrame:
    """STR-04: the fields of an issue in one text, blank ones left out."""
    fields = [F.concat(F.lit("["), F.col("issue_key").cast("string"), F.lit("]")), F.concat(F.lit("["), "project", F.lit("]")), F.col("status"), F.col("priority"), F.col("assignee")]
    labels = F.when(F.col("price") > 200000, F.concat(F.lit("labels: "), F.array_join(F.array(F.lit("large"), F.lower("project")), ", ")))
    parts = F.filter(F.array(*fields, labels), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return issues(spark, sf).select("issue_key", F.array_join(parts, "\n").alias("search_text"))


@operator(
    "issue_projection",
    f"WITH {ISSUES_SQL} SELECT concat(project, '-', issue_key) AS issue_key, project AS project_key, concat('issue ', issue_key) AS summary, status, coalesce(assignee, '') AS assignee, strftime(updated, '%Y-%m-%d') AS updated FROM issues WHERE project IS NOT NULL",
)
def issue_projection(spark: SparkSession, sf: str) -> DataFrame:
    """REM-15, JSN-01, ARR-02: six fields of an issue's JSON; the key's beginning is the project."""
    named = F.struct(F.col("status").alias("name"))
    fields = F.struct(F.concat(F.lit("issue "), "issue_key").alias("summary"), named.alias("status"), F.struct(F.col("assignee").alias("displayName")).alias("assignee"), F.date_format("updated", "yyyy-MM-dd").alias("updated"))
    raw = issues(spark, sf).filter("project is not null").select(F.to_json(F.struct(F.concat_ws("-", "project", F.col("issue_key").cast("string")).alias("key"), fields.alias("fields"))).alias("raw"))
    kind = "key string, fields struct<summary:string, status:struct<name:string>, assignee:struct<displayName:string>, updated:string>"
    i = raw.select(F.from_json("raw", kind).alias("i")).filter("i.key <> ''")
    text = lambda path: F.coalesce(F.col(f"i.fields.{path}"), F.lit(""))
    return i.select(F.col("i.key").alias("issue_key"), F.split_part(F.col("i.key"), F.lit("-"), F.lit(1)).alias("project_key"), text("summary").alias("summary"), text("status.name").alias("status"), text("assignee.displayName").alias("assignee"), text("updated").alias("updated"))


# What counts as done, and words that ask for issues in work or done.
DONE = ("Closed", "Done", "완료", "종료", "해결됨", "닫힘")
ACTIVE_WORDS, CLOSED_WORDS = ("액티브", "활성", "진행 중", "진행중", "미해결", "열린", "active", "open"), ("완료", "종료", "해결된", "닫힌", "closed", "done")
IS_QUERY = r"(?i)\b(?:project|status|assignee|text|summary)\s*(?:=|!=|~|\bin\b|\bnot\s+in\b)|\border\s+by\b"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about issues, put together from the issue's own fields in six ways (n): queries, keys and texts."""
    n, key, who, project = F.col("issue_key") % 6, F.col("issue_key").cast("string"), F.coalesce("assignee", F.lit("")), F.coalesce("project", F.lit("none"))
    q = F.when(n == 0, F.concat(F.lit("project = "), project, F.lit(' AND text ~ "'), who, F.lit('"')))
    q = q.when(n == 1, F.concat(F.lower(project), F.lit("-"), key)).when(n == 2, F.concat(F.lit("active issues of "), who))
    q = q.when(n == 3, F.concat(who, F.lit(' said "'), "priority", F.lit('", 완료된 이슈'))).when(n == 4, F.concat(F.lit("assignee in ("), who, F.lit(") ORDER BY updated"))).otherwise(who)
    return issues(spark, sf).select("issue_key", q.alias("q"))


@operator(
    "question_to_query",
    f"""WITH {ISSUES_SQL}, a AS (SELECT issue_key, issue_key % 6 AS n, coalesce(assignee, '') AS who, coalesce(project, 'none') AS project, priority FROM issues),
b AS (SELECT *, CASE n WHEN 0 THEN concat('project = ', project, ' AND text ~ "', who, '"') WHEN 1 THEN concat(lower(project), '-', issue_key) WHEN 2 THEN concat('active issues of ', who)
  WHEN 3 THEN concat(who, ' said "', priority, '", 완료된 이슈') WHEN 4 THEN concat('assignee in (', who, ') ORDER BY updated') ELSE who END AS q FROM a)
SELECT issue_key, q, CASE WHEN n IN (0, 4) THEN 'query' WHEN n = 1 THEN 'key' ELSE 'text' END AS kind, CASE n WHEN 2 THEN 'NOT IN' WHEN 3 THEN 'IN' END AS status,
  CASE WHEN n IN (0, 4) THEN q ELSE concat('summary ~ "', replace(q, '"', concat(chr(92), '"')), '" ORDER BY updated DESC') END AS query,
  CASE WHEN n = 0 AND who <> '' THEN who ELSE q END AS search_text, CASE WHEN n = 0 THEN upper(project) ELSE '' END AS project FROM b""",
)
def question_to_query(spark: SparkSession, sf: str) -> DataFrame:
    """REM-16/17, FLT-25/28: questions that are queries, issue keys or texts; the query, its text and project, and the status asked for."""
    q = F.col("q")
    kind = F.when(F.upper(F.trim(q)).rlike(r"^[A-Z][A-Z0-9]+-[0-9]+$"), "key").when(q.rlike(IS_QUERY), "query").otherwise("text")
    asks = lambda words: q.rlike("(?i)" + "|".join(words))
    status = F.when(asks(ACTIVE_WORDS), "NOT IN").when(asks(CLOSED_WORDS), "IN")
    query = F.when(kind == "query", q).otherwise(F.concat(F.lit('summary ~ "'), F.replace(q, F.lit('"'), F.lit('\\"')), F.lit('" ORDER BY updated DESC')))
    text = F.regexp_extract(q, r"(?i)(?:text|summary)\s*~\s*[\"'](.+?)[\"']", 1)
    project = F.upper(F.regexp_extract(q, r"(?i)project\s*=\s*[\"']?([A-Z][A-Z0-9_-]+)", 1))
    return questions(spark, sf).select(
        "issue_key", "q", kind.alias("kind"), status.alias("status"), query.alias("query"), F.when(text != "", text).otherwise(q).alias("search_text"), project.alias("project")
    )


#: Clauses of a page query: field, operator, value.
PAGE_QUERY = [("title", "~", "th"), ("space", "!=", "web"), ("type", "=", "page"), ("lastModified", ">", "2024-06-01"), ("ancestor", "=", "en")]


def page_filter(clauses: list[tuple[str, str, str]]) -> Column:
    """FLT-27: clauses on pages as a predicate; a value is a literal, so it can't end its clause."""
    field = {"title": "title", "space": "space_key", "type": "node_type", "lastModified": "modified", "text": "body"}

    def one(name: str, op: str, value: str) -> Column:
        if name == "ancestor":
            return F.array_contains("ancestors", value)
        c, v = F.col(field[name]), F.to_date(F.lit(value)) if name == "lastModified" else F.lit(value)
        return {"=": lambda: c == v, "~": lambda: has(c, value), ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "!=": lambda: c != v}[op]()

    return all_of([one(*x) for x in clauses])


@operator(
    "page_query",
    f"""WITH {NODES_SQL}, p AS (SELECT *, CASE WHEN node_id % 4 = 0 THEN 'blog' ELSE 'page' END AS node_type, DATE '2024-01-01' + CAST(node_id % 366 AS INTEGER) AS modified, ['root', lang] AS ancestors FROM nodes)
SELECT node_id, title, strftime(modified, '%Y-%m-%d') AS modified FROM p WHERE contains(lower(title), 'th') AND space_key <> 'web' AND node_type = 'page' AND modified > DATE '2024-06-01' AND list_contains(ancestors, 'en')""",
)
def page_query(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-27: pages by title, space, type, ancestor and time of change."""
    n = nodes(spark, sf)
    kind = F.when(F.col("node_id") % 4 == 0, "blog").otherwise("page")
    p = n.withColumns({"node_type": kind, "modified": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("node_id") % 366).cast("int")), "ancestors": F.array(F.lit("root"), "lang")})
    return p.filter(page_filter(PAGE_QUERY)).select("node_id", "title", F.col("modified").cast("string").alias("modified"))


@operator(
    "escaped_literals",
    """WITH v AS (SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN concat(' "', c_mktsegment, '"') ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN concat(chr(92), c_mktsegment, chr(92), '"') ELSE '' END) AS v FROM customer)
SELECT c_custkey, v, concat('title ~ "', regexp_replace(v, '(["\\\\])', '\\\\\\1', 'g'), '"') AS clause FROM v""",
)
def escaped_literals(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-28: values as literals of a page query: first backslashes, then quotes are escaped."""
    quoted = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(' "'), "c_mktsegment", F.lit('"'))).otherwise("")
    slashed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\\"), "c_mktsegment", F.lit('\\"'))).otherwise("")
    r = read(spark, sf, "customer").select("c_custkey", F.concat("c_name", quoted, slashed).alias("v"))
    escaped = F.replace(F.replace("v", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return r.select("c_custkey", "v", F.concat(F.lit('title ~ "'), escaped, F.lit('"')).alias("clause"))


#: Intents as JSON that a model may give, and what is kept: domain, limit, keywords.
INTENTS = [
    ('{"domain": "wiki", "limit": 5, "keywords": ["a", "b"], "x": 1}', "wiki", 5, "a,b"), ('{"domain": "nowhere", "limit": 900}', "all", 100, ""),
    ('{"domain": "jira", "limit": -3, "keywords": ["c", "c", ""]}', "jira", 1, "c"), ("not json", "all", 10, ""), ("{}", "all", 10, ""),
]


@operator("intent_validation", f"WITH {values('x', 'raw, domain, cap, keywords', INTENTS)} SELECT conv_id, turn, domain, cap AS limit_, keywords FROM conversations JOIN x ON k = (conv_id + turn) % {len(INTENTS)}")
def intent_validation(spark: SparkSession, sf: str) -> DataFrame:
    """JSN-02, STR-41: an intent's JSON read by a schema: unknown fields go, enumerations and bounds are kept to, keywords are distinct."""
    c = read(spark, sf, "conversations").withColumn("k", ((F.col("conv_id") + F.col("turn")) % len(INTENTS)).cast("int")).join(fixed(spark, [x[:1] for x in INTENTS], "raw string"), "k")
    i = F.from_json("raw", "domain string, limit int, keywords array<string>")
    domain = F.when(i["domain"].isin("wiki", "jira", "gdi"), i["domain"]).otherwise("all")
    keywords = F.array_distinct(F.filter(F.coalesce(i["keywords"], F.array().cast("array<string>")), lambda w: F.trim(w) != ""))
    return c.select("conv_id", "turn", domain.alias("domain"), F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(i["limit"], F.lit(10)))).alias("limit_"), F.array_join(keywords, ",").alias("keywords"))
