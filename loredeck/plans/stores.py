"""Tables kept together: issues and files upserted into all their tables, runs of stages with a ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.functions.text import STRIP_HTML_SQL, strip_html
from loredeck.operators.ranking import best_per
from loredeck.operators.runs import Ledger, Stage, run
from loredeck.registry import operator
from loredeck.sources.shared import shared_folder
from loredeck.sources.tables import ISSUES_SQL, issues, pages, read
from loredeck.sources.tableset import TableSet


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{shared_folder(spark)}/loredeck-{name}-{uuid.uuid4().hex}"


# ---- issues in four tables


def issue_tables(batch: DataFrame, now: int) -> dict[str, DataFrame]:
    """SNK-09: the rows of the four tables that hold a part of each issue; issues without a key are left out."""
    key, project = F.col("issue_key").cast("string"), F.coalesce("project", F.lit(""))
    boxed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    body = F.concat_ws("\n", boxed(key), boxed(project), "status", "priority", "assignee")
    day, at, i = F.date_format("updated", "yyyy-MM-dd"), F.lit(now), batch.filter("issue_key is not null")
    return {
        "nodes": i.select("issue_key", F.concat(F.lit("issue "), key).alias("title"), F.concat(F.lit("/"), project, F.lit("/"), key).alias("path"), at.alias("created_at"), at.alias("updated_at")),
        "content": i.select("issue_key", body.alias("body_text"), F.length(body).alias("char_count")),
        "meta": i.select("issue_key", "status", F.to_json(F.struct("priority", "assignee")).alias("extra"), day.alias("last_modified")),
        "issues": i.select("issue_key", "project", "status", "priority", "assignee", at.alias("cached_at")),
    }


def issue_store(spark: SparkSession, root: str) -> TableSet:
    keys = {"nodes": "issue_key", "content": "issue_key", "meta": "issue_key", "issues": "issue_key", "sync_log": "run"}
    return TableSet(spark, root, keys, 8, {"nodes": ("path", "created_at")})


def load_issues(store: TableSet, batch: DataFrame, mode: str) -> int:
    """REM-13: a batch into the four tables, and a row of the log of what was new and what was known, in one commit."""
    number = store.manifest()["version"] + 1
    parts = issue_tables(batch, number)
    known = store.table("nodes").select("issue_key", F.lit(1).alias("known")) if number > 1 else None
    counted = parts["nodes"].join(known, "issue_key", "left") if known else parts["nodes"].withColumn("known", F.lit(None).cast("int"))
    log = counted.agg(F.count("*").alias("scanned"), F.count("known").alias("updated"))
    log = log.select(F.lit(number).alias("run"), F.lit(mode).alias("mode"), "scanned", (F.col("scanned") - F.col("updated")).alias("added"), "updated")
    return store.commit({**parts, "sync_log": log})


def synced(spark: SparkSession, sf: str) -> TableSet:
    """All issues, then a delta: every fifth issue has a new status, every fiftieth is there a second time under a new key."""
    store, all_issues = issue_store(spark, fresh(spark, "issues")), issues(spark, sf)
    load_issues(store, all_issues, "full")
    changed = all_issues.filter("issue_key % 5 = 0").withColumn("status", F.lit("X"))
    new = all_issues.filter("issue_key % 50 = 0").withColumn("issue_key", -F.col("issue_key") - 1)
    load_issues(store, changed.unionByName(new), "delta")
    return store


_BODY = "concat_ws(chr(10), concat('[', issue_key, ']'), concat('[', coalesce(project, ''), ']'), status, priority, assignee)"


@operator(
    "issue_upsert",
    f"""WITH {ISSUES_SQL}, delta AS (SELECT * REPLACE ('X' AS status) FROM issues WHERE issue_key % 5 = 0
  UNION ALL SELECT * REPLACE (-issue_key - 1 AS issue_key) FROM issues WHERE issue_key % 50 = 0),
merged AS (SELECT *, CASE WHEN issue_key < 0 THEN 2 ELSE 1 END AS created_at, 2 AS updated_at FROM delta
  UNION ALL SELECT *, 1, 1 FROM issues WHERE issue_key NOT IN (SELECT issue_key FROM delta))
SELECT issue_key, concat('issue ', issue_key) AS title, concat('/', coalesce(project, ''), '/', issue_key) AS path, created_at, updated_at,
  length({_BODY}) AS char_count, status, priority, assignee, strftime(updated, '%Y-%m-%d') AS last_modified FROM merged""",
)
def issue_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-09, SNK-03: what is read back from the four tables after a full load and a delta."""
    store = synced(spark, sf)
    i = store.table("nodes").join(store.table("content"), "issue_key").join(store.table("issues").select("issue_key", "priority", "assignee"), "issue_key")
    i = i.join(store.table("meta").select("issue_key", "status", "last_modified"), "issue_key")
    return i.select("issue_key", "title", "path", "created_at", "updated_at", "char_count", "status", "priority", "assignee", "last_modified")


@operator(
    "issue_sync_log",
    f"""WITH {ISSUES_SQL} SELECT 1 AS run, 'full' AS mode, count(*) AS scanned, count(*) AS added, 0 AS updated FROM issues
UNION ALL SELECT 2, 'delta', count(*) FILTER (issue_key % 5 = 0) + count(*) FILTER (issue_key % 50 = 0), count(*) FILTER (issue_key % 50 = 0), count(*) FILTER (issue_key % 5 = 0) FROM issues""",
)
def issue_sync_log(spark: SparkSession, sf: str) -> DataFrame:
    """REM-13, SNK-05: the log that each load appends to, in the same commit as its rows."""
    return synced(spark, sf).table("sync_log")


# ---- files in three tables

MOST_BODY = 500
#: Role of a file by the first folder of its path, kind by its ending.
FILE_ROLES = {"en": "planning", "de": "qa_result", "fr": "live_issue", "es": "game_data"}
FILE_KINDS = {"html": "page", "htm": "page", "pdf": "document", "png": "image"}


def _named(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key), F.lit("unknown"))


def file_tables(files: DataFrame, now: int) -> dict[str, DataFrame]:
    """SNK-10: files (path, body) as rows of three tables, with labels that follow from the path; no path, no file."""
    path = F.regexp_replace("path", r"^[a-z]+://[^/]*/?|[?#].*$", "")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    role, kind = _named(FILE_ROLES, F.lower(F.regexp_extract(path, "^([^/]*)/", 1))), _named(FILE_KINDS, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    f, at, body = files.filter("path <> ''"), F.lit(now), F.coalesce("body", F.lit(""))
    return {
        "nodes": f.select("path", name.alias("title"), role.alias("folder_role"), kind.alias("file_kind"), at.alias("created_at"), at.alias("updated_at")),
        "content": f.select("path", F.substring(body, 1, MOST_BODY).alias("body_text"), F.length(body).alias("char_count"), (F.length(body) >= MOST_BODY).alias("body_truncated")),
        "meta": f.select("path", F.to_json(F.struct(kind.alias("file_source_type"))).alias("extra")),
    }


_PATH = "regexp_replace(path, '^[a-z]+://[^/]*/?|[?#].*$', '', 'g')"
_NAME = f"regexp_extract({_PATH}, '([^/]*)$', 1)"


def _cases(values: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE 'unknown' END"


@operator(
    "file_upsert",
    f"""WITH p AS (SELECT url AS path, html, page_id FROM pages WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
f AS (SELECT path, CASE WHEN page_id % 3 = 0 THEN concat('moved from ', path) ELSE coalesce({STRIP_HTML_SQL}, '') END AS body, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM p)
SELECT path, {_NAME} AS title, {_cases(FILE_ROLES, f"lower(regexp_extract({_PATH}, '^([^/]*)/', 1))")} AS folder_role,
  {_cases(FILE_KINDS, f"lower(regexp_extract({_NAME}, '[.]([A-Za-z0-9]+)$', 1))")} AS file_kind,
  1 AS created_at, updated_at, left(body, {MOST_BODY}) AS body_text, length(body) AS char_count, length(body) >= {MOST_BODY} AS body_truncated FROM f""",
)
def file_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-10, SNK-03, SNK-13: pages as files, ingested twice; what is read back from the tables."""
    store = TableSet(spark, fresh(spark, "files"), {"nodes": "path", "content": "path", "meta": "path"}, 8, {"nodes": ("created_at",)})
    p = best_per(pages(spark, sf).filter("url <> ''"), "url", F.col("page_id"))
    store.commit(file_tables(p.select(F.col("url").alias("path"), strip_html("html").alias("body")), 1))
    store.commit(file_tables(p.filter("page_id % 3 = 0").select(F.col("url").alias("path"), F.concat(F.lit("moved from "), "url").alias("body")), 2))
    return store.table("nodes").join(store.table("content"), "path")


# ---- runs


@operator(
    "orchestrated_run",
    """WITH c AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM orders) AS issues, (SELECT count(*) FROM documents) AS files,
  (SELECT count(*) FROM documents WHERE n_chars > 400) AS enriched, (SELECT CAST(max(page_id) AS VARCHAR) FROM pages) AS p, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders) AS o, (SELECT CAST(max(doc_id) AS VARCHAR) FROM documents) AS d)
SELECT 1 AS attempt, 'pages' AS stage, 'done' AS status, pages AS rows, p AS mark FROM c UNION ALL SELECT 1, 'issues', 'done', issues, o FROM c
UNION ALL SELECT 1, 'files', 'failed', NULL, NULL UNION ALL SELECT 1, 'enrich', 'skipped', NULL, NULL
UNION ALL SELECT 2, 'pages', 'kept', NULL, p FROM c UNION ALL SELECT 2, 'issues', 'kept', NULL, o FROM c
UNION ALL SELECT 2, 'files', 'done', files, d FROM c UNION ALL SELECT 2, 'enrich', 'done', enriched, d FROM c
UNION ALL SELECT 3, 'pages', 'done', 0, p FROM c UNION ALL SELECT 3, 'issues', 'done', 0, o FROM c
UNION ALL SELECT 3, 'files', 'done', 0, d FROM c UNION ALL SELECT 3, 'enrich', 'done', 0, d FROM c""",
)
def orchestrated_run(spark: SparkSession, sf: str) -> DataFrame:
    """STM-05: pages, issues, files, then enrichment of files; the files' source is away at first. What the ledger says of three attempts."""
    root = fresh(spark, "run")

    def delta(source: DataFrame, key: str, name: str):
        """Rows beyond the watermark, appended to the stage's table."""

        def action(mark: str | None) -> tuple[int, str | None]:
            new = source if mark is None else source.filter(F.col(key) > F.lit(mark).cast("long"))
            new.write.mode("append").parquet(f"{root}/{name}")
            written = spark.read.parquet(f"{root}/{name}").filter(F.col(key) > F.lit(mark).cast("long") if mark else F.lit(True))
            found = written.agg(F.count("*").alias("n"), F.max(key).alias("mark")).first()
            return found.n, mark if found.mark is None else str(found.mark)

        return action

    def files(there: bool):
        folder = sf if there else f"{root}/away"
        return lambda mark: delta(read(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id", "files")(mark)

    def enrich(mark: str | None) -> tuple[int, str | None]:
        f = spark.read.parquet(f"{root}/files").filter(F.col("doc_id") > F.lit(mark).cast("long") if mark else F.lit(True))
        found = f.agg(F.count_if(F.col("n_chars") > 400).alias("n"), F.max("doc_id").alias("mark")).first()
        return found.n, mark if found.mark is None else str(found.mark)

    ledger = Ledger(spark, f"{root}/ledger")
    for there in (False, True, True):
        stages = [
            Stage("pages", delta(pages(spark, sf).select("page_id", "url"), "page_id", "pages")),
            Stage("issues", delta(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "issues")),
            Stage("files", files(there)), Stage("enrich", enrich, ("files",)),
        ]
        run(stages, ledger)
    return ledger.rows().select("attempt", "stage", "status", "rows", "mark")
