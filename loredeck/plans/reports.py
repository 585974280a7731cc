"""Reports of operation: failures of a day, misses, health, merged activity, recent builds, results cut to size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.operators.ranking import top
from loredeck.registry import operator
from loredeck.sources.shared import shared_folder
from loredeck.sources.tables import EVENTS_SQL, ISSUES_SQL, NODES_SQL, events, issues, nodes, read

#: Kinds of a miss by event type (fixed values); views, purchases and errors are requests for files, errors failed.
MISSES = {"click": "CACHE_MISS", "signup": "ALL_MISS"}
# Classes of a failed request, in the order they are shown.
FAILURES = ("CONTENT_EMPTY", "KEYWORD_MISS", "FOLDER_MISS", "DATE_FORMAT", "TYPO", "SEARCH_MISS")
_FLAGGED = "CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0"
_ENTRIES = f"{EVENTS_SQL}, m AS (SELECT event_id, day, concat('page ', user_id) AS page, CASE event_type WHEN 'click' THEN 'CACHE_MISS' ELSE 'ALL_MISS' END AS kind, {_FLAGGED} AS flagged FROM ev WHERE event_type IN ('click', 'signup'))"


def misses(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, day, page, kind and flagged (a range of time was meant) of the log of misses."""
    e = events(spark, sf).filter(F.col("event_type").isin(*MISSES))
    kind = F.when(F.col("event_type") == "click", MISSES["click"]).otherwise(MISSES["signup"])
    return e.select("event_id", "day", F.concat(F.lit("page "), F.col("user_id").cast("string")).alias("page"), kind.alias("kind"), (F.get_json_object("props", "$.k").cast("long") % 5 == 0).alias("flagged"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """day, failed and failure (its class) of the log of requests for files."""
    failed = F.col("event_type") == "error"
    failure = F.element_at(F.array(*(F.lit(f) for f in FAILURES)), (F.floor(F.col("value")) % len(FAILURES) + 1).cast("int"))
    return events(spark, sf).filter(F.col("event_type").isin("view", "purchase", "error")).select("day", failed.alias("failed"), F.when(failed, failure).alias("failure"))


def count_of(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def most_common(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n most frequent pages of each group of `by`, those seen first before others as frequent, as an ordered array `pages` of (page, n)."""
    counts = rows.groupBy(*by, "page").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    place = F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy(F.desc("n"), "first"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= n) if by else top(counts, n, F.desc("n"), F.col("first")).withColumn("place", place)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page", "n"))), lambda x: F.struct(x["page"].alias("page"), x["n"].alias("n"))).alias("pages"))


@operator(
    "daily_failure_report",
    f"""WITH {_ENTRIES}, d AS (SELECT day, count(*) AS n, count(*) FILTER (kind = 'CACHE_MISS') AS cache, count(*) FILTER (kind = 'ALL_MISS') AS every, count(*) FILTER (flagged) AS flagged FROM m GROUP BY day),
  g AS (SELECT day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM ev WHERE event_type IN ('view', 'purchase', 'error') GROUP BY day),
  p AS (SELECT day, page, count(*) AS n, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, min(event_id)) AS place FROM m GROUP BY day, page),
  t AS (SELECT day, string_agg(concat(page, '(', n, ')'), ', ' ORDER BY place) AS pages FROM p WHERE place <= 3 GROUP BY day)
SELECT day, concat('[', day, '] 일일 실패 리포트', chr(10), 'Wiki: 총 ', coalesce(d.n, 0), '건 (CACHE_MISS=', coalesce(cache, 0), ', ALL_MISS=', coalesce(every, 0), ', TIME_RANGE=', coalesce(flagged, 0), ')', chr(10), 'GDI: 총 ', coalesce(g.n, 0), '건 (ERROR=', coalesce(failed, 0), ')', coalesce(concat(chr(10), '상위 실패 페이지: ', pages), '')) AS report
FROM d FULL JOIN g USING (day) LEFT JOIN t USING (day)""",
)
def daily_failure_report(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18: what failed on each day that has an entry, and the three pages that missed most."""
    m = misses(spark, sf)
    d = m.groupBy("day").agg(F.count("*").alias("n"), *(count_of(F.col("kind") == k).alias(k) for k in MISSES.values()), count_of(F.col("flagged")).alias("flagged"))
    g = requests(spark, sf).groupBy("day").agg(F.count("*").alias("asked"), count_of(F.col("failed")).alias("failed"))
    all_days = d.join(g, "day", "full").na.fill(0).join(most_common(m, ["day"], 3), "day", "left")
    number = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pages = F.array_join(F.transform("pages", lambda x: F.concat(x["page"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    wiki = text("Wiki: 총 ", number("n"), "건 (CACHE_MISS=", number("CACHE_MISS"), ", ALL_MISS=", number("ALL_MISS"), ", TIME_RANGE=", number("flagged"), ")")
    files = text("GDI: 총 ", number("asked"), "건 (ERROR=", number("failed"), ")")
    report = text("[", F.col("day"), "] 일일 실패 리포트\n", wiki, "\n", files, F.coalesce(text("\n상위 실패 페이지: ", pages), F.lit("")))
    return all_days.select("day", report.alias("report"))


@operator(
    "miss_kpi",
    f"""WITH {_ENTRIES}, w AS (SELECT count(*) AS n, count(*) FILTER (kind = 'CACHE_MISS') AS cache, count(*) FILTER (kind = 'ALL_MISS') AS every, count(*) FILTER (flagged) AS flagged FROM m),
  p AS (SELECT page, count(*) AS n, min(event_id) AS first FROM m GROUP BY page ORDER BY n DESC, first LIMIT 10),
  g AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, {', '.join(f"count(*) FILTER (event_type = 'error' AND CAST(floor(value) AS BIGINT) % {len(FAILURES)} = {i}) AS c{i}" for i in range(len(FAILURES)))} FROM ev WHERE event_type IN ('view', 'purchase', 'error'))
SELECT w.n AS wiki_total, cache AS cache_miss, every AS all_miss, flagged AS time_range_flagged, CASE WHEN w.n > 0 THEN round(cache / w.n, 3) ELSE 0.0 END AS cache_miss_rate, CASE WHEN w.n > 0 THEN round(every / w.n, 3) ELSE 0.0 END AS all_miss_rate,
  coalesce((SELECT string_agg(concat(page, ':', n), ', ' ORDER BY n DESC, first) FROM p), '') AS top_miss_pages, g.n AS gdi_total, g.n - failed AS ok, failed AS error, CASE WHEN g.n > 0 THEN round(failed / g.n, 3) ELSE 0.0 END AS error_rate,
  concat({", ', ', ".join(f"'{f}:', c{i}" for i, f in enumerate(FAILURES))}) AS by_category FROM w, g""",
)
def miss_kpi(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17: counts and rates of misses, the ten pages that missed most, and failed requests by class in a fixed order; one row."""
    m = misses(spark, sf)
    w = m.agg(F.count("*").alias("wiki_total"), count_of(F.col("kind") == "CACHE_MISS").alias("cache_miss"), count_of(F.col("kind") == "ALL_MISS").alias("all_miss"), count_of(F.col("flagged")).alias("time_range_flagged"))
    pages = most_common(m, [], 10).select(F.array_join(F.transform("pages", lambda x: F.concat(x["page"], F.lit(":"), x["n"].cast("string"))), ", ").alias("top_miss_pages"))
    r = requests(spark, sf).agg(F.count("*").alias("gdi_total"), count_of(F.col("failed")).alias("error"), *(count_of(F.col("failure") == f).alias(f) for f in FAILURES))
    both = w.join(pages).join(r)  # one row each
    rate = lambda c, n: F.when(F.col(n) > 0, F.round(F.col(c) / F.col(n), 3)).otherwise(0.0)
    by_category = F.concat_ws(", ", *(F.concat(F.lit(f"{f}:"), F.col(f).cast("string")) for f in FAILURES))
    first = both.select("wiki_total", "cache_miss", "all_miss", "time_range_flagged", rate("cache_miss", "wiki_total").alias("cache_miss_rate"), rate("all_miss", "wiki_total").alias("all_miss_rate"), "top_miss_pages", "gdi_total", (F.col("gdi_total") - F.col("error")).alias("ok"), "error", rate("error", "gdi_total").alias("error_rate"), by_category.alias("by_category"))
    return first


@operator("category_metrics", f"WITH {EVENTS_SQL}, c AS (SELECT source, event_type AS category, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS domains FROM ev GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, category) AS INTEGER) AS place FROM c")
def category_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: counts, means and extremes of each category of a source, most frequent first; ordered after they are counted."""
    c = events(spark, sf).groupBy("source", F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("user_id").alias("domains"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "category")))


@operator("ambiguity_top", "SELECT left(note, 80) AS note, n FROM (SELECT regexp_extract(text, '^(\\S*)', 1) AS note, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 HAVING note <> '') ORDER BY n DESC, note LIMIT 10")
def ambiguity_top(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-20: the ten most frequent notes, here what a question begins with; empty ones aren't counted."""
    notes = read(spark, sf, "conversations").filter("role = 'user'").select(F.regexp_extract("text", r"^(\S*)", 1).alias("note")).filter("note <> ''").groupBy("note").agg(F.count("*").alias("n"))
    return top(notes, 10, F.desc("n"), F.col("note")).select(F.substring("note", 1, 80).alias("note"), "n")


@operator(
    "log_errors_by_file",
    f"""WITH {EVENTS_SQL}, f AS (SELECT source, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors, max(CAST(ts AS DATE)) AS last FROM ev GROUP BY source)
SELECT concat(source, '.log') AS file, lines, errors, CAST((SELECT max(last) FROM f) - last AS INTEGER) AS age, CASE WHEN errors > 10 THEN 'WARN' ELSE 'PASS' END AS status FROM f""",
)
def log_errors_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-33: lines and errors of each log file, read back line by line; more than ten errors are a warning, age is against the newest line of all."""
    at = f"{shared_folder(spark)}/loredeck-logs-{uuid.uuid4().hex}"
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK"), F.col("user_id").cast("string"))
    events(spark, sf).select(line.alias("value"), F.concat("source", F.lit(".log")).alias("file")).write.partitionBy("file").text(at)
    lines = spark.read.schema("value string, file string").text(at)
    f = lines.groupBy("file").agg(F.count("*").alias("lines"), count_of(F.lower("value").contains("error")).alias("errors"), F.max(F.substring("value", 1, 10)).cast("date").alias("last"))
    newest = f.agg(F.max("last").alias("newest"))
    return f.join(F.broadcast(newest)).select("file", "lines", "errors", F.datediff("newest", "last").alias("age"), F.when(F.col("errors") > 10, "WARN").otherwise("PASS").alias("status"))


@operator(
    "health_checks",
    f"""WITH {NODES_SQL}, {EVENTS_SQL}, s AS (SELECT event_id, source, event_type FROM ev WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 5), o AS (SELECT count(*) AS n FROM nodes WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = node_id))
SELECT 'load' AS area, r.role AS item, CASE WHEN count(node_id) > 0 THEN 'PASS' ELSE 'WARN' END AS status, concat(count(node_id), '건') AS detail FROM (VALUES ('planning'), ('qa_result'), ('live_issue'), ('game_data'), ('archive')) r(role) LEFT JOIN nodes ON folder_role = role GROUP BY r.role
UNION ALL SELECT 'sync', concat('sync: ', source, '/', event_id), CASE event_type WHEN 'purchase' THEN 'PASS' ELSE 'WARN' END, event_type FROM s
UNION ALL SELECT 'orphans', 'nodes', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END, CASE WHEN n > 0 THEN concat(n, '건') ELSE '없음' END FROM o""",
)
def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-32: load of each expected part, the five last runs, and nodes without a record, each passed or with a warning."""
    n = nodes(spark, sf)
    parts = spark.createDataFrame([("planning",), ("qa_result",), ("live_issue",), ("game_data",), ("archive",)], "item string")
    pieces = lambda c: F.concat(c.cast("string"), F.lit("건"))
    load = parts.join(n.groupBy(F.col("folder_role").alias("item")).agg(F.count("*").alias("n")), "item", "left").na.fill(0)
    load = load.select(F.lit("load").alias("area"), "item", F.when(F.col("n") > 0, "PASS").otherwise("WARN").alias("status"), pieces(F.col("n")).alias("detail"))
    runs = top(events(spark, sf).filter(F.col("event_type").isin("purchase", "error")), 5, F.desc("ts"), F.desc("event_id"))
    runs = runs.select(F.lit("sync").alias("area"), F.concat(F.lit("sync: "), "source", F.lit("/"), F.col("event_id").cast("string")).alias("item"), F.when(F.col("event_type") == "purchase", "PASS").otherwise("WARN").alias("status"), F.col("event_type").alias("detail"))
    orphans = n.join(read(spark, sf, "labels").select(F.col("doc_id").alias("node_id")), "node_id", "left_anti").agg(F.count("*").alias("n"))
    orphans = orphans.select(F.lit("orphans").alias("area"), F.lit("nodes").alias("item"), F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("status"), F.when(F.col("n") > 0, pieces(F.col("n"))).otherwise("없음").alias("detail"))
    return load.unionByName(runs).unionByName(orphans)


@operator(
    "merged_activity",
    f"""WITH {EVENTS_SQL}, a AS (SELECT ts, event_id, 'query' AS log, source AS who, event_type AS what FROM ev WHERE event_type IN ('view', 'click') UNION ALL SELECT ts, event_id, 'sync', source, 'success' FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT ts, event_id, 'miss', concat('page ', user_id), CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'ALL_MISS' END FROM ev WHERE event_type IN ('signup', 'error'))
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, log, who, what FROM a ORDER BY ts DESC, event_id LIMIT 30""",
)
def merged_activity(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-11: the thirty newest entries of three logs; each log gives its own thirty first."""
    e = events(spark, sf)
    kind = lambda *names: e.filter(F.col("event_type").isin(*names))
    row = lambda log, who, what: ("ts", "event_id", F.lit(log).alias("log"), who.alias("who"), what.alias("what"))
    newest = lambda d: top(d, 30, F.desc("ts"), F.col("event_id"))
    logs = [kind("view", "click").select(*row("query", F.col("source"), F.col("event_type"))), kind("purchase").select(*row("sync", F.col("source"), F.lit("success")))]
    logs.append(kind("signup", "error").select(*row("miss", F.concat(F.lit("page "), F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", "ERROR").otherwise("ALL_MISS"))))
    merged = newest(newest(logs[0]).unionByName(newest(logs[1])).unionByName(newest(logs[2])))
    return merged.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "log", "who", "what")


@operator("recent_builds", f"WITH {ISSUES_SQL}, b AS (SELECT DISTINCT project, strftime(updated, '%Y%m%d') AS build FROM issues WHERE project IS NOT NULL) SELECT project, concat('- ', project, ' 최근빌드: ', string_agg(build, ', ' ORDER BY build DESC)) AS line FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY build DESC) AS place FROM b) WHERE place <= 5 GROUP BY project")
def recent_builds(spark: SparkSession, sf: str) -> DataFrame:
    """REM-24: the five newest builds of each project, as a line of the summary."""
    b = issues(spark, sf).filter("project is not null and updated is not null").select("project", F.date_format("updated", "yyyyMMdd").alias("build")).distinct()
    newest = b.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("build")))).filter("place <= 5")
    listed = newest.groupBy("project").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("build"))), ", ").alias("builds"))
    return listed.select("project", F.concat(F.lit("- "), "project", F.lit(" 최근빌드: "), "builds").alias("line"))


_ROWS, _CHARS = 20, 8000


@operator(
    "result_arrays",
    f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
  j AS (SELECT o_custkey, concat('{{"data":[', string_agg(o_orderkey, ',' ORDER BY o_orderkey), ']', CASE WHEN any_value(total) > {_ROWS} THEN concat(',"_data_truncated":"', any_value(total), '행 중 {_ROWS}행 표시"') ELSE '' END, '}}') AS shown FROM r WHERE place <= {_ROWS} GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN length(shown) > {_CHARS} THEN concat(left(shown, {_CHARS}), '...[truncated]') ELSE shown END AS shown FROM j""",
)
def result_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """STR-40: rows of each customer as JSON, cut to twenty with a note of how many there are, and to 8 000 characters."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    totals = o.groupBy("o_custkey").agg(F.count("*").alias("total"))
    first = o.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter(F.col("place") <= _ROWS)
    data = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("data")).join(totals, "o_custkey")
    note = F.when(F.col("total") > _ROWS, F.concat(F.col("total").cast("string"), F.lit(f"행 중 {_ROWS}행 표시")))
    shown = F.to_json(F.struct("data", note.alias("_data_truncated")))
    return data.select("o_custkey", F.when(F.length(shown) > _CHARS, F.concat(F.substring(shown, 1, _CHARS), F.lit("...[truncated]"))).otherwise(shown).alias("shown"))
