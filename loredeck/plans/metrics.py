"""Operational metrics: rates, pivots, quantiles, trends, usage and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.operators.measures import exclusive_quantile, floor_quantile, percent, percent_sql, risk
from loredeck.operators.ranking import top
from loredeck.registry import operator
from loredeck.sources.tables import EVENTS_SQL, OUTCOMES, RESULTS, by_type, by_type_sql, events, read

_OUT, _RES = by_type_sql(OUTCOMES), by_type_sql(RESULTS)


@operator("stats_by_source", "SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS latest FROM documents GROUP BY source")
def stats_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01/04: counts and sums of each source."""
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("latest"))


@operator("fill_rates", f"SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(quality) AS BIGINT) AS filled, {percent_sql('count(quality)', 'count(*)')} AS pct, CAST(count(*) FILTER (length(text) < 500) AS BIGINT) AS short FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-02/23/24: shares with a guard for nothing."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("filled"), percent(F.count("quality"), F.count("*")).alias("pct"), F.count_if(F.length("text") < 500).alias("short"))


@operator("freshness", f"SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, {percent_sql(chr(99) + 'ount(*) FILTER (o_orderdate >= ' + chr(39) + '2000-07-01' + chr(39) + ')', 'count(*)')} AS fresh_pct FROM orders GROUP BY 1")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10/31: share changed lately, before a fixed day."""
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), percent(F.count_if(F.col("o_orderdate") >= "2000-07-01"), F.count("*")).alias("fresh_pct"))


_HIT = "count(*) FILTER (o = 'hit')"


@operator("hit_rate_overall_and_source", f"WITH {EVENTS_SQL}, t AS (SELECT source, {_OUT} AS o FROM ev) SELECT coalesce(source, 'all') AS source, CAST({_HIT} AS BIGINT) AS hits, CAST(count(*) FILTER (o = 'miss') AS BIGINT) AS misses, CAST(count(*) FILTER (o = 'fallback') AS BIGINT) AS fallbacks, {percent_sql(_HIT, 'count(o)')} AS hit_rate FROM t GROUP BY GROUPING SETS ((source), ())")
def hit_rate_overall_and_source(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: outcomes of each source and of all."""
    t = events(spark, sf).withColumn("o", by_type(OUTCOMES))
    n = lambda k: F.count_if(F.col("o") == k)
    return t.rollup("source").agg(n("hit").alias("hits"), n("miss").alias("misses"), n("fallback").alias("fallbacks"), percent(n("hit"), F.count("o")).alias("hit_rate")).withColumn("source", F.coalesce("source", F.lit("all")))


@operator("response_summary", f"WITH {EVENTS_SQL}, t AS (SELECT source, value, {_RES} AS r FROM ev) SELECT coalesce(source, 'all') AS source, CAST(count(r) AS BIGINT) AS n, {percent_sql(chr(99) + 'ount(*) FILTER (r = ' + chr(39) + 'fail' + chr(39) + ')', 'count(r)')} AS fail_rate, round(avg(value) FILTER (value > 0 AND r IS NOT NULL), 3) AS mean_elapsed FROM t GROUP BY GROUPING SETS ((source), ())")
def response_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08: results of each source and of all, mean of positive times."""
    t = events(spark, sf).withColumn("r", by_type(RESULTS))
    return t.rollup("source").agg(F.count("r").alias("n"), percent(F.count_if(F.col("r") == "fail"), F.count("r")).alias("fail_rate"), F.round(F.avg(F.when((F.col("value") > 0) & F.col("r").isNotNull(), F.col("value"))), 3).alias("mean_elapsed")).withColumn("source", F.coalesce("source", F.lit("all")))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@operator("daily_pivot", f"WITH {EVENTS_SQL} SELECT day, " + ", ".join(f'CAST(count(*) FILTER (event_type = {chr(39)}{t}{chr(39)}) AS BIGINT) AS "{t}"' for t in _TYPES) + " FROM ev GROUP BY day")
def daily_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-09: a row a day, a column a metric, 0 for none."""
    return events(spark, sf).groupBy("day").pivot("event_type", _TYPES).count().na.fill(0)


@operator("daily_summary_window", f"WITH {EVENTS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT day) AS BIGINT) AS days FROM ev WHERE day BETWEEN '2024-01-13' AND '2024-01-20' GROUP BY source")
def daily_summary_window(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16/18: the last seven days and the day itself."""
    day = F.lit("2024-01-20").cast("date")
    return events(spark, sf).filter(F.to_date("ts").between(F.date_sub(day, 7), day)).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@operator("recent_failures", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 15")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-11, SRC-18: the newest failures."""
    return top(events(spark, sf).filter("event_type = 'error'"), 15, F.desc("ts"), F.col("event_id")).select("event_id", "user_id")


@operator("sync_latest_per_source", f"WITH {EVENTS_SQL} SELECT source, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM ev WHERE event_type = 'purchase' GROUP BY source")
def sync_latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-04, SRC-17: the last success of each source."""
    return events(spark, sf).filter("event_type = 'purchase'").groupBy("source").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@operator("p99_floor", "SELECT event_type, value AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1)")
def p99_floor(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-09: the 99th percentile as an element of the data."""
    return floor_quantile(events(spark, sf), "event_type", "value", 0.99, "p99")


@operator("quantile_exclusive", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), b AS (SELECT event_type, any_value(n) AS n, max(value) FILTER (i = floor((n + 1) * 0.95)) AS lo, max(value) FILTER (i = floor((n + 1) * 0.95) + 1) AS hi, max(value) AS mx FROM r GROUP BY event_type) SELECT event_type, round(CASE WHEN n < 20 THEN mx ELSE lo + ((n + 1) * 0.95 - floor((n + 1) * 0.95)) * (coalesce(hi, lo) - lo) END, 6) AS p95 FROM b")
def quantile_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-10: the exclusive 95th percentile."""
    return exclusive_quantile(events(spark, sf), "event_type", "value", 19, 20, "p95").select("event_type", F.round("p95", 6).alias("p95"))


@operator("perf_risk_levels", f"WITH {EVENTS_SQL}, q AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM ev), p AS (SELECT source, value AS p99 FROM q WHERE i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1)), s AS (SELECT source, {percent_sql(chr(99) + 'ount(*) FILTER (event_type = ' + chr(39) + 'error' + chr(39) + ')', 'count(*)')} AS errors, {percent_sql(chr(99) + 'ount(*) FILTER (event_type = ' + chr(39) + 'view' + chr(39) + ')', 'count(*)')} AS hits FROM ev GROUP BY source) SELECT source, p99, errors, hits, CASE greatest(CASE WHEN p99 > 150 THEN 2 WHEN p99 > 100 THEN 1 ELSE 0 END, CASE WHEN errors > 25 THEN 2 WHEN errors > 15 THEN 1 ELSE 0 END, CASE WHEN hits > 0 AND hits < 50 THEN 1 ELSE 0 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk FROM p JOIN s USING (source)")
def perf_risk_levels(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11/32, MTH-05: the worst of several thresholds."""
    e = events(spark, sf)
    s = e.groupBy("source").agg(percent(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("errors"), percent(F.count_if(F.col("event_type") == "view"), F.count("*")).alias("hits"))
    return floor_quantile(e, "source", "value", 0.99, "p99").join(s, "source").withColumn("risk", risk(F.col("p99"), F.col("errors"), F.col("hits")))


@operator("trend_3d_vs_4d", f"WITH {EVENTS_SQL}, d AS (SELECT event_type, day, sum(value) AS v FROM ev WHERE day BETWEEN '2024-01-14' AND '2024-01-20' GROUP BY ALL) SELECT event_type, round((avg(v) FILTER (day >= '2024-01-18') - avg(v) FILTER (day < '2024-01-18')) / avg(v) FILTER (day < '2024-01-18') * 100, 2) AS trend FROM d GROUP BY event_type")
def trend_3d_vs_4d(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13, WIN-13: three days against the four before."""
    d = events(spark, sf).filter("day between '2024-01-14' and '2024-01-20'").groupBy("event_type", "day").agg(F.sum("value").alias("v"))
    new, old = (F.avg(F.when(c, F.col("v"))) for c in (F.col("day") >= "2024-01-18", F.col("day") < "2024-01-18"))
    return d.groupBy("event_type").agg(F.round((new - old) / old * 100, 2).alias("trend"))


@operator("usage_by_period", f"WITH {EVENTS_SQL}, t AS (SELECT source, day, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM ev) SELECT coalesce(source, 'all') AS source, CAST(coalesce(sum(tokens) FILTER (day = '2024-01-20'), 0) AS BIGINT) AS today, CAST(coalesce(sum(tokens) FILTER (day >= '2024-01-14' AND day <= '2024-01-20'), 0) AS BIGINT) AS week, CAST(sum(tokens) AS BIGINT) AS month FROM t GROUP BY GROUPING SETS ((source), ())")
def usage_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12, SRC-19: usage of a day, a week and a month."""
    t = events(spark, sf).withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    within = lambda a, z: F.coalesce(F.sum(F.when(F.col("day").between(a, z), F.col("tokens"))), F.lit(0))
    return t.rollup("source").agg(within("2024-01-20", "2024-01-20").alias("today"), within("2024-01-14", "2024-01-20").alias("week"), F.sum("tokens").alias("month")).withColumn("source", F.coalesce("source", F.lit("all")))


#: Price of a million tokens in and out by model family (fixed values).
PRICES = {"small": (0.8, 4.0), "medium": (3.0, 15.0), "large": (15.0, 75.0)}


@operator("cost_by_model", "WITH p(model, p_in, p_out) AS (VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in PRICES.items()) + "), t AS (SELECT CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tin, value AS tout FROM events) SELECT model, round(sum(tin / 1e6 * p_in + tout / 1e6 * p_out), 6) AS cost FROM t JOIN p USING (model) GROUP BY model")
def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14, MTH-04: tokens at their model's price."""
    model = F.element_at(F.array(*(F.lit(m) for m in PRICES)), (F.col("user_id") % 3 + 1).cast("int"))
    prices = spark.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, p_in double, p_out double")
    t = events(spark, sf).select(model.alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tin"), F.col("value").alias("tout"))
    return t.join(F.broadcast(prices), "model").groupBy("model").agg(F.round(F.sum(F.col("tin") / 1e6 * F.col("p_in") + F.col("tout") / 1e6 * F.col("p_out")), 6).alias("cost"))


@operator("budget_projection", "SELECT month, round(used, 4) AS used, round(used / days * month_days, 4) AS projected, CASE WHEN used >= 0.9 * 20000 THEN 'critical' WHEN used >= 0.7 * 20000 THEN 'warning' ELSE 'ok' END AS alert FROM (SELECT strftime(ts, '%Y-%m') AS month, sum(value) AS used, day(max(ts)) AS days, day(last_day(CAST(max(ts) AS DATE))) AS month_days FROM events GROUP BY 1)")
def budget_projection(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14: use so far carried on to the month's end."""
    m = events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("value").alias("used"), F.dayofmonth(F.max("ts")).alias("days"), F.dayofmonth(F.last_day(F.max("ts"))).alias("month_days"))
    return m.select("month", F.round("used", 4).alias("used"), F.round(F.col("used") / F.col("days") * F.col("month_days"), 4).alias("projected"), F.when(F.col("used") >= 0.9 * 20000, "critical").when(F.col("used") >= 0.7 * 20000, "warning").otherwise("ok").alias("alert"))


@operator("bands_zero_fill", "WITH b(band) AS (VALUES ('none'), ('low'), ('medium'), ('high'), ('extreme')), t AS (SELECT CASE WHEN value IS NULL THEN 'none' WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'medium' WHEN value < 100000 THEN 'high' ELSE 'extreme' END AS band FROM events) SELECT band, CAST(count(t.band) AS BIGINT) AS n FROM b LEFT JOIN t USING (band) GROUP BY band")
def bands_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15, SRT-06: bands with 0 where nothing falls."""
    band = F.when(F.col("value").isNull(), "none").when(F.col("value") < 25, "low").when(F.col("value") < 75, "medium").when(F.col("value") < 100000, "high").otherwise("extreme")
    counts = events(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    bands = spark.createDataFrame([(b,) for b in ("none", "low", "medium", "high", "extreme")], "band string")
    return bands.join(counts, "band", "left").na.fill(0)


@operator("calendar_spine", f"WITH {EVENTS_SQL}, s AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM range(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) t(d)) SELECT s.day, CAST(count(ev.day) AS BIGINT) AS n FROM s LEFT JOIN (SELECT day FROM ev WHERE event_type = 'error') ev ON ev.day = s.day GROUP BY s.day")
def calendar_spine(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-15: every day of a calendar, with 0 where nothing happened."""
    counts = events(spark, sf).filter("event_type = 'error'").groupBy("day").agg(F.count("*").alias("n"))
    days = spark.range(37).select(F.date_add(F.lit("2023-12-28").cast("date"), F.col("id").cast("int")).cast("string").alias("day"))
    return days.join(counts, "day", "left").na.fill(0)


@operator("top_users", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 3) AS error_pct FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_users(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17: the ten with most entries."""
    return top(events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("event_type") == "error") / F.count("*"), 3).alias("error_pct")), 10, F.desc("n"), F.col("user_id"))


@operator("keyword_counts", "SELECT role, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM conversations) GROUP BY ALL HAVING count(*) >= 3")
def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19: words by role."""
    return read(spark, sf, "conversations").select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("role", "word").agg(F.count("*").alias("n")).filter("n >= 3")


@operator("resolution_rate", "SELECT user_id, CAST(m AS BIGINT) AS misses, CAST(f AS BIGINT) AS failures, CASE WHEN m > 0 THEN round((m - f) / CAST(m AS DOUBLE), 3) ELSE 0.0 END AS resolved FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)")
def resolution_rate(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19: misses that didn't end as failures; negative where failures prevail."""
    t = events(spark, sf).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("misses"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return t.withColumn("resolved", F.when(F.col("misses") > 0, F.round((F.col("misses") - F.col("failures")) / F.col("misses"), 3)).otherwise(0.0))


@operator("json_path_group", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_path_group(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05, ARR-04: groups by a path into JSON."""
    return events(spark, sf).groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@operator("log_parse_variable_arity", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY event_type")
def log_parse_variable_arity(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-15, STR-26: lines of 4 to 6 fields read back by their arity."""
    ms = F.concat(F.round("value").cast("long").cast("string"), F.lit("ms"))
    line = F.concat_ws(" | ", F.col("ts").cast("string"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK"), F.when(F.col("event_id") % 2 == 0, F.lit("extra")), F.when(F.col("event_id") % 3 == 0, F.lit("question")), "event_type", ms)
    f = F.split("line", r" \| ")
    parsed = events(spark, sf).select(line.alias("line")).select(F.element_at(f, -2).alias("event_type"), F.coalesce(F.try_to_number(F.regexp_extract(F.element_at(f, -1), r"(\d+)ms", 1), F.lit("999999999")).cast("long"), F.lit(0)).alias("ms"), F.size(f).alias("arity"))
    return parsed.filter(F.col("arity").between(4, 6)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))


@operator("miss_classify", r"SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 'CONTENT_EMPTY' WHEN regexp_matches(text, '\d{1,2}/\d{1,2}') THEN 'DATE_FORMAT' WHEN regexp_matches(lower(text), '(folder|path)') THEN 'FOLDER_MISS' WHEN length(text) < 40 THEN 'KEYWORD_MISS' ELSE 'SEARCH_MISS' END AS category, regexp_matches(lower(text), '(today|yesterday|last week|\d+ (day|week|month)s? ago|20\d\d)') AS time_range FROM conversations")
def miss_classify(spark: SparkSession, sf: str) -> DataFrame:
    """STR-24/25, SRC-16: the first class that fits, and whether a time is meant."""
    t, low = F.col("text"), F.lower("text")
    category = F.when(F.length(t) == 0, "CONTENT_EMPTY").when(t.rlike(r"\d{1,2}/\d{1,2}"), "DATE_FORMAT").when(low.rlike("(folder|path)"), "FOLDER_MISS").when(F.length(t) < 40, "KEYWORD_MISS").otherwise("SEARCH_MISS")
    return read(spark, sf, "conversations").select("conv_id", "turn", category.alias("category"), low.rlike(r"(today|yesterday|last week|\d+ (day|week|month)s? ago|20\d\d)").alias("time_range"))


@operator("rolling_baseline_7", f"WITH {EVENTS_SQL}, d AS (SELECT day, avg(value) AS v FROM ev GROUP BY day), w AS (SELECT day, v, avg(v) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m, count(*) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n, lag(v) OVER (ORDER BY day) AS l FROM d) SELECT day, round(v, 6) AS v, round(CASE WHEN n >= 7 THEN m ELSE l END, 6) AS baseline FROM w")
def rolling_baseline_7(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-08/11, EVL-10: each day against the mean of the seven before; the window runs over days, not events."""
    d = events(spark, sf).groupBy("day").agg(F.avg("value").alias("v"))
    w = Window.orderBy("day")
    before = w.rowsBetween(-7, -1)
    return d.select("day", F.round("v", 6).alias("v"), F.round(F.when(F.count("*").over(before) >= 7, F.avg("v").over(before)).otherwise(F.lag("v").over(w)), 6).alias("baseline"))


@operator("session_averages", "SELECT role, CAST(count(*) AS BIGINT) AS sessions, round(avg(turns), 3) AS mean_turns, CAST(max(chars) AS BIGINT) AS longest FROM (SELECT conv_id, role, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY ALL) GROUP BY role")
def session_averages(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-13/33, SRC-21: means over sessions."""
    s = read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return s.groupBy("role").agg(F.count("*").alias("sessions"), F.round(F.avg("turns"), 3).alias("mean_turns"), F.max("chars").alias("longest"))
