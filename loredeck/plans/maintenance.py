"""Incremental ingestion: upserts, deltas, expiry, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.operators.merge import cache_status, delta, latest, upsert
from loredeck.registry import operator
from loredeck.sources.tables import events, pages, read


@operator("upsert_latest_wins", "SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS price FROM orders GROUP BY o_custkey")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-01/07/08: of several changes of a key the last one stays."""
    return latest(read(spark, sf, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last_order"), F.round("o_totalprice", 2).alias("price"))


@operator("upsert_merge", "SELECT coalesce(c.c_custkey, s.s_suppkey) AS k, coalesce(s.s_name, c.c_name) AS name, round(coalesce(CASE WHEN s.s_acctbal > 0 THEN s.s_acctbal END, c.c_acctbal), 2) AS balance FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-01/02/14: changes laid over a table, nulls keep the old value."""
    target = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    changes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return upsert(target, changes, ["k"]).withColumn("balance", F.round("balance", 2))


@operator("delta_by_watermark", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND ts < '2024-01-20')")
def delta_by_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """STM-01/02: rows after the last success."""
    e = events(spark, sf)
    return delta(e, "ts", e.filter("event_type = 'purchase' and ts < timestamp_ntz'2024-01-20'").agg(F.max("ts").alias("mark"))).select("event_id")


@operator("delta_by_absence", "SELECT l_partkey AS k, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def delta_by_absence(spark: SparkSession, sf: str) -> DataFrame:
    """STM-03/13, REM-12: keys not there yet."""
    there = read(spark, sf, "part").filter("p_size > 10")
    li = read(spark, sf, "lineitem")
    return li.join(there, li.l_partkey == there.p_partkey, "left_anti").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))


_AGE = "date_diff('second', m, TIMESTAMP '2024-01-31 00:00:00')"


@operator("ttl_status", f"SELECT user_id, CASE WHEN {_AGE} < 20000 THEN 'HIT_MEM' WHEN {_AGE} >= CASE WHEN user_id % 4 = 0 THEN 86400 WHEN user_id % 4 = 1 THEN 0 ELSE 172800 END THEN 'MISS_STALE' ELSE 'HIT_DB' END AS status FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY user_id)")
def ttl_status(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-34, DT-08, STM-08: fresh, stored or stale by age and policy."""
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))
    ttl = F.when(F.col("user_id") % 4 == 1, 0).when(F.col("user_id") % 4 >= 2, 172_800)
    return events(spark, sf).groupBy("user_id").agg(age.alias("age")).select("user_id", cache_status(F.col("age"), 20_000, ttl).alias("status"))


@operator("ttl_policy", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(today|now|latest|20\d\d)') THEN 'TIME_BOUNDED' WHEN length(text) > 400 THEN 'STATIC' ELSE 'NORMAL' END AS class FROM conversations")
def ttl_policy(spark: SparkSession, sf: str) -> DataFrame:
    """DT-09: the class of a query, which sets how long its result is kept."""
    return read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.lower("text").rlike(r"(today|now|latest|20\d\d)"), "TIME_BOUNDED").when(F.length("text") > 400, "STATIC").otherwise("NORMAL").alias("class"))


@operator("expired_cascade", "SELECT o_orderkey, CAST(count(l_linenumber) AS BIGINT) AS children FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < '1995-03-01' GROUP BY o_orderkey")
def expired_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-15/16, JOIN-08: expired rows with the children that go with them."""
    o, li = read(spark, sf, "orders").filter("o_orderdate < timestamp_ntz'1995-03-01'"), read(spark, sf, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey").agg(F.count("l_linenumber").alias("children"))


@operator("keep_newest_three", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 3")
def keep_newest_three(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-17: what rotation removes beyond the newest three."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).filter("rn > 3").select("o_custkey", "o_orderkey")


@operator("sync_decision", "SELECT source, CAST(count(*) AS BIGINT) AS scanned, CASE WHEN count(l.doc_id) = 0 THEN 'full' WHEN count(*) % 50 = 0 THEN 'full' ELSE 'delta' END AS mode FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def sync_decision(spark: SparkSession, sf: str) -> DataFrame:
    """STM-04/05: full or delta ingestion of each source."""
    d, labels = read(spark, sf, "documents"), read(spark, sf, "labels").select(F.col("doc_id").alias("known"))
    t = d.join(labels, d.doc_id == labels.known, "left").groupBy("source").agg(F.count("*").alias("scanned"), F.count("known").alias("k"))
    return t.select("source", "scanned", F.when((F.col("k") == 0) | (F.col("scanned") % 50 == 0), "full").otherwise("delta").alias("mode"))


@operator("catalog_union_dedupe", "SELECT page_id, min(probe) AS probe FROM (SELECT page_id, 'en' AS probe FROM pages WHERE contains(url, '/en/') UNION ALL SELECT page_id, 'www' FROM pages WHERE contains(url, 'www.') UNION ALL SELECT page_id, 'html' FROM pages WHERE contains(url, '.html')) GROUP BY page_id")
def catalog_union_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-23, SET-05/06: union of probes, once a key."""
    p = pages(spark, sf)
    probes = [p.filter(F.col("url").contains(k)).select("page_id", F.lit(n).alias("probe")) for n, k in (("en", "/en/"), ("www", "www."), ("html", ".html"))]
    return probes[0].unionByName(probes[1]).unionByName(probes[2]).groupBy("page_id").agg(F.min("probe").alias("probe"))


@operator("index_export", "SELECT d.doc_id, CAST(to_json({'id': d.doc_id, 'source': source, 'chars': n_chars, 'quality': quality}) AS VARCHAR) AS record FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def index_export(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-19/22: records merged and written as JSON."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels").filter("quality is not null"), "doc_id")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("chars"), "quality")).alias("record"))
