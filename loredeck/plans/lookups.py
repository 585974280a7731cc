"""Lookups, trees, joins and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.functions.text import normal_path
from loredeck.operators.trees import descendants
from loredeck.registry import operator
from loredeck.sources.shared import shared_folder
from loredeck.sources.tables import NODES_SQL, nodes, pages, read


@operator("title_lookup_nocase", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = (SELECT lower(min(p_name)) FROM part) OR lower(p_brand) = 'brand#11'")
def title_lookup_nocase(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-02/03: point and case-insensitive scans."""
    part = read(spark, sf, "part")
    least = part.agg(F.min("p_name").alias("least"))
    return part.join(F.broadcast(least), (F.lower("p_name") == F.lower("least")) | F.expr("collate(p_brand, 'UTF8_LCASE') = 'bRAND#11'")).select("p_partkey", "p_name")


@operator("tree_children", "SELECT r.r_name AS parent, n.n_name AS child, CAST(count(*) OVER (PARTITION BY r.r_regionkey) AS BIGINT) AS siblings FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def tree_children(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-09: children of a node with the number of their siblings."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.count("*").over(Window.partitionBy("r_regionkey")).alias("siblings"))


_EDGES = "SELECT concat('n', n_nationkey) AS id, concat('r', n_regionkey) AS parent FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier"


@operator("descendants_recursive", f"WITH RECURSIVE edges AS ({_EDGES}), tree(root, id, depth) AS (SELECT concat('r', r_regionkey), concat('r', r_regionkey), 0 FROM region UNION ALL SELECT t.root, e.id, t.depth + 1 FROM tree t JOIN edges e ON e.parent = t.id) SELECT root, CAST(depth AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n FROM tree GROUP BY ALL")
def descendants_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-14: all descendants, level by level until there are none."""
    id_of = lambda t, c, p, q: read(spark, sf, t).select(F.concat(F.lit(p), F.col(c[0]).cast("string")).alias("id"), F.concat(F.lit(q), F.col(c[1]).cast("string")).alias("parent"))
    edges = id_of("nation", ("n_nationkey", "n_regionkey"), "n", "r").unionByName(id_of("customer", ("c_custkey", "c_nationkey"), "c", "n")).unionByName(id_of("supplier", ("s_suppkey", "s_nationkey"), "s", "n"))
    roots = read(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    found = descendants(edges, roots, f"{shared_folder(spark)}/loredeck-tree-{uuid.uuid4().hex}")
    return found.groupBy("root", "depth").agg(F.count("*").alias("n"))


@operator("latest_descendant", "SELECT c_nationkey AS root, max(o_orderdate)::VARCHAR[:10] AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey".replace("max(o_orderdate)::VARCHAR[:10]", "strftime(max(o_orderdate), '%Y-%m-%d')"))
def latest_descendant(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-14, WIN-04: the newest leaf under each node."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("root")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"))


@operator("node_assembly", f"WITH {NODES_SQL} SELECT node_id, title, quality, length(body) AS chars FROM nodes LEFT JOIN labels ON node_id = doc_id WHERE lang = 'de'")
def node_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-05, JOIN-03: a node with its optional one-to-one records."""
    n = nodes(spark, sf).filter("lang = 'de'")
    labels = read(spark, sf, "labels")
    return n.join(labels, n.node_id == labels.doc_id, "left").select("node_id", "title", "quality", F.length("body").cast("long").alias("chars"))


@operator("path_prefix_lookup", "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.') OR url LIKE 'http://www.%/de/%'")
def path_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-04/34: prefix (pushed to the scan) and ordered segments."""
    return pages(spark, sf).filter(F.col("url").startswith("https://m.") | F.col("url").like("http://www.%/de/%")).select("page_id", "url")


@operator("breadcrumb_path", "SELECT page_id, array_to_string(list_filter(str_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> ''), ' > ') AS crumbs, CAST(len(list_filter(str_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM pages")
def breadcrumb_path(spark: SparkSession, sf: str) -> DataFrame:
    """STR-20/21: path segments as a breadcrumb."""
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda x: x != "")
    return pages(spark, sf).select("page_id", F.array_join(parts, " > ").alias("crumbs"), F.size(parts).alias("depth"))


@operator("missing_content_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_content_anti(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-04, STM-12: nodes without their record."""
    return read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@operator("orphan_roots", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def orphan_roots(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-05: nodes that nothing of a kind refers to."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@operator("index_coverage", "SELECT source, CAST(count(*) AS BIGINT) AS eligible, CAST(count(l.doc_id) AS BIGINT) AS covered, round(100.0 * count(l.doc_id) / count(*), 1) AS pct FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars >= 50 GROUP BY source")
def index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-06, AGG-26: share of eligible nodes in the index."""
    d, labels = read(spark, sf, "documents").filter("n_chars >= 50"), read(spark, sf, "labels").select(F.col("doc_id").alias("indexed"))
    return d.join(labels, d.doc_id == labels.indexed, "left").groupBy("source").agg(F.count("*").alias("eligible"), F.count("indexed").alias("covered"), F.round(100.0 * F.count("indexed") / F.count("*"), 1).alias("pct"))


@operator("inventory_full_outer_diff", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT p_partkey AS k FROM part WHERE p_size < 25) SELECT CASE WHEN b.k IS NULL THEN 'left only' WHEN a.k IS NULL THEN 'right only' ELSE 'both' END AS side, CAST(count(*) AS BIGINT) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def inventory_full_outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-12, SET-02: two inventories compared."""
    a = read(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("a")).distinct()
    b = read(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("b"))
    side = F.when(F.col("b").isNull(), "left only").when(F.col("a").isNull(), "right only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@operator("duplicate_paths", "SELECT host, CAST(count(*) AS BIGINT) AS n, min(page_id) AS kept FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host HAVING count(*) > 1")
def duplicate_paths(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-12, SNK-08: the lowest id of each repeated key."""
    return pages(spark, sf).groupBy(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("kept")).filter("n > 1")


@operator("body_audit_union", "SELECT doc_id, 'short' AS problem FROM documents WHERE length(text) < 300 UNION ALL SELECT doc_id, 'unlabelled' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND length(text) >= 5000")
def body_audit_union(spark: SparkSession, sf: str) -> DataFrame:
    """SET-01, AGG-24: problem rows of several kinds together."""
    d = read(spark, sf, "documents")
    short = d.filter(F.length("text") < 300).select("doc_id", F.lit("short").alias("problem"))
    bare = d.filter(F.length("text") >= 5000).join(read(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("problem"))
    return short.unionByName(bare)


@operator("related_same_group", "WITH t AS (SELECT p_partkey, p_brand, p_size FROM part), g AS (SELECT p_brand, p_size, count(*) AS n FROM t GROUP BY ALL) SELECT p_partkey, CAST(n - 1 AS BIGINT) AS related FROM t JOIN g USING (p_brand, p_size)")
def related_same_group(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-09: others of the same group, counted rather than paired."""
    return read(spark, sf, "part").select("p_partkey", (F.count("*").over(Window.partitionBy("p_brand", "p_size")) - 1).alias("related"))


@operator("taxonomy_prefix_join", r"SELECT host, lang_folder, CAST(count(*) AS BIGINT) AS files FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]+)/', 1) AS lang_folder FROM pages) GROUP BY ALL")
def taxonomy_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-10, SRC-12/13, AGG-06: files under each folder; the prefix is a key, so no theta join."""
    return pages(spark, sf).groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([a-z]+)/", 1).alias("lang_folder")).agg(F.count("*").alias("files"))


@operator("normalised_paths", r"SELECT page_id, lower(regexp_replace(regexp_replace(url, '[\\/]+', '/', 'g'), '/$', '')) AS path FROM pages")
def normalised_paths(spark: SparkSession, sf: str) -> DataFrame:
    """STR-22, SRC-11: one spelling of a path."""
    return pages(spark, sf).select("page_id", normal_path(F.col("url")).alias("path"))


@operator("build_meta_axis", "SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n, CAST(max(p_size) AS INTEGER) AS newest FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND (p_size = 10 OR p_size IS NULL OR p_size > 30) GROUP BY ALL")
def build_meta_axis(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-05/32/33: equality axes, IN lists and tolerance of nulls."""
    p = read(spark, sf, "part")
    return p.filter(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & ((F.col("p_size") == 10) | F.col("p_size").isNull() | (F.col("p_size") > 30))).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("newest"))
