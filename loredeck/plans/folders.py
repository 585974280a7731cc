"""Build folders, paths and the choice of one file or page among many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.operators.places import placed
from loredeck.operators.ranking import first_rung
from loredeck.registry import operator
from loredeck.sources.tables import NODES_SQL, nodes, pages, read

#: Names of build folders by kind; a and b stand for numbers, d for month and day.
NAMES = [
    ("regular", "정규 {a},{b}차"), ("hotfix", "Hotfix {a}차"), ("hotfix", "hotfix #{a}~{b}"), ("range", "{a}-{b}차"), ("regular_delivery", "2025.01.10 정규 {a}차 전달"),
    ("hotfix_delivery", "2025.01.10 핫픽스 {a}차"), ("delivery", "2025.01.10 {a}-{b}차 전달"), ("build_suffix", "{a}차 빌드"), ("simple", "{a}차"),
    ("client_version", "1.0.{a} client"), ("qa", "QA/BVT"), ("status", "진행중"), ("unknown", "notes {a}"), ("unknown", "26{d}b"),
]
_NAMED = "replace(replace(replace(pattern, '{a}', a), '{b}', b), '{d}', d)"
_NUMBERS = "array_to_string(list_concat(CASE WHEN contains(pattern, '{a}') AND kind NOT IN ('client_version', 'unknown') THEN [a] ELSE [] END, CASE WHEN contains(pattern, '{b}') THEN [b] ELSE [] END), ',')"
BUILDS_SQL = f"""
kinds(k, kind, pattern) AS (VALUES {", ".join(f"({k}, '{kind}', '{p}')" for k, (kind, p) in enumerate(NAMES))}),
raw AS (SELECT o_orderkey AS folder_id, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS a, CAST(o_custkey % 4 + 1 AS VARCHAR) AS b, strftime(o_orderdate, '%m%d') AS d, kinds.*
        FROM orders JOIN kinds ON k = (o_orderkey + o_custkey) % {len(NAMES)}),
builds AS (SELECT folder_id, {_NAMED} AS folder, kind, {_NUMBERS} AS numbers, d FROM raw)"""


def builds(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as build folders with names of all kinds."""
    fixed = spark.createDataFrame([(k, p) for k, (_, p) in enumerate(NAMES)], "k int, pattern string")
    o = read(spark, sf, "orders").withColumn("k", ((F.col("o_orderkey") + F.col("o_custkey")) % len(NAMES)).cast("int"))
    name = F.col("pattern")
    for mark, value in (("{a}", (F.col("o_orderkey") % 5 + 1).cast("string")), ("{b}", (F.col("o_custkey") % 4 + 1).cast("string")), ("{d}", F.date_format("o_orderdate", "MMdd"))):
        name = F.replace(name, F.lit(mark), value)
    return o.join(F.broadcast(fixed), "k").select(F.col("o_orderkey").alias("folder_id"), name.alias("folder"))  # a fixed list


# Families of builds by their words, shapes of names (a 0 stands for any number) and kinds of dated folders.
FAMILIES = {"정규": "regular", "hotfix": "hotfix", "hotifx": "hotfix", "핫픽스": "hotfix"}
SHAPES = {"0차": "simple", "0-0차": "range", "0차 빌드": "build_suffix", "0차빌드": "build_suffix", "완료": "status", "진행": "status", "진행중": "status"}
SHAPES |= {word + tail: "hotfix" for word in ("hotfix", "hotifx") for tail in (" 0차", "#0", "#0~0", "#0-0")}
_DATED = r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}\s+"


def folder_kind(name: Column) -> Column:
    """FLT-17: a folder's kind, from its date, family word and shape."""
    dated, rest = name.rlike(_DATED + r"\S"), F.regexp_replace(name, _DATED, "")
    word = F.regexp_extract(F.lower(rest), "(" + "|".join(FAMILIES) + ")", 1)
    family = F.when(F.lower(rest).contains("핫픽스") | F.lower(rest).contains("hotfix"), "hotfix").when(rest.contains("정규"), "regular")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "[0-9]+", "0"), r"\s+", " "), " ?# ?", "#")
    named = F.element_at(F.create_map(*(F.lit(x) for pair in SHAPES.items() for x in pair)), shape)
    regular = (word == "정규") & shape.rlike("^정규 .+차$")
    version = shape.rlike(r"^0\.0\.0 .") & name.rlike(r"^[01]\.")
    of_date = F.when(family.isNull(), "delivery").otherwise(F.concat(family, F.lit("_delivery")))
    return F.when(dated, of_date).otherwise(
        F.when(regular, "regular").otherwise(F.coalesce(named, F.when(version, "client_version").when(name.startswith("QA"), "qa").otherwise("unknown")))
    )


def folder_numbers(name: Column) -> Column:
    """Build numbers of a folder, without those of its date; none where the kind has none."""
    bare = F.regexp_replace(name, _DATED, "")
    return F.when(folder_kind(name).isin("client_version", "qa", "status", "unknown"), F.array().cast("array<int>")).otherwise(
        F.transform(F.regexp_extract_all(bare, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    )


@operator("build_folder_kinds", f"WITH {BUILDS_SQL} SELECT folder_id, folder, kind, numbers FROM builds")
def build_folder_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-17: a folder's kind among twelve, and its numbers."""
    f = F.col("folder")
    return builds(spark, sf).select("folder_id", "folder", folder_kind(f).alias("kind"), F.array_join(folder_numbers(f), ",").alias("numbers"))


#: Builds asked for: kind, first and second number.
ASKED_BUILDS = [("range", 2, 1), ("hotfix", 2, None), ("regular", 3, None), ("simple", 2, None), ("any", None, None)]


def same_build(kind: Column, numbers: Column, asked: tuple[str, int | None, int | None]) -> Column:
    """Whether a folder is the build asked for: ranges by both numbers, hotfix and regular ones in their own families, others outside hotfixes."""
    want, first, second = asked
    has = F.array_contains(numbers, F.lit(first)) if first is not None else F.lit(True)
    return {
        "range": kind.isin("range", "delivery", "regular_delivery", "hotfix_delivery") & (numbers == F.array(F.lit(first), F.lit(second))),
        "hotfix": kind.isin("hotfix", "hotfix_delivery") & has,
        "regular": kind.isin("regular", "regular_delivery") & has,
        "simple": ~kind.isin("hotfix", "hotfix_delivery") & has,
        "any": F.lit(True),
    }[want]


@operator(
    "build_matching",
    f"""WITH {BUILDS_SQL}, q(asked, first, second) AS (VALUES ('range', '2', '1'), ('hotfix', '2', NULL), ('regular', '3', NULL), ('simple', '2', NULL), ('any', NULL, NULL))
SELECT asked, kind, count(*) AS folders FROM builds JOIN q ON CASE asked
  WHEN 'range' THEN kind IN ('range', 'delivery', 'regular_delivery', 'hotfix_delivery') AND numbers = concat(first, ',', second)
  WHEN 'hotfix' THEN kind IN ('hotfix', 'hotfix_delivery') AND list_contains(string_split(numbers, ','), first)
  WHEN 'regular' THEN kind IN ('regular', 'regular_delivery') AND list_contains(string_split(numbers, ','), first)
  WHEN 'simple' THEN kind NOT IN ('hotfix', 'hotfix_delivery') AND list_contains(string_split(numbers, ','), first)
  ELSE true END GROUP BY asked, kind""",
)
def build_matching(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-16: folders of each build asked for, by kind; one pass over the folders."""
    f = builds(spark, sf).select(folder_kind(F.col("folder")).alias("kind"), folder_numbers(F.col("folder")).alias("numbers"))
    asked = F.filter(F.array(*(F.when(same_build(F.col("kind"), F.col("numbers"), a), F.lit(a[0])) for a in ASKED_BUILDS)), lambda x: x.isNotNull())
    return f.select("kind", F.explode(asked).alias("asked")).groupBy("asked", "kind").agg(F.count("*").alias("folders"))


@operator("folder_month_day", f"WITH {BUILDS_SQL} SELECT folder_id, CASE WHEN ends_with(folder, 'b') AND starts_with(folder, '26') THEN d END AS mmdd FROM builds WHERE kind = 'unknown'")
def folder_month_day(spark: SparkSession, sf: str) -> DataFrame:
    """DT-06: month and day of folders named by a date of six or eight digits and a letter."""
    f = builds(spark, sf).filter(folder_kind(F.col("folder")) == "unknown")
    mmdd = F.regexp_extract("folder", r"^(?:20)?[0-9]{2}([0-9]{4})[a-z]?(?:\s.*)?$", 1)
    return f.select("folder_id", F.when(mmdd != "", mmdd).alias("mmdd"))


@operator(
    "taxonomy_search",
    f"WITH {BUILDS_SQL} SELECT l_linenumber AS line, count(*) AS files, count(DISTINCT folder_id) AS folders FROM builds JOIN lineitem ON l_orderkey = folder_id WHERE kind = 'regular' AND list_contains(string_split(numbers, ','), '3') GROUP BY l_linenumber",
)
def taxonomy_search(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-15: folders of the build asked for, then their files."""
    f = builds(spark, sf)
    chosen = f.filter(same_build(folder_kind(F.col("folder")), folder_numbers(F.col("folder")), ("regular", 3, None)) & (folder_kind(F.col("folder")) == "regular")).select("folder_id")
    files = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"))
    return files.join(chosen, files.l_orderkey == chosen.folder_id).groupBy("line").agg(F.count("*").alias("files"), F.countDistinct("folder_id").alias("folders"))


@operator("tree_listing", f"WITH {NODES_SQL} SELECT row_number() OVER (PARTITION BY space_key ORDER BY title, node_id) AS place, space_key, node_id, title FROM nodes")
def tree_listing(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-04: every node in the order of path and title, numbered within its space."""
    n = nodes(spark, sf).select("space_key", "title", "node_id")
    return placed(n, ["title", "node_id"], within="space_key")


@operator("title_substring", f"WITH {NODES_SQL} SELECT space_key, min(node_id) AS node_id, count(*) AS hits FROM nodes WHERE contains(title, 'tion') GROUP BY space_key")
def title_substring(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-35: the first node whose title holds a text."""
    hit = nodes(spark, sf).filter(F.col("title").contains("tion"))
    return hit.groupBy("space_key").agg(F.min("node_id").alias("node_id"), F.count("*").alias("hits"))


_HINT = "/de/2"
_LCP = "len(list_filter(range(1, least(length(url), length('{h}')) + 1), lambda i: left(url, i) = left('{h}', i)))".format(h="https://www.example")


@operator(
    "best_file",
    f"""WITH c AS (SELECT page_id, lower(replace(coalesce(url, ''), chr(92), '/')) AS url, page_id % 7 AS name FROM pages),
s AS (SELECT *, ends_with(url, '{_HINT}') AS exact, {_LCP} AS shared FROM c)
SELECT name, arg_min(page_id, (CASE WHEN exact THEN 0 ELSE 1 END, CASE WHEN exact THEN 0 ELSE -shared END, page_id)) AS page_id,
  CASE WHEN bool_or(exact) THEN 'exact_path' ELSE 'longest_prefix' END AS reason FROM s GROUP BY name""",
)
def best_file(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-09: among files of one name the one whose path ends in the hint, else the one that shares the longest beginning with it."""
    url = F.lower(F.replace(F.coalesce("url", F.lit("")), F.lit("\\"), F.lit("/")))
    hint = "https://www.example"
    shared = sum((url.startswith(hint[:k]).cast("int") for k in range(1, len(hint) + 1)), F.lit(0))
    exact = url.endswith(_HINT)
    rank = F.struct(F.when(exact, 0).otherwise(1), F.when(exact, 0).otherwise(-shared), F.col("page_id"))
    c = pages(spark, sf).select("page_id", (F.col("page_id") % 7).alias("name"), exact.alias("exact"), rank.alias("rank"))
    return c.groupBy("name").agg(F.min_by("page_id", "rank").alias("page_id"), F.when(F.bool_or("exact"), "exact_path").otherwise("longest_prefix").alias("reason"))


@operator(
    "year_preference",
    f"WITH {NODES_SQL}, c AS (SELECT node_id, space_key, concat(left(title, 12), CASE WHEN node_id % 9 = 4 THEN ' 2024' ELSE '' END) AS title FROM nodes) SELECT space_key, arg_min(node_id, (CASE WHEN contains(title, '2024') THEN 0 ELSE 1 END, node_id)) AS node_id, bool_or(contains(title, '2024')) AS year_in_title FROM c GROUP BY space_key",
)
def year_preference(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-10: the first hit with the year in its title, else the first hit."""
    title = F.concat(F.substring("title", 1, 12), F.when(F.col("node_id") % 9 == 4, " 2024").otherwise(""))
    c = nodes(spark, sf).select("node_id", "space_key", title.contains("2024").alias("dated"))
    return c.groupBy("space_key").agg(F.min_by("node_id", F.struct(~F.col("dated"), F.col("node_id"))).alias("node_id"), F.bool_or("dated").alias("year_in_title"))


_PATHS = "paths AS (SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
#: A path as it is asked for: region, nation, a text in the leaf's name.
ASIA, CHINA, LEAF = "ASIA", "CHINA", "77"


@operator(
    "path_search",
    f"""WITH {_PATHS}, leaf AS (SELECT *, CASE WHEN n_name = '{CHINA}' AND r_name = '{ASIA}' THEN 0 WHEN n_name = '{CHINA}' THEN 1 WHEN r_name = '{ASIA}' THEN 2 ELSE 3 END AS own FROM paths WHERE contains(c_name, '{LEAF}')),
u AS (SELECT c_custkey, 0 AS level FROM leaf WHERE own = 0 UNION ALL SELECT c_custkey, 1 FROM leaf WHERE n_name = '{CHINA}' UNION ALL SELECT c_custkey, 2 FROM leaf WHERE r_name = '{ASIA}' UNION ALL SELECT c_custkey, 3 FROM leaf)
SELECT c_custkey, level FROM u WHERE level = (SELECT min(level) FROM u)""",
)
def path_search(spark: SparkSession, sf: str) -> DataFrame:
    """FTS-12: leaves by title under all ancestors of a path, then under the nearest one, then under the farthest, then by title alone."""
    asked = F.split(F.lit(f"{ASIA} > {CHINA} > {LEAF}"), r"\s*>\s*")
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    leaf = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).filter(F.col("c_name").contains(F.get(asked, F.lit(2))))
    far, near = F.col("r_name") == F.get(asked, F.lit(0)), F.col("n_name") == F.get(asked, F.lit(1))
    return first_rung(leaf, [far & near, near, far, F.lit(True)]).select("c_custkey", "level")


@operator(
    "title_words",
    f"""WITH {NODES_SQL}, t AS (SELECT node_id, space_key, regexp_replace(concat('@@@hl@@@', replace(title, ' ', '@@@endhl@@@ ')), '@@@(end)?hl@@@', '', 'g') AS title FROM nodes)
SELECT space_key, count(*) AS titles, sum(len(list_filter(regexp_extract_all(title, '[A-Z][a-z]+|[a-z]+|[가-힣]+|[0-9]+'), lambda w: length(w) >= 2))) AS words FROM t GROUP BY space_key""",
)
def title_words(spark: SparkSession, sf: str) -> DataFrame:
    """STR-18/19: titles without highlight marks, cut at changes of case and script; words of one character don't count."""
    marked = F.concat(F.lit("@@@hl@@@"), F.replace("title", F.lit(" "), F.lit("@@@endhl@@@ ")))
    words = F.regexp_extract_all(F.regexp_replace(marked, "@@@(?:end)?hl@@@", ""), F.lit("[A-Z][a-z]+|[a-z]+|[가-힣]+|[0-9]+"), F.lit(0))
    n = nodes(spark, sf).select("space_key", F.size(F.filter(words, lambda w: F.length(w) >= 2)).alias("n"))
    return n.groupBy("space_key").agg(F.count("*").alias("titles"), F.sum("n").alias("words"))
