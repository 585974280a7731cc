"""Readers of files and logs, each a declarative Spark read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.functions.text import normal_path


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC-08/10/11: path, normal path, size and time of the files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", normal_path(F.regexp_replace("path", "^[a-z]+:/+", "/")).alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def folder_counts(files: DataFrame, root_depth: int, depth: int) -> DataFrame:
    """SRC-12/13: files under each folder of a depth below the root."""
    parts = F.filter(F.split("key", "/"), lambda x: x != "")
    return files.select(F.slice(parts, root_depth + 1, depth).alias("p"), F.size(parts).alias("n")).filter(F.col("n") > root_depth + depth).groupBy(F.array_join("p", "/").alias("folder")).agg(F.count("*").alias("files"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15: pipe-delimited lines of seven, eight or nine fields; others are dropped.

    Fields: at, level, handler, user, query, [keyword, question,] result or error, [cache,] milliseconds.
    """
    f = F.split("value", r" \| ")
    n = F.size(f)
    nth = lambda i: F.element_at(f, i)
    tail = F.when(nth(-2).startswith("cache="), n - 2).otherwise(n - 1)
    lines = spark.read.text(path).filter(n.between(7, 9))
    outcome = F.get(f, tail - 1)
    return lines.select(
        F.try_to_timestamp(nth(1)).alias("at"), nth(2).alias("level"), nth(3).alias("handler"), F.regexp_replace(nth(4), "^user=", "").alias("user"), F.regexp_replace(nth(5), "^query=", "").alias("query"),
        F.when(outcome.startswith("error="), F.substring(outcome, 7, 1 << 20)).alias("error"), F.when(outcome.startswith("result="), F.substring(outcome, 8, 1 << 20)).alias("result"), milliseconds(nth(-1)).alias("ms"),
    )


def milliseconds(c: Column) -> Column:
    """STR-26: "7335ms" as a number, 0 for what isn't one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*(\d{1,15})\s*ms\s*$", 1).try_cast("long"), F.lit(0).cast("long"))


def miss_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16/17: lines of a fixed pattern; MISS is an older name of ALL_MISS."""
    pattern = r"^(\S+ \S+) \| (CACHE_MISS|ALL_MISS|MISS) \| user=([^|]*?) \| page=([^|]*?) \(id=(\d+)\) \| question=([^|]*?) \| stages=(.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    level = F.when(part(2) == "MISS", "ALL_MISS").otherwise(part(2))
    return lines.select(F.try_to_timestamp(part(1)).alias("at"), level.alias("level"), part(3).alias("user"), part(4).alias("page"), part(5).cast("long").alias("page_id"), part(6).alias("question"), part(7).alias("stages"))


def token_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: key=value fields of a usage log."""
    number = lambda k: F.regexp_extract("value", rf"\b{k}=(\d+)", 1).try_cast("long")
    f = F.split("value", r" \| ")
    return spark.read.text(path).filter(F.col("value").rlike(r"\btotal=\d+")).select(F.try_to_timestamp(F.get(f, F.lit(0))).alias("at"), F.get(f, F.lit(1)).alias("source"), number("in").alias("tokens_in"), number("out").alias("tokens_out"), number("total").alias("total"))


def since(df: DataFrame, column: str, span: str, now: str) -> DataFrame:
    """SRC-20: rows after a moment, given as 7d, 24h or a date."""
    at = F.lit(now).cast("timestamp")
    if span[-1:] in "dh" and span[:-1].isdigit():
        start = at - F.make_dt_interval(days=F.lit(int(span[:-1]) if span[-1] == "d" else 0), hours=F.lit(int(span[:-1]) if span[-1] == "h" else 0))
    else:
        start = F.lit(span).cast("timestamp")
    return df.filter(F.col(column) >= start)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-20/21: JSON lines of a given schema; a line that can't be read is kept whole in `corrupt`."""
    return spark.read.schema(f"{schema}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: enabled rules of a rule file, in order."""
    kind = "rules array<struct<id:string,keywords:array<string>,enabled:boolean>>"
    return spark.read.schema(kind).option("multiLine", "true").json(path).select(F.posexplode("rules").alias("place", "r")).filter(F.coalesce("r.enabled", F.lit(True))).select("place", "r.id", "r.keywords")


def tsv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """SRC-28: a table of tab-separated text: blank rows and columns without a value are left out, short rows filled up."""
    df = spark.read.option("sep", "\t").option("header", "true").option("encoding", encoding).option("ignoreTrailingWhiteSpace", "true").csv(path)
    filled = df.agg(*(F.count(F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))).alias(c) for c in df.columns)).first()
    return df.select(*(f"`{c}`" for c in df.columns if filled[c])).na.drop("all")


def tail(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """SRC-18: the last n rows of an order."""
    return df.orderBy(*order).limit(n)
