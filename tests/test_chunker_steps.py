"""Lines and blanks of the chunker: what is stripped, and no pattern run over every line."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loredeck.functions.chunker import line_kind, runs, stripped


@pytest.mark.parametrize("text", ["", " \n", "abc  ", "\x0b\f abc\t\r\n", " a \u0085 ", " a ", "a  b"])
def test_stripped_equals_the_trim_of_the_sql(spark, text):
    want = duckdb.execute("select trim(?, concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11)))", [text]).fetchone()[0]
    assert spark.createDataFrame([(text,)], "t string").select(stripped(F.col("t"))).first()[0] == want


def test_kinds_of_lines(spark):
    lines = {"| a | b |": "R", " || ": "R", "|": "x", "|---|": "S", "| --- ": "x", "## Sheet: a": "H", "## Slide 3 ": "H", "## Slide x": "x", "text | more": "x", " ## Sheet: a": "x", "": "x"}
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert {r.t: r.kind for r in df.select("t", line_kind(F.col("t")).alias("kind")).collect()} == lines
    assert "regexp_replace" not in str(line_kind(F.col("t"))._jc)


def test_runs_are_placed_by_one_running_sum(spark):
    df = spark.range(1).select(F.split(F.lit("a,b,c,d,e"), ",").alias("items"), F.lit("xHxHx").alias("kinds"))
    found = runs(F.col("items"), F.col("kinds"), "Hx*|x+")
    assert [(r["kinds"], r["items"]) for r in df.select(found.alias("r")).first().r] == [("x", ["a"]), ("Hx", ["b", "c"]), ("Hx", ["d", "e"])]
    assert "array_join" not in str(found._jc)
