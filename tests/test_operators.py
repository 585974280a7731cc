"""Operators on small inline rows."""

import dataclasses
import os

import pytest
from pyspark.sql import functions as F

from loredeck.functions import markup
from loredeck.functions.text import content_hash, escape_like, guarded_csv, log_field, normal_path, occurrences, strip_html
from loredeck.operators.intent import Intent, compile_intent, issue_filter, parse_issue_query
from loredeck.operators.measures import at_places, exclusive_quantile, floor_quantile, percent
from loredeck.operators.merge import cache_status, delta, upsert
from loredeck.operators.ranking import best_per, bm25, first_rung, ladder, weighted
from loredeck.operators.schedule import fires
from loredeck.operators.trees import descendants
from loredeck.plans.audits import clean_chunk
from loredeck.plans.textops import nearly_equal, typo_ratio
from loredeck.streaming.counters import finished


def values(df, column):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(("text", "pattern"), [("a%b", "a\\%b"), ("a_b", "a\\_b"), ("a\\b", "a\\\\b"), ("ab", "ab")])
def test_escape_like(text, pattern):
    assert escape_like(text) == pattern


def test_bm25_prefers_the_shorter_text_and_needs_all_keywords(spark):
    df = spark.createDataFrame([(1, "apple pie", "x"), (2, "apple pie " + "filler " * 30, "x"), (3, "apple", None), (4, None, None), (5, "x", "y"), (6, "z", "y")], "id int, title string, body string")
    hits = bm25(df, ["apple", "pie"], ["title", "body"]).orderBy(F.desc("relevance"))
    assert values(hits, "id") == [1, 2]


def test_ladder_takes_the_first_level_with_rows(spark):
    a, b = spark.createDataFrame([], "k int, v int"), spark.createDataFrame([(1, 2)], "k int, v int")
    assert [tuple(r) for r in ladder([a, b, b]).collect()] == [(1, 2, 1)]
    c = spark.createDataFrame([(2, 3)], "k int, v int")
    assert sorted((r.k, r.level) for r in ladder([c, b.union(c)], "k").collect()) == [(1, 1), (2, 0)]


def test_intent_is_not_changed_by_relaxing(spark):
    intent = Intent(title_keywords=("pie",), body_keywords=("none",), space="s")
    relaxed = dataclasses.replace(intent, body_keywords=())
    assert intent.body_keywords == ("none",)
    df = spark.createDataFrame([("Pie", "b", "s"), ("Pie", "b", "t")], "title string, body string, space_key string")
    assert df.filter(compile_intent(intent)).count() == 0
    assert df.filter(compile_intent(relaxed)).count() == 1


def test_issue_query(spark):
    df = spark.sql("select 1 id, 'P' status, timestamp_ntz'2024-01-31 10:00:00' updated, null assignee union all select 2, 'F', timestamp_ntz'2023-12-31 23:00:00', 'Ann'")
    for text, want in [("status = P", [1]), ("status NOT IN (P, X) ORDER BY updated", [2]), ("updated >= startOfMonth(0)", [1]), ("updated >= -7d AND assignee IS EMPTY", [1]), ("assignee ~ an", [2]), ("updated < startOfYear()", [2])]:
        assert values(df.filter(issue_filter(parse_issue_query(text), "2024-01-31")), "id") == want, text
    with pytest.raises(ValueError):
        parse_issue_query("status")


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 5.0), ("b", 7.0)], "k string, v double")
    assert {r.k: r.q for r in floor_quantile(df, "k", "v", 0.99, "q").collect()} == {"a": 100.0, "b": 7.0}
    assert {r.k: round(r.q, 6) for r in exclusive_quantile(df, "k", "v", 19, 20, "q").collect()} == {"a": 95.95, "b": 7.0}
    assert spark.range(1).select(percent(F.lit(1), F.lit(0)).alias("p")).first().p == 0.0


def test_upsert_keeps_old_values_for_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k int, name string, x double")
    assert sorted((tuple(r) for r in upsert(old, new, ["k"]).collect()), key=str) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)]


def test_delta_without_watermark_is_everything(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "id int, t int")
    mark = spark.createDataFrame([(10,)], "m int")
    assert values(delta(df, "t", mark), "id") == [2]
    assert delta(df, "t", spark.createDataFrame([(None,)], "m int")).count() == 2


def test_cache_status(spark):
    df = spark.createDataFrame([(1, 10, None), (2, 400, None), (3, 90_000, None), (4, 400, 0), (5, None, None)], "id int, age int, ttl int")
    got = {r.id: r.s for r in df.select("id", cache_status(F.col("age"), 300, F.col("ttl")).alias("s")).collect()}
    assert got == {1: "HIT_MEM", 2: "HIT_DB", 3: "MISS_STALE", 4: "MISS_STALE", 5: "MISS"}


def test_schedules(spark):
    plans = [("nth", "nth_weekday", 0, [1, 3], None, None), ("last", "last_weekday", 4, None, None, None), ("q", "quarterly", None, None, None, None), ("none", "specific", None, None, None, None)]
    p = spark.createDataFrame(plans, "id string, kind string, weekday int, ordinals array<int>, interval int, start string")
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-31')) d")
    got = {(r.id, str(r.d)[-2:]) for r in days.join(p, fires(F.col("d"))).collect()}
    assert got == {("nth", "01"), ("nth", "15"), ("last", "26"), ("q", "01")}


def test_weights_and_best(spark):
    df = spark.createDataFrame([(1, "planning", "table", 1.0), (1, "planning", "other", 1.2), (2, None, "table", None)], "n int, folder_role string, chunk_origin string, relevance double")
    best = best_per(weighted(df), "n", F.desc("score"))
    assert {r.n: r.score for r in best.collect()} == {1: 1.4, 2: 0.0}


def test_text_functions(spark):
    df = spark.createDataFrame([("=a|b\n", "A\\\\B//c/", "")], "a string, p string, e string")
    r = df.select(guarded_csv(F.col("a")).alias("g"), log_field(F.col("a")).alias("l"), normal_path(F.col("p")).alias("n"), content_hash("e").alias("h"), occurrences("p", "b").alias("o")).first()
    assert (r.g, r.l, r.n, r.h, r.o) == ("'=a|b\n", "=a｜b ", "a/b/c", None, 1)
    h = spark.createDataFrame([("<style>x</style><p>a &amp; b</p><td>c</td>",), (None,)], "h string")
    assert values(h.select(strip_html("h").alias("t")), "t") == ["a & b\nc |", None]


def test_markup():
    assert markup.to_markdown("<h2>T</h2><nav>no</nav><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table>") == "## T\n\n- a\n- b\n\n| 1 | 2 |"
    assert markup.ratio("abcd", "abce") == 0.75


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_stream_results_are_files_not_rows_of_the_driver(spark, tmp_path, mode):
    source = spark.range(30).selectExpr("id % 7 AS k").repartition(3)
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.dropDuplicates(["k"]) if mode == "append" else stream.groupBy("k").agg(F.count("*").alias("n"))
    got = finished(stream, str(tmp_path / "state"), mode)
    assert got.columns == stream.columns and got.inputFiles()
    want = [(k,) if mode == "append" else (k, 5 if k < 2 else 4) for k in range(7)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_nearly_equal_names_equal_brute_force(spark):
    parts = [(1, "a", "cold widget"), (2, "a", "old widget"), (3, "a", "cold widget"), (4, "a", "dark pipe"), (5, "a", "qold widgets"), (6, "b", "cold widget"), (7, "b", None), (8, None, "ring"), (9, None, "wring"), (10, "c", "bolt"), (11, "c", "bolt"), (12, "a", "")]
    want = {}
    for key, brand, name in parts:
        near = [markup.ratio(name, o) for _, b, o in parts if b == brand and None not in (name, o) and name != o]
        if max(near, default=0) >= 0.6:
            want[key] = max(near)
    got = nearly_equal(spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string")).collect()
    assert {r.p_partkey: r.ratio for r in got} == want and len(got) == len(want) and set(want) == {1, 2, 3, 5, 8, 9}


def test_typo_ratio_equals_brute_force(spark):
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    parts = [(r.p_partkey, r.p_brand, r.p_name) for r in spark.read.parquet(f"{at}/part.parquet").collect()]
    best = {k: max((markup.ratio(n, o) for _, b, o in parts if b == brand and o != n), default=0.0) for k, brand, n in parts}
    assert {r.p_partkey: r.ratio for r in typo_ratio(spark, at).collect()} == {k: x for k, x in best.items() if x >= 0.6}


def test_descendants_of_a_graph_with_a_cycle(spark, tmp_path):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("d", "a"), ("y", "x")], "id string, parent string")
    roots = spark.createDataFrame([("a",), ("x",), ("z",)], "root string")
    got = sorted(tuple(r) for r in descendants(edges, roots, str(tmp_path / "tree")).collect())
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("x", "x", 0), ("x", "y", 1), ("z", "z", 0)]


def test_quantiles_with_values_far_out(spark):
    far = [1e-9, 0.0, -5.0, -1e300, 1e300, float("inf"), float("-inf"), float("nan")]
    values_ = [float(i % 97) + 0.5 for i in range(2000)] + far
    df = spark.createDataFrame([("a", v) for v in values_], "k string, v double")
    order = sorted(v for v in values_ if v == v) + [float("nan")]
    got = at_places(df, "k", "v", [lambda n, p=p: F.lit(p) for p in (0, 1, 2, 4, 1000, 1999, 2005, 2006)]).first()
    assert [got[f"v{k}"] for k in range(8)] == [order[p] for p in (0, 1, 2, 4, 1000, 1999, 2005, 2006)] and got.n == 2008


def test_first_rung_is_one_pass_over_the_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1), (4, "b", 4), (5, None, 0)], "id int, k string, v int")
    rungs = [F.col("v") > 9, F.col("v") > 3, F.col("v") >= 0]
    assert sorted((r.id, r.level) for r in first_rung(df, rungs).collect()) == [(1, 1), (4, 1)]
    by_key = first_rung(df, [F.col("v") > 4, F.col("v") > 0, F.lit(True)], "k")
    assert sorted((r.id, r.level) for r in by_key.collect()) == [(1, 0), (3, 1), (4, 1), (5, 2)]
    assert first_rung(df, [F.lit(False)]).count() == 0 and first_rung(df, [F.lit(None).cast("boolean"), F.col("v") > 3]).count() == 2


def test_clean_chunk(spark):
    cases = {
        "index_mode: generic_tsv\nfile_type: a.tsv\ncontent_type: generic_tsv\nid: 1\n": "id: 1",
        "Mode: generic_pptx > FileType: a > b.pptx > ContentType: generic_pptx > Slide: 3 > Title > more\n### Notes: ": "[Slide 3] Title > more",
        "Mode: generic_pptx > FileType: a.pptx > ContentType: generic_pptx > Slide: 3 > T\n### Notes: kept": "[Slide 3] T\n### Notes: kept",
        "Mode: generic_xlsx > FileType: a.xlsx > Sheet: Main > Row: 7 > id: 1 > b: 2 ": "[Main] id: 1 > b: 2", "Mode: generic_xlsx > Row: 7 > id: 1": "[] id: 1",
        "Mode: generic_xlsx > Sheet: Main": "Mode: generic_xlsx > Sheet: Main", "Mode: generic_pptx > Slide: x > y": "Mode: generic_pptx > Slide: x > y",
        " plain > text ": "plain > text", "": "", None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", clean_chunk(F.col("raw")))
    for r in df.collect():
        assert r.got == r.want, r

