"""Readers, writers and enrichment on small files."""

from pyspark.sql import functions as F

from loredeck.operators.enrich import category, enriched, first_by_lower, path_tokens, reference_date, sentences
from loredeck.sources import files, sinks


def test_logs(spark, tmp_path):
    (tmp_path / "q.log").write_text(
        "2024-01-02 03:04:05 | OK | file | user=u1 | query=a | result=3 | 12ms\n"
        "2024-01-02 03:04:06 | ERROR | file | user=u2 | query=b | error=none found | cache=MISS | 7335ms\n"
        "2024-01-02 03:04:07 | OK | file | user=u3 | query=c | kw | why | result=1 | xms\nrubbish\n"
    )
    rows = files.query_log(spark, str(tmp_path / "q.log")).orderBy("at").collect()
    assert [(r.user, r.query, r.result, r.error, r.ms) for r in rows] == [("u1", "a", "3", None, 12), ("u2", "b", None, "none found", 7335), ("u3", "c", "1", None, 0)]
    assert files.since(files.query_log(spark, str(tmp_path / "q.log")), "at", "1d", "2024-01-03 03:04:06").count() == 2
    (tmp_path / "m.log").write_text("2024-01-02 03:04:05 | MISS | user=u | page=P (id=7) | question=q? | stages=a>b\nno\n")
    assert [tuple(r)[1:] for r in files.miss_log(spark, str(tmp_path / "m.log")).collect()] == [("ALL_MISS", "u", "P", 7, "q?", "a>b")]
    (tmp_path / "t.log").write_text("2024-01-02 03:04:05 | bot | in=1 | out=2 | total=3\nx\n")
    assert [tuple(r)[1:] for r in files.token_log(spark, str(tmp_path / "t.log")).collect()] == [("bot", 1, 2, 3)]


def test_files(spark, tmp_path):
    for p in ("a/x.txt", "a/b/y.txt", "c/z.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    inv = files.inventory(spark, str(tmp_path), "*.txt")
    assert inv.count() == 2
    depth = len([x for x in str(tmp_path).split("/") if x])
    assert {(r.folder, r.files) for r in files.folder_counts(inv, depth, 1).collect()} == {("a", 2)}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nbroken\n')
    assert files.json_records(spark, str(tmp_path / "r.jsonl"), "a int").cache().filter("corrupt is not null").count() == 1
    (tmp_path / "rules.json").write_text('{"rules": [{"id": "x", "keywords": ["k"], "enabled": false}, {"id": "y", "keywords": ["l"]}]}')
    assert [(r.id, r.keywords) for r in files.rules(spark, str(tmp_path / "rules.json")).collect()] == [("y", ["l"])]
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t\t2\n\t\t\n3\n")
    t = files.tsv(spark, str(tmp_path / "t.tsv"))
    assert t.columns == ["a", "c"] and sorted(map(tuple, t.collect()), key=str) == [("1", "2"), ("3", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "y|z")], "k int, v string")
    sinks.replace_partitions(df, str(tmp_path / "p"), "k")
    sinks.replace_partitions(df.filter("k = 1").withColumn("v", F.lit("new")), str(tmp_path / "p"), "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "new"), (2, "y|z")]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {r.v for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()} == {"'=x", "y|z"}
    sinks.write_log(df, str(tmp_path / "l"))
    assert {r.value for r in spark.read.text(str(tmp_path / "l")).collect()} == {"1 | =x", "2 | y｜z"}
    sinks.write_records(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_rows_without_those_deleted(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [r.id for r in sinks.without(docs, docs.filter("id = 1"), "id").collect()] == [2]


def test_enrichment(spark):
    df = spark.createDataFrame([("wiki", "Plan A", "x/20240105_y/z", "One here. Two? Three! Four."), ("gdi", "T 240229", "Game/Build 230228/notes_v2.txt", "Alpha beta. Gamma delta. Eps."), ("jira", "t", None, "short")], "source_type string, title string, path string, body string")
    rows = enriched(df).withColumn("d", reference_date(F.coalesce("path", F.lit("")), F.col("title"))).collect()
    assert rows[0].summary == "One here.. Two?. Three!" and str(rows[0].d) == "2024-01-05"
    assert rows[1].summary == "[Game / Build 230228] Alpha beta.. Gamma delta." and str(rows[1].d) == "2023-02-28"
    assert rows[1].keywords[:3] == ["Game", "Build", "notes"] and rows[2].summary is None and rows[2].d is None
    one = spark.range(1)
    assert one.select(first_by_lower(F.array(*map(F.lit, ["A", "a", " b ", "", "B", "c"])), 2).alias("w")).first().w == ["A", "b"]
    assert one.select(path_tokens(F.lit("A/bb_12-cc.txt")).alias("w"), category(F.lit("/a/b/c")).alias("c"), sentences(F.lit(""), 2).alias("s")).first() == (["bb", "cc"], "a / b", "")
