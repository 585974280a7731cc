"""Tables that change together, runs of stages."""

import pytest
from pyspark.sql import functions as F

from loredeck.operators.runs import Ledger, Stage, run
from loredeck.sources.tableset import TableSet


@pytest.fixture
def store(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "set"), {"a": "k", "b": "k"}, 4, {"a": ("born",)})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_updates_adds_keeps_and_deletes(spark, store):
    a = spark.createDataFrame([(i, f"v{i}", 1) for i in range(20)], "k int, v string, born int")
    b = spark.createDataFrame([(i, i * 1.0) for i in range(20)], "k int, x double")
    assert store.commit({"a": a, "b": b}) == 1
    change = spark.createDataFrame([(3, "new", 2), (30, None, 2)], "k int, v string, born int")
    assert store.commit({"a": change}, {"b": spark.createDataFrame([(5,), (99,)], "k int")}) == 2
    want = sorted([(i, f"v{i}", 1) for i in range(20) if i != 3] + [(3, "new", 1), (30, None, 2)])
    assert rows(store.table("a")) == want and {r[0] for r in rows(store.table("b"))} == set(range(20)) - {5}
    assert rows(store.table("a", 1)) == rows(a)
    store.commit({}, {"b": b})
    assert store.table("b").count() == 0 and rows(store.table("a")) == want


def test_a_commit_that_breaks_off_changes_nothing(spark, store):
    a = spark.createDataFrame([(1, "x", 1)], "k int, v string, born int")
    b = spark.createDataFrame([(1, 1.0)], "k int, x double")
    store.commit({"a": a, "b": b})
    broken = b.withColumn("x", F.raise_error(F.lit("half-way")).cast("double"))
    with pytest.raises(Exception, match="half-way"):
        store.commit({"a": a.withColumn("v", F.lit("lost")), "b": broken})
    assert store.versions() == [1] and rows(store.table("a")) == [(1, "x", 1)] and rows(store.table("b")) == [(1, 1.0)]
    store.commit({"a": a.withColumn("v", F.lit("kept")), "b": b})
    assert rows(store.table("a")) == [(1, "kept", 1)]


def test_two_commits_cannot_take_one_version(spark, store):
    a = spark.createDataFrame([(1, "x", 1)], "k int, v string, born int")
    store.commit({"a": a})
    with pytest.raises(RuntimeError):
        store._publish({"version": 1, "tables": {}})
    assert rows(store.table("a")) == [(1, "x", 1)]


def test_old_manifests_go_with_files_only_they_name(spark, store, tmp_path):
    for n in range(6):
        store.commit({"a": spark.createDataFrame([(k, f"v{n}", n) for k in ((1, 2, 3) if n == 0 else (1,))], "k int, v string, born int")})
    assert store.versions() == [6, 5, 4]
    assert rows(store.table("a")) == [(1, "v5", 0), (2, "v0", 0), (3, "v0", 0)]
    named = {p for v in store.versions() for p in store.manifest(v)["tables"]["a"]["files"].values()}
    there = {f"a/{p.parent.name}/{p.name}" for p in (tmp_path / "set" / "a").glob("v*/bucket=*")}
    assert named == there


def test_a_failing_stage_leaves_the_others_and_is_gone_on_with(spark, tmp_path):
    ledger, calls = Ledger(spark, str(tmp_path / "ledger")), []
    broken = [True]

    def action(name):
        def act(mark):
            calls.append((name, mark))
            if name == "b" and broken[0]:
                raise ValueError("b is away")
            return 5, f"{name}{len(calls)}"

        return act

    stages = [Stage("a", action("a")), Stage("b", action("b"), ("a",)), Stage("c", action("c"), ("b",)), Stage("d", action("d"))]
    assert not run(stages, ledger)
    broken[0] = False
    assert run(stages, ledger) and run(stages, ledger)
    got = [(r.attempt, r.stage, r.status, r.error) for r in ledger.rows().orderBy("attempt", "place").collect()]
    assert got[:4] == [(1, "a", "done", None), (1, "b", "failed", "b is away"), (1, "c", "skipped", None), (1, "d", "done", None)]
    assert [x[2] for x in got[4:]] == ["kept", "done", "done", "kept", "done", "done", "done", "done"]
    assert calls[:3] == [("a", None), ("b", None), ("d", None)] and calls[5] == ("a", "a1") and len(calls) == 9
