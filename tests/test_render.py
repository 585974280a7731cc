"""Answers as text."""

import pytest
from pyspark.sql import functions as F

from loredeck.functions import render


@pytest.fixture(scope="module")
def shown(spark):
    def of(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("out")).orderBy("i").collect()
        return [r.out for r in rows]

    return of


def test_sections(shown):
    got = shown(render.answer_sections, "x\n[답변] \n yes \n\n[근거]\n- a\n- b\n", "[답변]\n\n[근거]\nz", " no headings ", "[답변]\nonly", "[근거]\na\n[답변]\nb", None)
    assert [tuple(r) for r in got] == [("yes", "- a\n- b"), ("", "z"), ("no headings", ""), ("[답변]\nonly", ""), ("[근거]\na\n[답변]\nb", ""), (None, None)]


def test_markup_and_links(shown):
    assert shown(render.chat_markup, "**a** and ***b*** __c\nd__ *e*", "**a ***b*** c**", "2 ** 3", None) == ["*a* and *b* *c\nd* *e*", "*a *b* c*", "2 ** 3", None]
    link = lambda k: f"<https://x/browse/{k}|{k}>"
    keys = shown(lambda c: render.linked(c, "https://x"), "AB-1, (C2-30) ab-4", "<https://x|AB-1> AB-1", "| AB-1", "XAB-", None)
    assert keys == [f"{link('AB-1')}, ({link('C2-30')}) ab-4", f"<https://x|AB-1> {link('AB-1')}", "| AB-1", "XAB-", None]


def test_tab_tables(shown):
    table = "| a | b |  |\n|---|---|---|\n| 1 | x\\|y | z |"
    got = shown(render.tab_tables, "top\na\tb\n1\tx|y\tz\nmid\nc\td\nend", "a\tb\nc\td", "a\tb\nc\td\ne\tf", "", None)
    assert got == [f"top\n{table}\nmid\n| c | d |\n|---|---|\nend", "a\tb\nc\td", "| a | b |\n|---|---|\n| c | d |\n| e | f |", "", None]


def test_answers(spark):
    hits = [("T%d" % i, "p%d" % i if i else None, "s" * 400 if i else "", "2024-01-0%d" % i if i % 2 else None) for i in range(1, 13)]
    schema = "kind string, hits array<struct<title:string,path:string,snippet:string,modified:string>>"
    rows = [(k, h) for k in ("metadata", "list", "summary") for h in (hits, [], None)]
    out = spark.createDataFrame(rows, schema).select(render.rendered(F.col("kind"), F.lit("q"), F.col("hits"), F.lit("wiki")).alias("a")).collect()
    got = [r.a for r in out]
    for name, (full, empty, null) in zip(("metadata", "list", "summary"), zip(*[iter(got)] * 3)):
        assert empty == null == f"📋 *질문*\nq\n\n💬 *답변*\n{render.NOTHING[name]}\n\n📌 *출처*\nwiki"
        assert full.startswith("📋 *질문*\nq\n\n💬 *답변*\n") and full.endswith("\n\n📌 *출처*\nwiki")
    assert "*T1* — 최근 수정: 2024-01-01\n\n🔗 *근거*\n- T1 (최근 수정: 2024-01-01)\n  경로: p1\n- T2\n  경로: p2\n" in got[0] and "T6" not in got[0]
    assert "검색 결과 12건의 파일이 있습니다.\n\n🔗 *근거*\n1. T1 (2024-01-01)\n2. T2\n" in got[3] and "10. T10" in got[3] and "T11" not in got[3]
    assert "*T1*\n" + "s" * 300 + "\n\n*T2*" in got[6] and got[6].count("- T") == 3
