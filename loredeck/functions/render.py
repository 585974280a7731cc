"""Answers as text: sections of a reply, chat markup, links of issue keys, tables of tabbed lines, and lists of hits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings of a reply's sections, of an answer's parts, and what an answer without hits says.
ANSWER, EVIDENCE = "[답변]", "[근거]"
PARTS = {"question": "📋 *질문*", "answer": "💬 *답변*", "grounds": "🔗 *근거*", "source": "📌 *출처*"}
NOTHING = {"metadata": "요청하신 정보를 찾을 수 없습니다.", "list": "조건에 맞는 항목을 찾을 수 없습니다.", "summary": "요약할 내용을 찾을 수 없습니다."}
SHOWN = {"metadata": 5, "list": 10, "summary": 3}
SNIPPET = 300
BLANKS = r"\s+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")


def after(c: Column, heading: str, lead: str = "") -> tuple[Column, Column]:
    """What stands before and behind a heading's line; behind it null where there is none."""
    two = F.split(c, lead + re.escape(heading) + r"\s*?\n", 2)
    return F.get(two, F.lit(0)), F.get(two, F.lit(1))


def answer_sections(reply: Column) -> Column:
    """Answer and evidence of a reply (a struct); one without both headings is all answer, evidence empty; null of null."""
    _, tail = after(reply, ANSWER)
    answer, evidence = after(tail, EVIDENCE, r"\n\s*")
    whole = evidence.isNotNull()
    return F.struct(stripped(F.when(whole, answer).otherwise(reply)).alias("answer"), F.when(reply.isNotNull(), stripped(F.coalesce(evidence, F.lit("")))).alias("evidence"))


def chat_markup(c: Column) -> Column:
    """Strong text, marked by two or three asterisks or two underscores, in single asterisks; longest marks first."""
    return reduce(lambda out, mark: F.regexp_replace(out, f"(?s){re.escape(mark)}(.+?){re.escape(mark)}", r"*$1*"), ("***", "**", "__"), c)


def linked(c: Column, base: str) -> Column:
    """Issue keys as links, but for those within five characters of the beginning of a link or of its name."""
    return F.regexp_replace(c, r"(?s)(?<![|<].{0,4})\b([A-Z][A-Z0-9]{0,9}-[0-9]+)\b", f"<{base}/browse/$1|$1>")


def cell(c: Column, width: int = 80) -> Column:
    """Text for a table's cell: bars escaped, no line ends, at most `width` characters, the last an ellipsis if cut."""
    one = F.replace(F.replace(F.trim(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(one) > width, F.concat(F.substring(one, 1, width - 1), F.lit("…"))).otherwise(one)


def _table(rows: Column) -> Column:
    """A table of rows of cells (array of arrays): short rows are filled up, the first is the header."""
    wide = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda i: cell(F.coalesce(F.get(r, i), F.lit("")))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), wide), "|"), F.lit("|"))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), F.lit(1)), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def tab_tables(c: Column) -> Column:
    """Text with runs of tabbed lines as tables, if three lines or more are tabbed; else as it is."""
    tabbed = lambda line: line.contains("\t")
    lines = F.split(c, "\n")
    # runs of lines of one kind, in order: the text is cut where a line's kind differs from the one before
    first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (tabbed(F.get(lines, i)) != tabbed(F.get(lines, i - 1))))
    end = lambda k: F.coalesce(F.get(first, k + 1), F.size(lines))
    runs = F.transform(first, lambda at, k: F.slice(lines, at + 1, end(k) - at))
    shown = F.transform(runs, lambda r: F.when(tabbed(F.get(r, F.lit(0))), _table(F.transform(r, lambda x: F.split(x, "\t")))).otherwise(F.array_join(r, "\n")))
    return F.when(F.size(F.filter(lines, tabbed)) >= 3, F.array_join(shown, "\n")).otherwise(c)


def rendered(kind: Column, question: Column, hits: Column, source: Column) -> Column:
    """An answer of one of three kinds (metadata, list, summary) on hits: an array of (title, path, snippet, modified), best first.

    Metadata: when the first was changed, and the first five with their paths. List: how many there are, and the first
    ten numbered. Summary: beginnings of the first three's texts. No hits: a fixed sentence and no grounds.
    """
    several = F.coalesce(hits, F.array().cast("array<struct<title:string,path:string,snippet:string,modified:string>>"))
    some = lambda name: F.slice(several, 1, SHOWN[name])
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    optional = lambda c, *parts: F.when(c.isNotNull() & (c != ""), text(*parts)).otherwise("")
    of_first = F.get(F.transform(some("metadata"), lambda h: text("*", h["title"], "* — ", F.coalesce(text("최근 수정: ", h["modified"]), F.lit("메타 정보 없음 (cache backfill 필요)")))), F.lit(0))
    by_path = F.transform(some("metadata"), lambda h: text("- ", h["title"], optional(h["modified"], " (최근 수정: ", h["modified"], ")"), optional(h["path"], "\n  경로: ", h["path"])))
    numbered = F.transform(some("list"), lambda h, i: text((i + 1).cast("string"), ". ", h["title"], optional(h["modified"], " (", h["modified"], ")")))
    with_text = F.filter(some("summary"), lambda h: F.coalesce(h["snippet"], F.lit("")) != "")
    beginnings = F.array_join(F.transform(with_text, lambda h: text("*", h["title"], "*\n", F.substring(h["snippet"], 1, SNIPPET))), "\n\n")
    counted = text("검색 결과 ", F.size(several).cast("string"), "건의 파일이 있습니다.")
    answers = {"metadata": (of_first, by_path), "list": (counted, numbered)}
    answers["summary"] = (F.when(beginnings == "", NOTHING["summary"]).otherwise(beginnings), F.transform(some("summary"), lambda h: text("- ", h["title"])))
    choose = lambda of: reduce(lambda out, name: F.when(kind == name, of(name)).otherwise(out), ("metadata", "list"), of("summary"))
    empty = F.size(several) == 0
    answer = F.when(empty, choose(lambda n: F.lit(NOTHING[n]))).otherwise(choose(lambda n: answers[n][0]))
    grounds = F.array_join(choose(lambda n: answers[n][1]), "\n")
    grounds = F.when(empty, "").otherwise(text("\n\n", PARTS["grounds"], "\n", grounds))
    return text(PARTS["question"], "\n", F.coalesce(question, F.lit("")), "\n\n", PARTS["answer"], "\n", answer, grounds, "\n\n", PARTS["source"], "\n", source)
