"""Texts cut into chunks by what they are made of: sheets, tables, paragraphs, windows. Spark expressions throughout.

A text falls into segments at its sheet and slide headings, a segment into tables and the text between them, text
into paragraphs. Lines have a kind, one letter each, and both cuts are patterns over the kinds. What has to be packed
is folded from left to right: small segments into one, rows of a table under a repeated heading, paragraphs up to the
size of a chunk. A longer paragraph gives windows that overlap and end outside markers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size of a chunk, overlap of windows, least size, size up to which segments are put together; markers.
SIZE, OVERLAP, LEAST, SMALL = 800, 100, 50, 400
MARKER = r"\[=[^\]\n]{1,500}\]|\[이미지[^\]\n]{1,500}\]"
SHEET, SLIDE = r"^##\s+Sheet:\s+(.+)$", r"^##\s+Slide\s+([0-9]+)\s*$"
BLANKS = " \t\n\r\f\x0b"
TEXTS, CHUNKS, STARTS = "array<string>", "array<struct<chunk:string,origin:string>>", "array<struct<kinds:string,at:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def filled(texts: Column) -> Column:
    """The texts without blanks around them; empty ones go."""
    return F.filter(F.transform(texts, stripped), lambda t: t != "")


def runs(items: Column, kinds: Column, pattern: str) -> Column:
    """Items, each with a letter in kinds, cut into runs by a pattern over the letters: (kinds, items)."""
    pieces = F.regexp_extract_all(kinds, F.lit(pattern), F.lit(0))
    state = F.struct(F.lit(1).alias("at"), empty(STARTS).alias("out"))
    one = lambda s, p: F.struct(p.alias("kinds"), s["at"].alias("at"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], one(s, p)).alias("out"))
    placed = F.aggregate(pieces, state, step, lambda s: s["out"])
    return F.transform(placed, lambda p: F.struct(p["kinds"].alias("kinds"), F.slice(items, p["at"], F.length(p["kinds"])).alias("items")))


def line_kind(line: Column) -> Column:
    """R: a row of a table, S: the line under its heading, H: a heading of a sheet or slide, x: text."""


    def barred(bare: Column) -> Column:
        return F.when(~(bare.startswith("|") & bare.endswith("|")), "x").when(bare.contains("---"), "S").when(bare != "|", "R").otherwise("x")

    heads = line.startswith("##") & (line.rlike(SHEET) | line.rlike(SLIDE))
    return F.when(heads, "H").when(line.contains("|"), let(stripped(line), barred)).otherwise("x")


def windows(text: Column) -> Column:
    """Windows of SIZE that overlap; an end inside a marker goes before it if LEAST characters are left, else after it."""
    marked = F.split(F.regexp_replace(text, f"({MARKER})", "\u0001$1\u0001"), "\u0001")
    size = F.length(text)

    def markers(parts: Column) -> Column:
        before = lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), ""))
        spans = F.transform(parts, lambda p, k: F.struct(before(k).alias("start"), (before(k) + F.length(p)).alias("stop"), (k % 2).alias("inside")))
        return F.filter(spans, lambda s: s["inside"] == 1)

    def cut(spans: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), empty(TEXTS).alias("out"))

        def step(s: Column, _: Column) -> Column:
            end = F.least(s["at"] + SIZE, size)
            over = F.get(F.filter(spans, lambda m: (m["start"] <= end) & (end < m["stop"])), F.lit(0))
            safe = F.when(over.isNull() | (end == size), end).when(over["start"] - s["at"] >= LEAST, over["start"]).otherwise(over["stop"])
            then = F.when(safe >= size, size).otherwise(F.greatest(safe - OVERLAP, s["at"] + 1))
            window = F.substring(text, s["at"] + 1, safe - s["at"])
            return F.when(s["at"] >= size, s).otherwise(F.struct(then.cast("int").alias("at"), F.array_append(s["out"], window).alias("out")))

        steps = F.ceil(size / (SIZE - OVERLAP)) + 1 + 2 * LEAST * F.size(spans)
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), state, step, lambda s: s["out"])

    return let(let(marked, markers), cut)


def paragraphs(text: Column) -> Column:
    """WIN-15, REM-05: paragraphs, cut at blank lines and before lines that begin with a tab, packed up to SIZE."""
    parts = F.flatten(F.transform(filled(F.split(text, "\n\t")), lambda s: filled(F.split(s, "\n\n"))))
    state = F.struct(F.lit("").alias("held"), F.lit(0).alias("size"), empty(TEXTS).alias("out"))

    def step(s: Column, p: Column) -> Column:
        n = F.length(p)
        out = F.when(s["held"] != "", F.array_append(s["out"], s["held"])).otherwise(s["out"])
        alone = F.struct(F.lit("").alias("held"), F.lit(0).alias("size"), F.array_append(out, p).alias("out"))
        anew = F.struct(p.alias("held"), n.alias("size"), out.alias("out"))
        held = F.when(s["held"] != "", F.concat(s["held"], F.lit("\n\n"), p)).otherwise(p)
        more = F.struct(held.alias("held"), (s["size"] + n + 2).alias("size"), s["out"].alias("out"))
        return F.when(n > SIZE, alone).when((s["size"] + n + 2 > SIZE) & (s["held"] != ""), anew).otherwise(more)

    return F.aggregate(parts, state, step, lambda s: F.when(s["held"] != "", F.array_append(s["out"], s["held"])).otherwise(s["out"]))


def chunk(text: Column, origin) -> Column:
    return F.struct(text.alias("chunk"), (F.lit(origin) if isinstance(origin, str) else origin).alias("origin"))


def table_chunks(lines: Column) -> Column:
    """A table's rows packed up to SIZE under its heading; a row beyond SIZE gives windows."""
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    state = F.struct(F.lit("").alias("held"), F.lit(0).alias("size"), empty(CHUNKS).alias("out"))
    under = lambda rows: F.concat(head, F.lit("\n"), rows)

    def step(s: Column, row: Column) -> Column:
        n = F.length(row) + 1
        out = F.when(s["size"] > 0, F.array_append(s["out"], chunk(under(s["held"]), "table"))).otherwise(s["out"])
        cut = F.struct(F.lit("").alias("held"), F.lit(0).alias("size"), F.concat(out, F.transform(windows(under(row)), lambda w: chunk(w, "sliding"))).alias("out"))
        anew = F.struct(row.alias("held"), n.alias("size"), out.alias("out"))
        held = F.when(s["size"] > 0, F.concat(s["held"], F.lit("\n"), row)).otherwise(row)
        more = F.struct(held.alias("held"), (s["size"] + n).alias("size"), s["out"].alias("out"))
        return F.when(n > SIZE, cut).when((F.length(head) + 1 + s["size"] + n > SIZE) & (s["size"] > 0), anew).otherwise(more)

    rows = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    packed = F.aggregate(rows, state, step, lambda s: F.when(s["size"] > 0, F.array_append(s["out"], chunk(under(s["held"]), "table"))).otherwise(s["out"]))
    return F.when(F.size(lines) < 3, F.array(chunk(head, "table"))).otherwise(packed)


def segments(text: Column) -> Column:
    """(name, text) of what stands before the first sheet or slide (name null), then of each; small neighbours are one, under the first one's name."""
    lines = F.split(text, "\n")
    heading = F.array_join(F.transform(lines, lambda x: F.when(line_kind(x) == "H", "H").otherwise("x")), "")
    cut = runs(lines, heading, "Hx*|x+")
    last = F.size(cut)

    def named(run: Column, k: Column) -> Column:
        first, own = F.get(run["items"], F.lit(0)), F.array_join(run["items"], "\n")
        sheet = F.concat(F.lit("Sheet:"), stripped(F.regexp_extract(first, SHEET, 1)))
        name = F.when(~run["kinds"].startswith("H"), None).when(first.rlike(SHEET), sheet).otherwise(F.concat(F.lit("Slide "), F.regexp_extract(first, SLIDE, 1)))
        whole = F.when(name.isNull() & (last > 1), stripped(own)).when(k < last - 1, F.concat(own, F.lit("\n"))).otherwise(own)
        return F.struct(name.alias("name"), whole.alias("text"))

    found = F.filter(F.transform(cut, named), lambda s: s["text"] != "")
    kind = "array<struct<name:string,text:string>>"
    state = F.struct(F.lit(None).cast("string").alias("name"), F.lit("").alias("text"), empty(kind).alias("out"))
    pair = lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"))

    def step(s: Column, x: Column) -> Column:
        any_text = s["text"] != ""
        joined = F.when(any_text, F.concat(s["text"], F.lit("\n\n"), x["text"])).otherwise(x["text"])
        more = F.struct(F.coalesce(s["name"], x["name"]).alias("name"), joined.alias("text"), s["out"].alias("out"))
        out = F.when(any_text, F.array_append(s["out"], pair(s))).otherwise(s["out"])
        return F.when(F.length(joined) <= SMALL, more).otherwise(F.struct(x["name"].alias("name"), x["text"].alias("text"), out.alias("out")))

    sheets = F.aggregate(F.filter(found, lambda s: s["name"].isNotNull()), state, step, lambda s: F.when(s["text"] != "", F.array_append(s["out"], pair(s))).otherwise(s["out"]))
    return F.concat(F.filter(found, lambda s: s["name"].isNull()), sheets)


def of_segment(segment: Column) -> Column:
    """The chunks of a segment; the first one of a named segment begins with its name."""
    lines = F.split(segment["text"], "\n")
    cut = runs(lines, F.array_join(F.transform(lines, line_kind), ""), "RSR*|(?:(?!RS).)+")
    blocks = F.filter(cut, lambda b: b["kinds"].startswith("RS") | (stripped(F.array_join(b["items"], "\n")) != ""))

    def chunks(own: Column) -> Column:
        origin = F.when(F.size(own) > 1, "section").when(segment["name"].isNull(), "preamble").otherwise("sheet")

        def text_chunks(block: Column) -> Column:
            whole = paragraphs(stripped(F.array_join(block["items"], "\n")))
            return F.flatten(F.transform(whole, lambda p: F.when(F.length(p) <= SIZE, F.array(chunk(p, origin))).otherwise(F.transform(windows(p), lambda w: chunk(w, "sliding")))))

        found = F.flatten(F.transform(own, lambda b: F.when(b["kinds"].startswith("RS"), table_chunks(b["items"])).otherwise(text_chunks(b))))
        kept = F.filter(found, lambda c: F.length(c["chunk"]) >= LEAST)
        named = lambda c, k: F.when((k == 0) & segment["name"].isNotNull(), F.concat(F.lit("## "), segment["name"], F.lit("\n"), c["chunk"])).otherwise(c["chunk"])
        return F.transform(kept, lambda c, k: F.struct(segment["name"].alias("section"), named(c, k).alias("chunk"), c["origin"].alias("origin")))

    return let(blocks, chunks)


def chunked(text: Column) -> Column:
    """STR-42, WIN-15, REM-04..06: (section, chunk, origin) of a text's chunks, in order; none of a null or empty text."""
    return F.flatten(F.transform(F.filter(segments(F.coalesce(text, F.lit(""))), lambda s: s["text"] != ""), of_segment))
