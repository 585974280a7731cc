"""Conversation structure repair by depth-first branch and bound.

A conversation is sound if its role initials are nothing, or an optional s and then pairs of u and a. Each row is
kept (0), given the role that the place asks for (3) or deleted (4, required for blank and repeated rows); empty
rows of the role asked for may be inserted anywhere (3); a truncated row that isn't deleted costs 3 more. What a
place asks for follows from the edits before it, so the edits' initials (the audit) name one repair, and of the
cheapest the least audit in ASCII order is the result.

The search holds its nodes (row, place in the pattern, cost, audit) on an explicit stack. Lower bounds on what the
rows from here on cost, one for each row and place, come from one walk backwards that forgets the audits; the
incumbent starts as the deletion of everything; a node is left if its cost and bound exceed the incumbent's cost, or
equal it with an audit that is not less; a table by row and place leaves prefixes that a cheaper, or as cheap and
lesser, one has reached. Two prefixes of one node and one cost are never prefixes of each other (the longer would
have more insertions, thus more cost), so leaving the greater one loses nothing. When the stack is empty the
incumbent is proved.

Spark deals the rows by conversation and sorts them; a task walks them in order and holds one conversation at a
time, as its repaired rows and its audit are one result row.

Cases: null roles and texts count as one space, null conversation ids are a conversation of their own; null turns
come first; rows of one turn are ordered by role, then text; repeated rows are repeated turns; an empty table gives
an empty result; extra columns are ignored. A conversation whose rows are all absent has an empty repair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.llm.common import table

#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places of the pattern: at the start, after s, after u, after a. What a role asked for leads to, and what it is.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ASKED = {START: (AFTER_U, "user"), AFTER_S: (AFTER_U, "user"), AFTER_U: (AFTER_A, "assistant"), AFTER_A: (AFTER_U, "user")}
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
LEGAL = {"su", "ua", "au"}
ENDS = (START, AFTER_A)
SPACE = r"\x20\x09-\x0D"
OUT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


def edits(place: int, initial: str, doomed: bool, cut: bool) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next place of what can be done with a row."""
    yield "D", DELETE, place
    if not doomed:
        extra = TRUNCATED if cut else 0
        if (place, initial) in KEPT:
            yield "K", extra, KEPT[place, initial]
        yield "R", REROLE + extra, ASKED[place][0]


def bounds(rows: list[tuple[str, bool, bool]]) -> list[list[int]]:
    """For each row and place, what the rows from there on cost at least; one line more for the end."""
    far = DELETE * len(rows) + 2 * INSERT + 1

    def with_insertions(own: list[int]) -> list[int]:
        once = [INSERT + own[ASKED[p][0]] for p in range(4)]
        return [min(own[p], once[p], INSERT + once[ASKED[p][0]]) for p in range(4)]

    out = [with_insertions([0 if p in ENDS else far for p in range(4)])]
    for row in reversed(rows):
        after = out[-1]
        out.append(with_insertions([min(c + after[to] for _, c, to in edits(p, *row)) for p in range(4)]))
    return out[::-1]


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of the best repair of rows given as (initial, to be deleted, truncated)."""
    n, bound = len(rows), bounds(rows)
    best = (DELETE * n, "D" * n)
    stack, seen = [(0, START, 0, "")], {(0, START): (0, "")}
    while stack:
        i, place, cost, audit = stack.pop()
        if seen[i, place] < (cost, audit):
            continue
        if i == n and place in ENDS:
            best = min(best, (cost, audit))
        moves = [(i + 1, *e) for e in edits(place, *rows[i])] if i < n else []
        moves.append((i, "I", INSERT, ASKED[place][0]))
        open_moves = []
        for j, letter, c, to in moves:
            total, text = cost + c, audit + letter
            least = total + bound[j][to]
            if least > best[0] or least == best[0] and text > best[1][: len(text)]:
                continue
            if (j, to) in seen and seen[j, to] <= (total, text):
                continue
            seen[j, to] = (total, text)
            open_moves.append((least, letter, (j, to, total, text)))
        stack += [node for _, _, node in sorted(open_moves, reverse=True)]  # the most hopeful is popped first
    return best


def applied(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired rows that an audit makes of rows of (role, text)."""
    out, place, at = [], START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter == "K":
            place = KEPT[place, role[:1]]
        else:
            place, role = ASKED[place]
        out.append((role, text))
    return out


def judged(rows: list[tuple[int | None, str, str, bool, bool]]) -> tuple:
    """The columns of OUT for one conversation's rows (turn, role, text, blank, truncated), in order."""
    seen: set[tuple[str, str]] = set()
    counts = [0, 0, 0]
    found = []
    for _, role, text, blank, cut in rows:
        repeated = not blank and (role, text) in seen
        cut = cut and not blank and not repeated
        seen.add((role, text))
        for k, fault in enumerate((blank, repeated, cut)):
            counts[k] += fault
        found.append((role[:1], blank or repeated, cut))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(found, found[1:]))
    cost, audit = cheapest(found)
    return gaps, *counts, illegal, cost, audit, applied(audit, [(r[1], r[2]) for r in rows])


def repaired(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """Each conversation's faults, the cheapest repair's cost and audit, and the repaired rows.

    Rows where `present` is not true only keep their conversation in the result.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(present, F.lit(False)).alias("there") if present is not None else F.lit(True).alias("there"),
    )
    own = own.select(
        "*", (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut")
    )
    columns = ["turn", "role", "text", "blank", "cut"]
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {OUT}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, None, []
        types = None

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
            parts = list(zip(*done))
            message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            arrays = [pa.array(parts[0], types), *(pa.array(p, pa.int64()) for p in parts[1:7]), pa.array(parts[7], pa.string())]
            arrays.append(pa.array([[{"role": r, "text": t} for r, t in m] for m in parts[8]], message))
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            types = b.schema.field("conv_id").type
            ids, there = b.column("conv_id").to_pylist(), b.column("there").to_pylist()
            for conv, is_there, *row in zip(ids, there, *(b.column(c).to_pylist() for c in columns)):
                if held is None or conv != key:
                    if held is not None:
                        done.append((key, *judged(held)))
                        if len(done) >= 500:
                            yield flush()
                    key, held = conv, []
                if is_there:
                    held.append(tuple(row))
        if held is not None:
            done.append((key, *judged(held)))
            yield flush()

    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn; `there` is false for dropped ones."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(as_text[0], F.lit(":"), as_text[1]).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("there"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return out.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repaired(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), F.col("there"))
    lines = F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    digest = F.sha2(F.concat_ws("\n", lines).cast("binary"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))
