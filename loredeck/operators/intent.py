"""Structured searches and issue queries, as column predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loredeck.functions.text import has
from loredeck.operators.ranking import all_of


@dataclass(frozen=True)
class Intent:
    """What is looked for. Relaxing it is dataclasses.replace; nothing is changed in place."""

    space: str | None = None
    roles: tuple[str, ...] = ()
    title_keywords: tuple[str, ...] = ()
    body_keywords: tuple[str, ...] = ()
    day_from: str | None = None
    day_to: str | None = None
    day_column: str = "updated"


def compile_intent(intent: Intent) -> Column:
    """All conditions of an intent on node rows; date ranges include their last day."""
    conditions = [has("title", k) for k in intent.title_keywords] + [has("body", k) for k in intent.body_keywords]
    if intent.space:
        conditions.append(F.col("space_key") == intent.space)
    if intent.roles:
        conditions.append(F.coalesce("folder_role", F.lit("unknown")).isin(*intent.roles))
    if intent.day_from:
        conditions.append(F.col(intent.day_column) >= F.to_date(F.lit(intent.day_from)))
    if intent.day_to:
        conditions.append(F.col(intent.day_column) < F.date_add(F.to_date(F.lit(intent.day_to)), 1))
    return all_of(conditions)


_CLAUSE = re.compile(r"\s*(\w+)\s*(NOT IN|IN|>=|<=|!=|=|~|<|>|IS NOT EMPTY|IS EMPTY)\s*(\([^)]*\)|[\w:-]+\([^)]*\)|[^\s()]*)\s*", re.I)


def parse_issue_query(text: str) -> list[tuple[str, str, list[str]]]:
    """Clauses joined by AND, as (field, operator, values)."""
    out = []
    for part in re.split(r"\s+AND\s+", re.sub(r"\s+ORDER\s+BY\s.*$", "", text, flags=re.I), flags=re.I):
        m = _CLAUSE.fullmatch(part)
        if not m:
            raise ValueError(f"not a clause: {part}")
        field, op, value = m[1], m[2].upper(), m[3]
        out.append((field, op, [v.strip().strip("\"'") for v in value[1:-1].split(",")] if value.startswith("(") else [value.strip("\"'")]))
    return out


def _moment(value: str, today: str) -> Column:
    """A date, a relative one like -7d, or startOfDay/Week/Month/Year(n)."""
    now = F.to_date(F.lit(today))
    if m := re.fullmatch(r"startOf(Day|Week|Month|Year)\((-?\d*)\)", value):
        n = int(m[2] or 0)
        base = now if m[1] == "Day" else F.trunc(now, m[1].lower())
        moved = {"Day": lambda: F.date_add(base, n), "Week": lambda: F.date_add(base, 7 * n), "Month": lambda: F.add_months(base, n), "Year": lambda: F.add_months(base, 12 * n)}[m[1]]()
        return moved.cast("timestamp_ntz")
    if m := re.fullmatch(r"-(\d+)([dw])", value):
        return F.date_sub(now, int(m[1]) * (7 if m[2] == "w" else 1)).cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")


def issue_filter(clauses: Iterable[tuple[str, str, list[str]]], today: str, dates: tuple[str, ...] = ("created", "updated", "duedate")) -> Column:
    conditions = []
    for field, op, values in clauses:
        c, value = F.col(field), _moment(values[0], today) if field in dates and "EMPTY" not in op else F.lit(values[0])
        conditions.append({
            "=": lambda: c == value, "!=": lambda: c != value, ">=": lambda: c >= value, "<=": lambda: c <= value, "<": lambda: c < value, ">": lambda: c > value,
            "IN": lambda: c.isin(*values), "NOT IN": lambda: ~c.isin(*values), "~": lambda: has(c, values[0]), "IS EMPTY": lambda: c.isNull(), "IS NOT EMPTY": lambda: c.isNotNull(),
        }[op]())
    return all_of(conditions)
