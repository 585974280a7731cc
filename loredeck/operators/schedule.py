"""Schedules as predicates on days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth_weekday(d: Column) -> Column:
    """The how-many-th of its weekday in the month a day is."""
    return F.ceil(F.dayofmonth(d) / 7).cast("int")


def fires(d: Column) -> Column:
    """Whether a schedule (columns kind, weekday, ordinals, interval, start) fires on a day."""
    weekday, day, kind = F.weekday(d), F.dayofmonth(d), F.col("kind")
    same = weekday == F.col("weekday")
    weeks = F.floor(F.datediff(d, F.col("start").cast("date")) / 7)
    return (
        F.when(kind.isin("daily", "mission"), weekday < 5)
        .when(kind == "weekly", same)
        .when(kind == "monthly", F.array_contains("ordinals", day))
        .when(kind == "nth_weekday", same & F.array_contains("ordinals", nth_weekday(d)))
        .when(kind == "last_weekday", same & (day + 7 > F.dayofmonth(F.last_day(d))))
        .when(kind == "nweekly", same & F.col("start").isNotNull() & (weeks % F.col("interval") == 0))
        .when(kind == "quarterly", F.month(d).isin(1, 4, 7, 10) & (day <= 7) & (weekday == 0))
        .otherwise(False)
    )
