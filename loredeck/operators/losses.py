"""What a parse lost: lines of a reference text that are missing in what was kept of it, with their number and origin.

Lines are compared as multisets: a line that stands three times in the reference and once in the kept text is lost
twice. A lost line is cut if the kept text has a line of its document that is its beginning. Short lines don't count.

Cases: null texts have no lines; documents without lines are kept with zeros; null keys are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of fewer characters aren't compared (fixed value); a share of lost lines beyond this blocks.
LEAST, ALLOWED = 6, 0.01


def lines_of(c: Column) -> Column:
    """Lines of a text without blanks around them, those of LEAST characters or more."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: F.length(x) >= LEAST)


def line_differences(reference: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """key, line, lost and extra: lines whose numbers differ, of two tables of (key, lines)."""
    side = lambda d, sign: d.select(key, F.explode("lines").alias("line"), F.lit(sign).alias("n"))
    both = side(reference, 1).unionAll(side(kept, -1)).groupBy(key, "line").agg(F.sum("n").alias("n"))
    return both.filter("n <> 0").select(key, "line", F.greatest("n", F.lit(0)).alias("lost"), F.greatest(-F.col("n"), F.lit(0)).alias("extra"))


def with_origin(differences: DataFrame, key: str) -> DataFrame:
    """Lost lines with `cut`: whether a line that only the kept text has is their beginning; candidates meet by their first LEAST characters."""
    start = F.substring("line", 1, LEAST).alias("start")
    lost = differences.filter("lost > 0").select(key, "line", "lost", start)
    extra = differences.filter("extra > 0").select(F.col(key).alias("_key"), F.col("line").alias("_line"), start.alias("_start"))
    meets = F.col(key).eqNullSafe(F.col("_key")) & (F.col("start") == F.col("_start")) & F.col("line").startswith(F.col("_line"))
    cut = lost.join(extra, meets, "left_semi").select(key, "line", "lost", F.lit(True).alias("cut"))
    return cut.unionAll(lost.join(extra, meets, "left_anti").select(key, "line", "lost", F.lit(False)))


def losses(reference: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """key, lines, lost, cut, extra, loss (share of lines lost, cut ones aside) and verdict (BLOCK beyond ALLOWED, else PASS)."""
    d = line_differences(reference, kept, key)
    by_key = with_origin(d, key).select(key, "lost", F.when(F.col("cut"), F.col("lost")).otherwise(0).alias("cut"), F.lit(0).cast("long").alias("extra"))
    parts = by_key.unionAll(d.filter("extra > 0").select(key, F.lit(0).cast("long"), F.lit(0).cast("long"), "extra"))
    sizes = reference.select(key, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("lines"))
    zero = lambda c, name: F.lit(0).cast("long").alias(name) if c is None else c
    every = parts.select(key, zero(None, "lines"), "lost", "cut", "extra").unionAll(sizes.select(key, F.greatest("lines", F.lit(0)), *(zero(None, n) for n in ("lost", "cut", "extra"))))
    t = every.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("lines", "lost", "cut", "extra")))
    loss = F.when(F.col("lines") > 0, F.round((F.col("lost") - F.col("cut")) / F.col("lines"), 6)).otherwise(0.0)
    return t.withColumn("loss", loss).withColumn("verdict", F.when(F.col("loss") > ALLOWED, "BLOCK").otherwise("PASS"))
