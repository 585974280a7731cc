"""Rates, quantiles and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """part of whole in percent, 0 for none."""
    return F.when(whole > 0, F.round(100.0 * part / whole, places)).otherwise(F.lit(0.0))


def percent_sql(part: str, whole: str, places: int = 1) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(100.0 * {part} / {whole}, {places}) ELSE 0.0 END"


#: Bins in which a key's values are counted to find where a place lies; steps of a doubling.
BINS, STEPS = 4096, 16


def magnitude(value: Column) -> Column:
    """A number that rises with the value, STEPS for each doubling away from 0: however far values lie apart, there are few."""
    v, steps = value.cast("double"), lambda x: F.floor(F.log2(x) * STEPS).cast("int") + 20_000
    inf = F.lit(float("inf"))
    return F.when(F.isnan(v), 50_000).when(v == inf, 40_000).when(v == -inf, -40_000).when(v == 0, 0).when(v > 0, steps(v)).otherwise(-steps(-v))


def at_places(df: DataFrame, key: str, value: str, places: list[Callable[[Column], Column]]) -> DataFrame:
    """key, n, most, and v0, v1, ...: the values at places (counted from 0, of the number n) among each key's sorted values.

    Values are counted by magnitude, those of a magnitude that holds a place in bins of equal width, and only those of the bins that
    hold a place are ordered: no task sorts all values of a key, and a few values far out don't crowd the others into
    one bin. Nulls don't count; a place beyond the ends is null; NaN is the largest value.
    """

    def reached(bins: DataFrame, by: list[str], bin_: str, start: Column) -> DataFrame:
        """The bins in which a place lies, with the number of values before them."""
        before = start + F.sum("held").over(Window.partitionBy(*by).orderBy(bin_)) - F.col("held")
        own = bins.withColumn("before", before)
        asked = F.filter(F.array(*(f(F.col("n")).cast("long") for f in places)), lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("held")))
        return own.filter(F.size(asked) > 0)

    rows = df.select(key, value).filter(F.col(value).isNotNull()).withColumn("rough", magnitude(F.col(value)))
    span = rows.groupBy(key).agg(F.max(value).alias("most"), F.count("*").alias("n"))
    rough = rows.groupBy(key, "rough").agg(F.count("*").alias("held"), F.min(value).alias("low"), F.max(value).alias("high"))
    hit = reached(rough.join(span.select(key, "n"), key), [key], "rough", F.lit(0)).drop("held")
    width = F.col("high") - F.col("low")
    bin_of = F.when(width > 0, F.floor((F.col(value) - F.col("low")) / width * BINS)).otherwise(0).cast("int")
    inside = rows.join(hit, [key, "rough"]).withColumn("bin", bin_of)
    bins = inside.groupBy(key, "rough", "bin").agg(F.count("*").alias("held"), F.max("before").alias("below"), F.max("n").alias("n"))
    fine = reached(bins, [key, "rough"], "bin", F.col("below")).select(key, "rough", "bin", F.col("before").alias("first"))
    counted = inside.join(fine, [key, "rough", "bin"]).groupBy(key, "rough", "bin", value).agg(F.count("*").alias("times"), F.max("first").alias("first"), F.max("n").alias("n"))
    upto = F.col("first") + F.sum("times").over(Window.partitionBy(key, "rough", "bin").orderBy(value))
    counted = counted.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("times"))
    found = [F.max(F.when((f(F.col("n")) >= F.col("after")) & (f(F.col("n")) < F.col("upto")), F.col(value))).alias(f"v{k}") for k, f in enumerate(places)]
    return span.select(key, "n", "most").join(counted.groupBy(key).agg(*found), key, "left")


def floor_quantile(df: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """The value at place min(floor(q n), n - 1) of each key's sorted values."""
    found = at_places(df, key, value, [lambda n: F.least(F.floor(F.lit(q) * n), n - 1)])
    return found.select(key, F.col("v0").alias(name))


def exclusive_quantile(df: DataFrame, key: str, value: str, part: int, parts: int, name: str) -> DataFrame:
    """Quantile part/parts with ends left out, (n + 1) p interpolated; the maximum where there are too few values."""
    place = lambda n: (n + 1) * part / F.lit(parts)
    found = at_places(df, key, value, [lambda n: F.floor(place(n)) - 1, lambda n: F.floor(place(n))])
    h = place(F.col("n"))
    between = F.col("v0") + (h - F.floor(h)) * (F.coalesce("v1", "v0") - F.col("v0"))
    return found.select(key, F.when(F.col("n") < parts, F.col("most")).otherwise(between).alias(name))


def risk(p99: Column, error_rate: Column, hit_rate: Column) -> Column:
    """low, medium or high by fixed thresholds."""
    level = F.greatest(F.when(p99 > 150, 2).when(p99 > 100, 1).otherwise(0), F.when(error_rate > 25, 2).when(error_rate > 15, 1).otherwise(0), F.when((hit_rate > 0) & (hit_rate < 50), 1).otherwise(0))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)
