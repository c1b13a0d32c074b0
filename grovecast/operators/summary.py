"""Weighted summaries, neighbour lists and directional vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_percentiles(df: DataFrame, keys: list[str], x: str, w: str, levels: dict[str, float]) -> DataFrame:
    """keys, mean, deviation, total and for each name the first value whose cumulative weight reaches level * total."""
    by = Window.partitionBy(*keys).orderBy(x)
    run = df.groupBy(*keys, x).agg(F.sum(w).alias("w")).withColumn("cum", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    total = F.sum("w").over(Window.partitionBy(*keys))
    run = run.withColumn("total", total)
    picks = [F.min(F.when(F.col("cum") >= F.lit(p) * F.col("total") - 1e-9, F.col(x))).alias(n) for n, p in levels.items()]
    mean = F.sum(F.col("w") * F.col(x)) / F.sum("w")
    square = F.sum(F.col("w") * F.col(x) * F.col(x)) / F.sum("w")
    return run.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("deviation"), F.max("total").alias("total"), *picks)


def weighted_dedup(df: DataFrame, point: list[str], w: str) -> DataFrame:
    """Equal points as one, weights added; points are compared by value, never by a hash."""
    return df.groupBy(*point).agg(F.sum(w).alias("weight"), F.count("*").alias("copies"))


def merge_neighbours(df: DataFrame, query: list[str], point: list[str], distance: str, seq: str) -> DataFrame:
    """One row for each query and point: least distance, sorted sequence numbers, count over trees."""
    return df.groupBy(*query, *point).agg(F.min(distance).alias("distance"), F.array_sort(F.collect_set(seq)).alias("seqs"), F.count("*").cast("long").alias("count"))


def vector_sum(high: Column, low: Column) -> Column:
    return F.aggregate(F.zip_with(high, low, lambda a, b: a + b), F.lit(0.0), lambda s, x: s + x)


def vector_scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def renormalised(high: Column, low: Column, target: Column) -> tuple[Column, Column]:
    """Both directions scaled so that they add up to target; spread evenly where they are all zero."""
    total = vector_sum(high, low)
    even = target / (2 * F.size(high))
    fix = lambda v: F.transform(v, lambda x: F.when(total > 0, x * target / total).otherwise(even))
    return fix(high), fix(low)


def windowed_quantiles(df: DataFrame, x: str, rows: int, level: float, keys: list[str], order: str) -> DataFrame:
    """df with low, mid and high: exact interpolated quantiles (1 - level, 1/2, level) of the last `rows` values.

    A median between a negative and a positive neighbour counts as 0.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), Window.currentRow)
    out = df.withColumn("__a", F.array_sort(F.collect_list(x).over(w))).withColumn("__n", F.size("__a"))

    def at(p: float) -> tuple[Column, Column, Column]:
        pos = F.lit(p) * (F.col("__n") - 1)
        i = F.floor(pos).cast("int")
        a, b = F.element_at("__a", i + 1), F.element_at("__a", F.least(i + 2, F.col("__n")))
        return a, b, a + (b - a) * (pos - i)

    a, b, mid = at(0.5)
    mid = F.when((a < 0) & (b > 0), 0.0).otherwise(mid)
    return out.withColumn("low", at(1 - level)[2]).withColumn("mid", mid).withColumn("high", at(level)[2]).drop("__a", "__n")
