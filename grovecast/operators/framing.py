"""Series and shingles: rows of a series in order, and count windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(df: DataFrame, key: str, order: list[str], value: str, time: str | None = None) -> DataFrame:
    """(series, seq, t, x): seq counts a series' rows from 1; t is in microseconds."""
    w = Window.partitionBy(key).orderBy(*order)
    t = F.unix_micros(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")
    return df.select(F.col(key).alias("series"), F.row_number().over(w).cast("long").alias("seq"), t.alias("t"), F.col(value).cast("double").alias("x"))


def shingle(df: DataFrame, size: int, x: str = "x", keys: tuple[str, ...] = ("series",), order: str = "seq", rotate: bool = False, train: str | None = None) -> DataFrame:
    """df with `shingle`: the last `size` values, oldest first, or each at slot seq mod size; rows with fewer are dropped.

    x may be a number or an array (tuples are laid end to end). train names a boolean column: rows where it is false move
    the window but come out with `trains` false, so that a model passes them over.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), Window.currentRow)
    have = F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"))).over(w)
    parts = F.transform(have, lambda e: e["x"])
    if rotate:
        parts = F.transform(F.array_sort(F.transform(have, lambda e: F.struct(F.pmod(e["o"], F.lit(size)).alias("s"), e["x"].alias("x")))), lambda e: e["x"])
    out = df.withColumn("shingle", parts).where(F.size("shingle") == size)
    if dict(df.dtypes)[x].startswith("array"):
        out = out.withColumn("shingle", F.flatten("shingle"))
    return out.withColumn("trains", F.col(train)) if train else out


def shingle_blocks(df: DataFrame, size: int, x: str = "x", order: str = "seq", rotate: bool = False, rows: int = 100_000) -> DataFrame:
    """`shingle` of one long series whose `order` counts without gaps, in blocks of `rows` that tasks can share.

    A block also gets the last size - 1 rows of the one before, so that its first windows are whole.
    """
    if size > rows:
        raise ValueError("a shingle must fit a block")
    home = F.expr(f"{order} div {rows}")
    into = F.when(F.col(order) % rows > rows - size, F.array(home, home + 1)).otherwise(F.array(home))
    out = shingle(df.withColumn("__block", F.explode(into)), size, x, ("__block",), order, rotate)
    return out.where(F.col("__block") == home).drop("__block")


def missing_indices(missing: Column, inputs: int, size: int, seq: Column | None = None) -> Column:
    """Positions in a shingle of the missing coordinates of its newest tuple; with seq, of a rotated shingle."""
    block = F.lit((size - 1) * inputs) if seq is None else F.pmod(seq, F.lit(size)) * inputs
    return F.transform(missing, lambda i: (i + block).cast("int"))


def time_augmented(df: DataFrame, weight: float = 1.0, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with `gap` (0 for the first row) and `point`: x with the weighted gap in seconds behind it."""
    step = Window.partitionBy(*keys).orderBy(order)
    gap = F.coalesce((F.col("t") - F.lag("t").over(step)) / 1e6, F.lit(0.0))
    return df.withColumn("gap", gap).withColumn("point", F.array(F.col("x"), F.lit(weight) * F.col("gap")))
