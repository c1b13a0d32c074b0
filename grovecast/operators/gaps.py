"""Gaps in series: how many tuples are missing, and their basic fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decay import decayed
from .framing import time_augmented

FILLS = ("ZERO", "FIXED_VALUES", "PREVIOUS", "NEXT", "LINEAR")


def expected_gap(mean: Column, dev: Column) -> Column:
    """The usual gap: the mean, less what a heavy tail adds to it."""
    return F.when((dev > 0) & (dev < mean / 2), mean - dev * dev / (2 * mean)).otherwise(mean)


def missing_tuples(gap: Column, usual: Column) -> Column:
    """How many tuples a gap stands for: ceil(gap / usual) - 1 from 1.5 usual gaps on, else none."""
    ratio = gap / usual
    return F.when(ratio >= 1.5, F.ceil(ratio).cast("int") - 1).otherwise(0)


def gap_counts(df: DataFrame, decay: float = 0.01, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with gap, usual (from the gaps before the row) and n_missing."""
    step = Window.partitionBy(*keys).orderBy(order)
    out = time_augmented(df, 1.0, keys, order).withColumn("__g", F.when(F.row_number().over(step) > 1, F.col("gap")))
    out = decayed(out, "__g", decay, list(keys), [order], "gap")
    usual = expected_gap(F.lag("gap_mean").over(step), F.lag("gap_dev").over(step))
    out = out.withColumn("usual", F.when(usual > 0, usual))
    return out.withColumn("n_missing", F.coalesce(missing_tuples(F.col("gap"), F.col("usual")), F.lit(0))).drop("__g", "gap_w", "gap_mean", "gap_dev")


def fill_gaps(df: DataFrame, method: str, fixed: float = 0.0, keys: tuple[str, ...] = ("series",), order: str = "seq", n: str = "n_missing") -> DataFrame:
    """(keys, seq, k, x, imputed): k = 1 .. n rows before each row that follows a gap, and the row itself as k = n + 1."""
    if method not in FILLS:
        raise ValueError(f"unknown fill {method}")
    step = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("__p", F.lag("x").over(step)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col(n) + 1)))
    value = {
        "ZERO": F.lit(0.0),
        "FIXED_VALUES": F.lit(fixed),
        "PREVIOUS": F.coalesce("__p", "x"),
        "NEXT": F.col("x"),
        "LINEAR": F.coalesce("__p", "x") + (F.col("x") - F.coalesce("__p", "x")) * F.col("k") / (F.col(n) + 1),
    }[method]
    return out.withColumn("imputed", F.col("k") <= F.col(n)).withColumn("x", F.when(F.col("imputed"), value).otherwise(F.col("x"))).drop("__p")


def fill_within(df: DataFrame, fixed: float | None = None, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with `filled`: null x replaced by a fixed value, or by the last one that is known (0 before any)."""
    if fixed is not None:
        return df.withColumn("filled", F.coalesce("x", F.lit(fixed)))
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("filled", F.coalesce(F.col("x"), F.last("x", ignorenulls=True).over(past), F.lit(0.0)))


def admits(df: DataFrame, size: int, limit: float = 0.5, differenced: bool = False, keys: tuple[str, ...] = ("series",), order: tuple[str, ...] = ("seq", "k")) -> DataFrame:
    """df (with imputed) and `admitted`: may a model train on the shingle that ends here.

    The shingle must be full and its imputed share under the limit; of differenced series the newest tuple must be real.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), Window.currentRow)
    share = F.sum(F.when(F.col("imputed"), 1).otherwise(0)).over(w) / size
    ok = (F.count("*").over(w) == size) & (share < limit)
    return df.withColumn("admitted", ok & ~F.col("imputed") if differenced else ok)


def fast_forward(df: DataFrame, size: int, n: str = "n_missing") -> DataFrame:
    """df whose gaps of 3 * size tuples or more are cut down to size - 1, as the window then holds nothing older."""
    return df.withColumn("forwarded", F.col(n) >= 3 * size).withColumn(n, F.when(F.col(n) >= 3 * size, size - 1).otherwise(F.col(n)))
