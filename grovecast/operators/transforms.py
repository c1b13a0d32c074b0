"""Preprocessing of series: weights, moving means, normalisation, differences, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decay import decayed
from .framing import time_augmented

METHODS = ("NONE", "WEIGHTED", "SUBTRACT_MA", "NORMALIZE", "DIFFERENCE", "NORMALIZE_DIFFERENCE")
CLIP = 100.0


def clipped(value: Column, shift: Column, scale: Column, clip: float | None) -> Column:
    """(value - shift) / scale, within [-clip, clip]."""
    t = (value - shift) / scale
    return t if clip is None else F.least(F.greatest(t, F.lit(-clip)), F.lit(clip))


def running_statistics(df: DataFrame, decay: float, keys: list[str], order: str) -> DataFrame:
    """df with five decayed statistics of x: value, difference, value's deviation, difference's mean and deviation.

    The last two decay at a tenth of the rate. A null x leaves the value's statistics alone; a series' first difference is 0.
    """
    step = Window.partitionBy(*keys).orderBy(order)
    out = decayed(df, "x", decay, keys, [order], "value")
    out = out.withColumn("diff", F.when(F.row_number().over(step) == 1, 0.0).otherwise(F.col("x") - F.lag("x").over(step)))
    out = decayed(out, "diff", decay, keys, [order], "change")
    out = out.withColumn("__dev", F.when(F.col("x").isNotNull(), F.col("value_dev")))
    out = decayed(out, "__dev", decay, keys, [order], "spread")
    out = decayed(out, "change_mean", 0.1 * decay, keys, [order], "drift")
    return decayed(out, "change_dev", 0.1 * decay, keys, [order], "jump").drop("__dev")


def transform(df: DataFrame, method: str, decay: float = 0.01, weight: float = 1.0, clip: float = CLIP, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with shift, scale and y, the transformed x; statistics are those before the row, so the map is causal.

    Rows before any statistics have shift 0 and scale 1. y = weight * clip((x or difference - shift) / scale).
    """
    if method not in METHODS:
        raise ValueError(f"unknown transform {method}")
    if method == "NONE" and weight != 1.0:
        raise ValueError("NONE takes weights of 1 only")
    step = Window.partitionBy(*keys).orderBy(order)
    before = lambda c, first: F.coalesce(F.lag(c).over(step), F.lit(first))
    out, value, shift, scale, bound = df, F.col("x"), F.lit(0.0), F.lit(1.0), None
    if method in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
        out = out.withColumn("previous", F.lag("x").over(step)).withColumn("diff", F.coalesce(F.col("x") - F.col("previous"), F.lit(0.0)))
        value = F.col("diff")
    if method in ("SUBTRACT_MA", "NORMALIZE"):
        out = decayed(out, "x", decay, list(keys), [order], "value")
        shift = before("value_mean", 0.0)
    if method == "NORMALIZE":
        out = decayed(out, "value_dev", decay, list(keys), [order], "spread")
        scale, bound = before(F.abs("spread_mean") + 1.0, 1.0), clip
    if method == "NORMALIZE_DIFFERENCE":
        out = decayed(out, "diff", decay, list(keys), [order], "change")
        shift, scale, bound = before("change_mean", 0.0), before(F.col("change_dev") + 1.0, 1.0), clip
    out = out.withColumn("shift", shift).withColumn("scale", scale)
    return out.withColumn("y", F.lit(weight) * clipped(value, F.col("shift"), F.col("scale"), bound))


def invert(df: DataFrame, method: str, weight: float = 1.0) -> DataFrame:
    """df (from transform) with `back`: x from y; exact unless y was clipped."""
    back = F.col("y") / F.lit(weight) * F.col("scale") + F.col("shift")
    if method in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
        back = F.when(F.col("previous").isNull(), F.col("x")).otherwise(back + F.col("previous"))
    return df.withColumn("back", back)


def invert_forecast(df: DataFrame, method: str, weight: float = 1.0, keys: tuple[str, ...] = ("series",), step: str = "h") -> DataFrame:
    """Forecast rows (keys, h from 1, y, shift, scale, drift, last) with `back` in units of x.

    Plain methods scale, shift and add h * drift; differenced ones add up over the horizon from the last value.
    """
    one = F.col("y") / F.lit(weight) * F.col("scale") + F.col("shift")
    if method in ("DIFFERENCE", "NORMALIZE_DIFFERENCE"):
        run = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("back", F.col("last") + F.sum(one).over(run))
    return df.withColumn("back", one + F.col(step) * F.col("drift"))


def time_normalized(df: DataFrame, decay: float = 0.01, clip: float = CLIP, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with gap, gap_mean, gap_dev and z: clip((gap - mean) / (2 * (dev + 1e-3))) against the statistics before."""
    step = Window.partitionBy(*keys).orderBy(order)
    out = time_augmented(df, 1.0, keys, order).withColumn("__g", F.when(F.row_number().over(step) > 1, F.col("gap")))
    out = decayed(out, "__g", decay, list(keys), [order], "gap").drop("__g", "gap_w")
    mean, dev = F.coalesce(F.lag("gap_mean").over(step), F.lit(0.0)), F.coalesce(F.lag("gap_dev").over(step), F.lit(0.0))
    return out.withColumn("z", F.when(F.row_number().over(step) == 1, 0.0).otherwise(clipped(F.col("gap"), mean, 2 * (dev + 1e-3), clip)))


def time_from_gap(previous: Column, z: Column, mean: Column, dev: Column) -> Column:
    """Microseconds of the next row from a normalised gap."""
    return (previous + F.round((z * 2 * (dev + 1e-3) + mean) * 1e6)).cast("long")


def initial_segment(df: DataFrame, start: int = 10, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with y: the first `start` rows of a series are normalised by the statistics of them all, which look ahead.

    Later rows have y null here; transform() serves them. Holes are interpolated first.
    """
    out = fill_holes(df.where(F.col(order) <= start), keys, order)
    seg = Window.partitionBy(*keys)
    mean, dev = F.avg("filled").over(seg), F.stddev_pop("filled").over(seg)
    seen = out.withColumn("y", (F.col("filled") - mean) / (dev + 1.0)).select(*keys, order, "filled", "y")
    return df.join(seen, [*keys, order], "left")


def fill_holes(df: DataFrame, keys: tuple[str, ...] = ("series",), order: str = "seq", default: float = 0.0) -> DataFrame:
    """df with `filled`: null x interpolated in time between neighbours, carried over at the ends, default if all are null."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col("x").isNotNull(), F.struct(F.col("t").alias("t"), F.col("x").alias("x")))
    a, b = F.last(known, ignorenulls=True).over(past), F.first(known, ignorenulls=True).over(future)
    out = df.withColumn("__a", a).withColumn("__b", b)
    share = (F.col("t") - F.col("__a.t")) / F.nullif(F.col("__b.t") - F.col("__a.t"), F.lit(0))
    line = F.col("__a.x") + (F.col("__b.x") - F.col("__a.x")) * F.coalesce(share, F.lit(0.0))
    return out.withColumn("filled", F.coalesce("x", line, "__b.x", "__a.x", F.lit(default))).drop("__a", "__b")


def data_quality(df: DataFrame, decay: float = 0.01, keys: tuple[str, ...] = ("series",), order: str = "seq") -> DataFrame:
    """df with quality: the decayed share of values that are there."""
    out = df.withColumn("__have", F.when(F.col("x").isNull(), 0.0).otherwise(1.0))
    return decayed(out, "__have", decay, list(keys), [order], "have").withColumnRenamed("have_mean", "quality").drop("__have", "have_w", "have_dev")
