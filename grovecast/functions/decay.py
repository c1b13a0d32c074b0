"""Exponentially decayed moments of ordered series, as window functions.

Row n of a series weighs q ** (n - j) = (1 - decay) ** (n - j) for each earlier row j, so sums are q ** n times plain
window sums of x * q ** -j. To keep q ** -j finite, rows are cut into blocks within which it stays below e ** 300; what
precedes the previous block weighs less than e ** -300 and vanishes in double precision. Rows are numbered from 1, as in
`decayed_sql`, so that a series' first row has the same rounding in both: what is exactly zero there is often compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 300.0


def block_rows(decay: float) -> int:
    return max(1, int(SPAN / -math.log1p(-decay))) if 0 < decay < 1 else 1 << 40


def decayed(df: DataFrame, x: str, decay: float, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """df with <prefix>_w, _mean and _dev: decayed weight, mean and deviation of x up to and with each row.

    Rows whose x is null are passed over: they neither count nor age the statistics, and show those of the row before.
    """
    q, rows = 1.0 - decay, block_rows(decay)
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(x).cast("double")
    n = F.sum(F.when(v.isNotNull(), 1).otherwise(0)).over(by)
    out = df.withColumn("__dk_n", n - 1).withColumn("__dk_b", F.expr(f"__dk_n div {rows}")).withColumn("__dk_k", (F.col("__dk_n") % rows + 1).cast("double"))
    up, down = F.pow(F.lit(q), -F.col("__dk_k")), F.pow(F.lit(q), F.col("__dk_k"))
    here = Window.partitionBy(*keys, "__dk_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    have = v.isNotNull() & (F.col("__dk_n") >= 0)
    parts = {"w": F.lit(1.0), "s": v, "q": v * v}
    for name, term in parts.items():
        out = out.withColumn(f"__dk_{name}", F.coalesce(F.sum(F.when(have, term * up)).over(here), F.lit(0.0)) * down)
    if math.isfinite(rows) and rows < 1 << 40:
        # the previous block's sums at its end, for the rows of this block
        step = Window.partitionBy(*keys).orderBy(*order)
        whole = Window.partitionBy(*keys, "__dk_b")
        for name in parts:
            edge = F.when(F.lag("__dk_b").over(step) < F.col("__dk_b"), F.lag(f"__dk_{name}").over(step))
            out = out.withColumn(f"__dk_p{name}", edge)
        for name in parts:
            out = out.withColumn(f"__dk_{name}", F.col(f"__dk_{name}") + F.coalesce(F.max(f"__dk_p{name}").over(whole), F.lit(0.0)) * F.pow(F.lit(q), F.col("__dk_k"))).drop(f"__dk_p{name}")
    w = F.when(F.col("__dk_w") > 0, F.col("__dk_w"))
    mean = F.col("__dk_s") / w
    out = out.withColumn(f"{prefix}_w", F.col("__dk_w")).withColumn(f"{prefix}_mean", mean)
    out = out.withColumn(f"{prefix}_dev", F.sqrt(F.greatest(F.lit(0.0), F.col("__dk_q") / w - mean * mean)))
    return out.drop("__dk_n", "__dk_b", "__dk_k", "__dk_w", "__dk_s", "__dk_q")


def decayed_sql(x: str, decay: float, source: str, prefix: str, keys: str = "series", order: str = "seq") -> str:
    """SELECT *, <prefix>_w, _mean, _dev from a source; for series short enough for q ** -n."""
    q = 1.0 - decay
    return f"""(SELECT *, {prefix}_s / {prefix}_w AS {prefix}_mean, sqrt(greatest(0, {prefix}_q / {prefix}_w - ({prefix}_s / {prefix}_w) * ({prefix}_s / {prefix}_w))) AS {prefix}_dev
  FROM (SELECT *, pow({q}, {prefix}_n) * sum(pow({q}, -{prefix}_n)) OVER {prefix}_o AS {prefix}_w, pow({q}, {prefix}_n) * sum(({x}) * pow({q}, -{prefix}_n)) OVER {prefix}_o AS {prefix}_s,
    pow({q}, {prefix}_n) * sum(({x}) * ({x}) * pow({q}, -{prefix}_n)) OVER {prefix}_o AS {prefix}_q
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {prefix}_n FROM {source})
    WINDOW {prefix}_o AS (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)))"""


def rounded(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]
