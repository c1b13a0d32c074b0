"""Time-decayed weighted samples for each tree, as mergeable top-k.

The key of a row is -decay * seq + log(-log(u) / weight) with a counter-based u; a sample is the k rows with the least
keys, in any order of arrival, so samples of parts merge by taking the least keys of their union. A decay that changes
over time enters through its running sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import uniform, uniform_np


def sample_key(seq: Column, tree: Column | int, decay: float | Column = 0.0, weight: Column | None = None, seed: int = 42, elapsed: Column | None = None) -> Column:
    """Least keys are kept. elapsed: the sum of past decays, for a decay that changes; else decay * seq."""
    past = elapsed if elapsed is not None else (decay if isinstance(decay, Column) else F.lit(decay)) * seq
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return F.when(w > 0, -past + F.log(-F.log(uniform(seq, tree, F.lit(1), F.lit(seed))) / w))


def keyed(df: DataFrame, trees: int, decay: float = 0.0, weight: str | None = None, seed: int = 42, seq: str = "seq") -> DataFrame:
    """df with tree and key, one row for each tree."""
    out = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return out.withColumn("key", sample_key(F.col(seq), F.col("tree"), decay, F.col(weight) if weight else None, seed))


def least(df: DataFrame, size: int, by: list[str], key: str = "key", tie: str = "seq") -> DataFrame:
    """The `size` rows of least key in each group; rows without a key are never taken."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key, tie))
    return df.where(F.col(key).isNotNull()).withColumn("__r", rank).where(F.col("__r") <= size).drop("__r")


def reservoir(df: DataFrame, trees: int, size: int, decay: float = 0.0, weight: str | None = None, seed: int = 42, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """df's sampled rows with tree and key.

    Without groups each task first keeps its own `size` least keys of each tree, so that a shuffle moves at most
    trees * size rows of each task instead of trees copies of the input; with groups each batch keeps as many of each
    group and tree.
    """
    kind = T.StructType([*df.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("key", T.DoubleType())])

    def prune(parts):
        for part in parts:
            s = part[seq].to_numpy(np.int64)
            w = part[weight].to_numpy(float) if weight else np.ones(len(s))
            group = part.groupby(by, dropna=False).ngroup().to_numpy()
            for t in range(trees):
                with np.errstate(divide="ignore", invalid="ignore"):
                    k = -decay * s + np.log(-np.log(uniform_np(s, t, 1, seed)) / w)
                order = np.lexsort((s, np.where(w > 0, k, np.inf), group))
                g = group[order]
                rank = np.arange(len(g)) - np.searchsorted(g, g, "left")
                keep = order[rank < size]
                keep = keep[w[keep] > 0]
                yield part.iloc[keep].assign(tree=np.int32(t), key=k[keep])

    if by:
        return least(df.mapInPandas(prune, kind), size, [*by, "tree"], tie=seq)

    def local(parts):
        kept: list[pd.DataFrame | None] = [None] * trees
        for part in parts:
            s = part[seq].to_numpy(np.int64)
            w = part[weight].to_numpy(float) if weight else np.ones(len(s))
            for t in range(trees):
                with np.errstate(divide="ignore", invalid="ignore"):
                    k = -decay * s + np.log(-np.log(uniform_np(s, t, 1, seed)) / w)
                ok = np.flatnonzero(w > 0)
                if kept[t] is not None and len(kept[t]) >= size:
                    ok = ok[k[ok] <= kept[t]["key"].max()]
                if not len(ok):
                    continue
                new = part.iloc[ok].assign(tree=np.int32(t), key=k[ok])
                both = new if kept[t] is None else pd.concat([kept[t], new], ignore_index=True)
                kept[t] = both.sort_values(["key", seq]).head(size)
        for k in kept:
            if k is not None:
                yield k

    return least(df.mapInPandas(local, kind), size, ["tree"], tie=seq)


def merge(a: DataFrame, b: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Samples of two parts of a stream, with keys on one clock, as one."""
    return least(a.unionByName(b), size, by)


def rebased(df: DataFrame, decay: float, last: int, now: int) -> DataFrame:
    """Keys of a sample whose clock stood at `last`, on the clock of `now`."""
    return df.withColumn("key", F.col("key") - F.lit(float(decay) * (now - last)))


def elapsed_decay(df: DataFrame, decay: str, keys: list[str], order: str = "seq") -> DataFrame:
    """df with `elapsed`: the running sum of a decay that changes from row to row."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("elapsed", F.sum(decay).over(run))


def accept_probability(size: Column, capacity: int, initial: float) -> Column:
    """Chance that an unfilled sample takes a row: 1 up to initial * capacity rows, then falling to 0 at capacity."""
    share = size / F.lit(float(capacity))
    return F.when(share < initial, 1.0).when(share >= 1.0, 0.0).otherwise(1 - (share - initial) / (1 - initial))


def downsample(df: DataFrame, weight: str, bound: int, seed: int = 42, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """About `bound` rows (of each group): all that hold more than 0.5 % of the weight, and a Bernoulli sample of the rest, reweighted."""
    by = by or []
    w = F.col(weight)

    def joined(df, totals):
        return df.join(totals.select(*(F.col(k).alias(f"__{k}") for k in by), *(c for c in totals.columns if c not in by)), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]) if by else df.crossJoin(F.broadcast(totals))

    weighed = joined(df, df.groupBy(*by).agg(F.sum(weight).alias("__total"))).drop(*(f"__{k}" for k in by))
    marked = weighed.withColumn("__heavy", w > 0.005 * F.col("__total"))
    sizes = marked.groupBy(*by).agg(F.sum(F.when(F.col("__heavy"), 1).otherwise(0)).alias("__h"), F.sum(F.when(F.col("__heavy"), 0).otherwise(1)).alias("__n"))
    sized = joined(marked, sizes).drop(*(f"__{k}" for k in by))
    p = F.when(F.col("__n") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0), bound - F.col("__h")) / F.col("__n"))).otherwise(1.0)
    take = F.col("__heavy") | (uniform(F.col(seq), F.lit(0), F.lit(2), F.lit(seed)) < p)
    rescaled = F.when(F.col("__heavy"), w).otherwise(w / F.greatest(p, F.lit(1e-300)))
    return sized.where(take).withColumn("sampled_weight", rescaled).drop("__total", "__heavy", "__h", "__n")
