"""Distances, soft assignment to centres, nearest sample points, and scores against clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, x: s + x))


def linf(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: F.greatest(s, x))


NORMS = {"L1": l1, "L2": l2, "LINF": linf}
CENTRES_MOST = 100_000


def small(df: DataFrame, most: int = CENTRES_MOST) -> DataFrame:
    """df for a broadcast, after a check that it has no more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows cannot be sent to every task; summarise them first")
    return F.broadcast(df)


def soft_assign(points: DataFrame, centres: DataFrame, norm: str = "L2", ratio: float = 1.25) -> DataFrame:
    """(id, centre, distance, share): the centres within ratio of a point's least distance, with harmonic shares.

    A point that lies on centres belongs to those alone. points: (id, x); centres: (centre, c), few by nature.
    """
    d = points.join(small(centres), how="cross").select("id", "centre", NORMS[norm](F.col("x"), F.col("c")).alias("distance"))
    near = F.min("distance").over(Window.partitionBy("id"))
    d = d.withColumn("__m", near).where((F.col("distance") <= ratio * F.col("__m")))
    inverse = F.when(F.col("__m") > 0, 1 / F.col("distance")).otherwise(1.0)
    return d.withColumn("share", inverse / F.sum(inverse).over(Window.partitionBy("id"))).drop("__m")


BLOCK = 16384  # rows of either side that meet in one task


def _least(q: np.ndarray, s: np.ndarray, seq: np.ndarray, k: int, norm: str, within: float | None):
    """(query, sample row, distance) of the k nearest sample rows of each query; rows without a distance come last.

    Squared distances by a matrix product, which err by far less than the margin, choose who is measured term by term.
    """
    size = np.einsum("ij,ij->i", s, s)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        if norm == "L2":
            own = np.einsum("ij,ij->i", part, part)
            with np.errstate(invalid="ignore", over="ignore"):
                rough = own[:, None] + size - 2.0 * (part @ s.T)
                rough[~np.isfinite(rough)] = np.inf
                last = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(s) > k else np.full(len(part), np.inf)
                margin = 1e-9 * (own + np.nanmax(np.where(np.isfinite(size), size, 0.0), initial=0.0))
                i, j = np.nonzero(rough <= (last + np.where(np.isfinite(margin), margin, np.inf))[:, None])
        else:
            i, j = (v.ravel() for v in np.indices((len(part), len(s))))
        d = np.zeros(len(i))
        for c in range(q.shape[1]):
            gap = np.abs(part[i, c] - s[j, c])
            d = np.maximum(d, gap) if norm == "LINF" else d + (gap * gap if norm == "L2" else gap)
        d = np.sqrt(d) if norm == "L2" else d
        if within is not None:
            i, j, d = (v[d < within] for v in (i, j, d))
        by = np.lexsort((seq[j], d, i))
        i, j, d = i[by], j[by], d[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        yield i[keep] + at, j[keep], d[keep]


def nearest(queries: DataFrame, sample: DataFrame, k: int, norm: str = "L2", within: float | None = None) -> DataFrame:
    """(id, seq, distance, rank): the k nearest rows of a sample (seq, point), of any size, to each query (id, x).

    Exact: every query meets every row, a block of either side in a task. Null vectors and coordinates give a null
    distance, which ranks last; of equal distances the least seq comes first.
    """
    if norm not in NORMS:
        raise ValueError(f"unknown norm {norm}")
    kinds = dict(queries.select("id").dtypes) | dict(sample.select("seq").dtypes)

    def dealt(df: DataFrame, x: str, mine: str, others: str, count: int, other_count: int) -> DataFrame:
        here = F.monotonically_increasing_id()
        return df.withColumn(x, F.col(x).cast("array<double>")).withColumn(mine, F.pmod(F.xxhash64(here), F.lit(count)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))))

    def vectors(column: pd.Series) -> np.ndarray:
        width = max((len(v) for v in column if v is not None), default=1)
        none = np.full(width, np.nan)
        return np.array([none if v is None else np.array(v, float) for v in column]).reshape(len(column), width)

    def meet(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(rows):
            return pd.DataFrame({"id": [], "seq": [], "distance": []})
        seq = rows["seq"].to_numpy()
        q, s = vectors(mine["x"]), vectors(rows["point"])
        if q.shape[1] != s.shape[1]:  # one side has no vector at all
            width = max(q.shape[1], s.shape[1])
            q, s = (v if v.shape[1] == width else np.full((len(v), width), np.nan) for v in (q, s))
        i, j, d = (np.concatenate(v) for v in zip(*_least(q, s, seq, k, norm, within), strict=True))
        return pd.DataFrame({"id": mine["id"].to_numpy()[i], "seq": seq[j], "distance": d})

    queries, sample = queries.select("id", "x"), sample.select("seq", "point")
    many, rows = (max(1, -(-df.count() // BLOCK)) for df in (queries, sample))
    left = dealt(queries, "x", "__q", "__s", many, rows).groupBy("__q", "__s")
    right = dealt(sample, "point", "__s", "__q", rows, many).groupBy("__q", "__s")
    found = left.cogroup(right).applyInPandas(meet, f"id {kinds['id']}, seq {kinds['seq']}, distance double")
    found = found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("distance").asc_nulls_last(), "seq"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cluster_scores(objects: DataFrame, representatives: DataFrame, distance, cap: float = 10.0) -> DataFrame:
    """(id, cluster, score): least distance to a cluster's representatives over its radius, capped, for the best cluster.

    objects: (id, o); representatives: (cluster, r, radius), few; distance: (Column, Column) -> Column.
    """
    d = objects.join(small(representatives), how="cross").select("id", "cluster", distance(F.col("o"), F.col("r")).cast("double").alias("d"), "radius")
    per = d.groupBy("id", "cluster").agg(F.min("d").alias("d"), F.max("radius").alias("radius"))
    score = F.when(F.col("radius") > 0, F.least(F.lit(cap), F.col("d") / F.col("radius"))).otherwise(F.when(F.col("d") > 0, cap).otherwise(0.0))
    best = F.row_number().over(Window.partitionBy("id").orderBy("score", "cluster"))
    return per.withColumn("score", score).withColumn("__r", best).where("__r = 1").select("id", "cluster", "score")


def separation_vector(points: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """keys, low, high, ranges, range_sum: the bounding box of each group of points, in one pass."""
    one = points.select(*keys, F.posexplode(x).alias("dim", "v")).groupBy(*keys, "dim").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    box = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "a", "b"))).alias("__b"))
    low, high = F.transform("__b", lambda e: e["a"]), F.transform("__b", lambda e: e["b"])
    box = box.select(*keys, low.alias("low"), high.alias("high"))
    ranges = F.zip_with("high", "low", lambda p, q: (p - q).cast("double"))
    return box.withColumn("ranges", ranges).withColumn("range_sum", F.aggregate("ranges", F.lit(0.0), lambda s, v: s + v))


def separation_probability(low: Column, high: Column, x: Column, range_sum: Column) -> Column:
    """Chance that a random cut of the box that also holds x separates x from it."""
    out = F.aggregate(
        F.zip_with(F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), x, lambda e, v: F.greatest(F.lit(0.0), (v - e["b"]).cast("double"), (e["a"] - v).cast("double"))),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    return F.when(out + range_sum > 0, out / (out + range_sum)).otherwise(0.0)
