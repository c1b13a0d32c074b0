"""Clustering by merging of overlapping centres, for vectors and for any objects with a distance; outliers against them.

Input is a weighted sample of bounded size (sampling.downsample, sampling.reservoir), so the kernel is plain Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform_np
from .forest_kernel import weighted_pick


def l1(a, b) -> float:
    return float(np.abs(np.asarray(a) - np.asarray(b)).sum())


def l2(a, b) -> float:
    return float(np.sqrt(((np.asarray(a) - np.asarray(b)) ** 2).sum()))


def linf(a, b) -> float:
    return float(np.abs(np.asarray(a) - np.asarray(b)).max())


DISTANCES = {"L1": l1, "L2": l2, "LINF": linf}


def edit_distance(a: str, b: str) -> float:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return float(row[-1])


@dataclass
class Cluster:
    """Weighted representatives; the first is primary. A shrinkage of 1 measures by it alone, of 0 by the nearest."""

    reps: list
    weights: list[float]
    shrinkage: float = 0.0
    radius: float = 0.0
    weight: float = 0.0
    members: list[tuple[int, float]] = field(default_factory=list)

    def distance(self, x, d: Callable) -> float:
        all_ = [d(r, x) for r in self.reps]
        return (1 - self.shrinkage) * min(all_) + self.shrinkage * all_[0]

    def between(self, other: Cluster, d: Callable) -> float:
        every = [d(a, b) for a in self.reps for b in other.reps]
        return (1 - self.shrinkage) * min(every) + self.shrinkage * d(self.reps[0], other.reps[0])


def assign(points: list, weights, clusters: list[Cluster], d: Callable, ratio: float = 1.25) -> None:
    """Soft assignment: members are (point, weight), shared harmonically among the centres within ratio of the nearest."""
    total = [0.0] * len(clusters)
    for c in clusters:
        c.members, c.weight = [], 0.0
    for i, x in enumerate(points):
        dist = [c.distance(x, d) for c in clusters]
        near = min(dist)
        pick = [k for k, v in enumerate(dist) if v <= near * ratio] if near > 0 else [k for k, v in enumerate(dist) if v == 0]
        inverse = [1 / dist[k] if near > 0 else 1.0 for k in pick]
        for k, v in zip(pick, inverse, strict=True):
            w = weights[i] * v / sum(inverse)
            clusters[k].members.append((i, w))
            clusters[k].weight += w
            total[k] += w * dist[k]
    for c, s in zip(clusters, total, strict=True):
        c.radius = s / c.weight if c.weight > 0 else 0.0


def recentre(c: Cluster, points: list, d: Callable, reps: int, vector: bool) -> None:
    """Weighted medians for single vector centres; else representatives spread by weight times distance."""
    if not c.members:
        return
    idx = [i for i, _ in c.members]
    w = np.array([v for _, v in c.members])
    if vector and reps == 1:
        x = np.array([points[i] for i in idx], float)
        c.reps, c.weights = [np.array([weighted_pick(x[:, k], w, 0.5) for k in range(x.shape[1])])], [float(w.sum())]
        return
    first = int(np.argmax(w))
    chosen, left = [idx[first]], np.array([d(points[idx[first]], points[i]) for i in idx])
    while len(chosen) < min(reps, len(idx)):
        far = int(np.argmax(w * left))
        if left[far] <= 0:
            break
        chosen.append(idx[far])
        left = np.minimum(left, [d(points[idx[far]], points[i]) for i in idx])
    c.reps, c.weights = [points[i] for i in chosen], [float(w.sum()) / len(chosen)] * len(chosen)


def summarize(
    points: list, weights=None, most: int = 5, distance: Callable | str = "L2", reps: int = 1, shrinkage: float = 0.0, ratio: float = 0.8, phase: float = 0.0, previous: list[Cluster] | None = None, seed: int = 42
) -> list[Cluster]:
    """At most `most` clusters, heaviest first.

    Seeds are drawn by weight; then points are assigned softly and centres moved, and the pair that overlaps most,
    (radius a + radius b + phase) / distance, merges while it exceeds `ratio` or there are too many.
    """
    if not len(points):
        return []
    d = DISTANCES[distance] if isinstance(distance, str) else distance
    vector = not isinstance(points[0], str) and np.ndim(points[0]) == 1
    w = np.ones(len(points)) if weights is None else np.asarray(weights, float)
    if (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    seeds = min(len(points), 2 * (most + 5))
    keys = np.where(w > 0, -np.log(uniform_np(np.arange(len(points)), 0, 8, seed)) / np.maximum(w, 1e-300), np.inf)
    clusters = [Cluster([points[i]], [float(w[i])], shrinkage) for i in np.argsort(keys, kind="stable")[:seeds] if w[i] > 0]
    for c in previous or []:
        clusters.append(Cluster(list(c.reps), list(c.weights), shrinkage))
    for _ in range(2 * len(clusters) + 4):
        assign(points, w, clusters, d)
        clusters = [c for c in clusters if c.weight > 0]
        for c in clusters:
            recentre(c, points, d, reps, vector)
        best, pair = -1.0, None
        for a in range(len(clusters)):
            for b in range(a + 1, len(clusters)):
                gap = clusters[a].between(clusters[b], d)
                over = math.inf if gap <= 0 else (clusters[a].radius + clusters[b].radius + phase) / gap
                if over > best:
                    best, pair = over, (a, b)
        if pair is None or (best <= ratio and len(clusters) <= most):
            break
        a, b = (clusters[k] for k in pair)
        keep, drop = (a, b) if a.weight >= b.weight else (b, a)
        keep.reps, keep.weights = (keep.reps + drop.reps)[: max(reps, 1)], (keep.weights + drop.weights)[: max(reps, 1)]
        clusters = [c for c in clusters if c is not drop]
    assign(points, w, clusters, d)
    return sorted((c for c in clusters if c.weight > 0), key=lambda c: -c.weight)


class GlobalLocal:
    """Outliers among arbitrary objects: a decayed sample, clusters of it now and then, distance over radius as a score."""

    def __init__(self, distance: Callable, capacity: int = 200, most: int = 10, reps: int = 3, shrinkage: float = 0.1, decay: float = 0.0005, every: int = 50, z: float = 3.0, seed: int = 42, occlusion: bool = True) -> None:
        from ..streaming.online import Threshold

        self.d, self.capacity, self.most, self.reps, self.shrinkage, self.decay, self.every, self.seed, self.occlusion = distance, capacity, most, reps, shrinkage, decay, every, seed, occlusion
        self.keys: list[float] = []
        self.objects: list = []
        self.weights: list[float] = []
        self.clusters: list[Cluster] = []
        self.threshold, self.n, self.elapsed = Threshold(0.01, z, transform="NONE"), 0, 0.0

    def score(self, x, cap: float = 10.0) -> list[tuple[object, float]]:
        """(nearest representative, score) of each cluster, best first; clusters hidden behind a nearer one are left out."""
        found = []
        for c in self.clusters:
            all_ = [self.d(r, x) for r in c.reps]
            k = int(np.argmin(all_))
            found.append((all_[k], c.radius, c.reps[k]))
        found.sort(key=lambda e: e[0])
        kept: list = []
        for dist, radius, rep in found:
            if self.occlusion and any(self.d(r, rep) < dist and dd < dist for dd, _, r in kept):
                continue
            kept.append((dist, radius, rep))
        out = [(rep, min(cap, dist / radius) if radius > 0 else (cap if dist > 0 else 0.0)) for dist, radius, rep in kept]
        return sorted(out, key=lambda e: e[1])

    def process(self, x, weight: float = 1.0) -> tuple[float, float, float]:
        """(score, threshold, grade), then the object is sampled."""
        if self.n % self.every == 0 and len(self.objects) >= 10:
            self.recluster()
        s = self.score(x)
        score = s[0][1] if s else 0.0
        th, grade = self.threshold.primary_grade(score)
        if s:
            self.threshold.add(score)
        key = -self.elapsed + math.log(-math.log(float(uniform_np(self.n, 0, 1, self.seed))) / weight)
        self.n += 1
        self.elapsed += self.decay
        if len(self.keys) < self.capacity:
            self.keys.append(key)
            self.objects.append(x)
            self.weights.append(weight)
        else:
            worst = int(np.argmax(self.keys))
            if key < self.keys[worst]:
                self.keys[worst], self.objects[worst], self.weights[worst] = key, x, weight
        return score, th, grade

    def recluster(self) -> None:
        self.clusters = summarize(self.objects, self.weights, self.most, self.d, self.reps, self.shrinkage, previous=self.clusters[: self.most], seed=self.seed)

    def merge(self, other: GlobalLocal) -> None:
        """The union's least keys; both clocks are brought to the later one."""
        now = max(self.elapsed, other.elapsed)
        keys = [k - (now - m.elapsed) for m in (self, other) for k in m.keys]
        self.elapsed = now
        every = sorted(zip(keys, range(len(self.keys) + len(other.keys)), self.objects + other.objects, self.weights + other.weights, strict=True))[: self.capacity]
        self.keys, self.objects, self.weights = [e[0] for e in every], [e[2] for e in every], [e[3] for e in every]
        self.n += other.n
        self.recluster()


def clusters(df: DataFrame, most: int = 5, bound: int = 5000, by: list[str] | None = None, **how) -> DataFrame:
    """(by, cluster, weight, radius, rep): clusters of points (x, w, seq), found in a sample of about `bound` rows of each group.

    The sample keeps heavy points and rescales the rest; weights and radii are those of a soft assignment of all rows.
    """
    from .sampling import downsample

    kinds = dict(df.dtypes)
    kinds["__one"] = "int"
    keys = by or ["__one"]
    df = df if by else df.withColumn("__one", F.lit(1))
    some = downsample(df, "w", bound, by=keys)
    shrinkage = how.get("shrinkage", 0.0)
    d = how.get("distance", "L2")
    d = DISTANCES[d] if isinstance(d, str) else d

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        found = summarize([np.asarray(v, float) for v in part["x"]], part["sampled_weight"].to_numpy(), most, **how) if part["sampled_weight"].sum() > 0 else []
        rows = [[part[k].iloc[0] for k in keys] + [i, j, [float(v) for v in r]] for i, c in enumerate(found) for j, r in enumerate(c.reps)]
        return pd.DataFrame(rows, columns=[*keys, "cluster", "place", "rep"])

    named = "".join(f"{k} {kinds[k]}, " for k in keys)
    reps = some.groupBy(*keys).applyInPandas(run, named + "cluster int, place int, rep array<double>")
    of = reps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "place", "rep"))).alias("reps"))
    # every row meets the centres of its group
    near = df.join(F.broadcast(of.select(*(F.col(k).alias(f"__{k}") for k in keys), "reps")), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*keys, "x", "w", "reps")

    def share(parts):
        for part in parts:
            for _, group in part.groupby(keys, dropna=False):
                centres: dict[int, Cluster] = {}
                for r in group["reps"].iloc[0]:
                    centres.setdefault(r["cluster"], Cluster([], [], shrinkage)).reps.append(np.asarray(r["rep"], float))
                every = list(centres.values())
                assign([np.asarray(v, float) for v in group["x"]], group["w"].to_numpy(float), every, d)
                rows = [[group[k].iloc[0] for k in keys] + [i, c.weight, c.weight * c.radius] for i, c in zip(centres, every, strict=True)]
                yield pd.DataFrame(rows, columns=[*keys, "cluster", "weight", "far"])

    sums = near.mapInPandas(share, named + "cluster int, weight double, far double").groupBy(*keys, "cluster").agg(F.sum("weight").alias("weight"), F.sum("far").alias("far"))
    radius = F.when(F.col("weight") > 0, F.col("far") / F.col("weight")).otherwise(0.0)
    right = sums.select(*(F.col(k).alias(f"__{k}") for k in [*keys, "cluster"]), "weight", radius.alias("radius"))
    return reps.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in [*keys, "cluster"]]).select(*(by or []), "cluster", "weight", "radius", "rep")


def outliers(df: DataFrame, distance: Callable, by: str, **how) -> DataFrame:
    """(by, seq, score, threshold, grade) of objects (by, seq, o) in order, one model for each group."""
    kinds = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        model = GlobalLocal(distance, **how)
        out = [model.process(o) for o in part["o"]]
        return pd.DataFrame({by: part[by], "seq": part["seq"], "score": [r[0] for r in out], "threshold": [r[1] for r in out], "grade": [r[2] for r in out]})

    return df.select(by, "seq", "o").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, seq long, score double, threshold double, grade double")
