"""Forests as tables: train on a bounded sample, keep nodes as rows, query any DataFrame of points.

Training shuffles at most trees * sample_size rows of each task. The node table has at most groups * trees *
(2 * sample_size - 1) rows; queries broadcast it where that bound is small and otherwise join by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform_np
from .forest_kernel import Forest, Nodes, Tree
from .sampling import reservoir

NODE = (
    "tree int, node int, parent int, left int, right int, dim int, cut double, mass int, depth int, path long, leaf int, low array<double>, high array<double>, leaf_seqs array<long>"
)
BROADCAST_NODES = 2_000_000


class Options:
    """Forest parameters with their checks."""

    def __init__(self, trees: int = 50, sample_size: int = 256, decay: float | None = None, seed: int = 42, output_after: int | None = None) -> None:
        if trees < 1 or sample_size < 1:
            raise ValueError("trees and sample_size must be positive")
        if decay is not None and decay < 0:
            raise ValueError("decay must not be negative")
        if output_after is not None and output_after < 1:
            raise ValueError("output_after must be positive")
        self.trees, self.sample_size, self.seed = trees, sample_size, seed
        self.decay = 1.0 / (10 * sample_size) if decay is None else decay
        self.output_after = max(1, sample_size // 4) if output_after is None else output_after


def train(points: DataFrame, options: Options, x: str = "x", seq: str = "seq", by: list[str] | None = None, weight: str | None = None, attributes: list[str] | None = None) -> DataFrame:
    """The node table of a forest over points (seq, x: array), one forest for each group of `by`.

    attributes: numeric columns added up over each node's subtree, as columns sum_<name>.
    """
    by, attributes = by or [], attributes or []
    keep = points.select(*by, F.col(seq).alias("seq"), F.col(x).cast("array<double>").alias("x"), *([F.col(weight).alias("w")] if weight else []), *(F.col(a).cast("double").alias(a) for a in attributes))
    sample = reservoir(keep.where("x is not null"), options.trees, options.sample_size, options.decay, "w" if weight else None, options.seed, "seq", by)
    kinds = dict(points.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in by) + NODE + "".join(f", sum_{a} double" for a in attributes)
    seed = options.seed

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        t = Tree.build(np.array(group["x"].tolist(), float), int(group["tree"].iloc[0]), seed)
        n = len(t.left)
        seqs = group["seq"].to_numpy()
        pts = np.array(group["x"].tolist(), float)
        members: dict[int, list[int]] = {int(k): [] for k in np.flatnonzero(t.left < 0)}
        for s, leaf in zip(seqs, t.descend(pts)[-1], strict=True):
            members[int(leaf)].append(int(s))
        out = pd.DataFrame(
            {"tree": int(group["tree"].iloc[0]), "node": np.arange(n), "parent": t.parent, "left": t.left, "right": t.right, "dim": t.dim, "cut": t.cut, "mass": t.mass, "depth": t.depth, "path": t.path, "leaf": t.leaf}
        )
        out["low"], out["high"] = list(t.low), list(t.high)
        out["leaf_seqs"] = [sorted(members[k]) if k in members else None for k in range(n)]
        for a in attributes:
            sums = np.zeros(n)
            np.add.at(sums, t.descend(pts)[-1], group[a].to_numpy(float))
            for k in range(n - 1, 0, -1):  # children come after their parents
                sums[t.parent[k]] += sums[k]
            out[f"sum_{a}"] = sums
        for k in by:
            out[k] = group[k].iloc[0]
        return out

    return sample.groupBy(*by, "tree").applyInPandas(build, schema)


def forest_of(nodes: pd.DataFrame) -> Forest:
    """The forest in a node table's rows (of one group)."""
    trees, points, seqs = [], [], []
    for _, g in nodes.groupby("tree", sort=True):
        g = g.sort_values("node")
        low, high = np.array(g["low"].tolist(), float), np.array(g["high"].tolist(), float)
        t = Tree(left=g["left"].to_numpy(), right=g["right"].to_numpy(), parent=g["parent"].to_numpy(), dim=g["dim"].to_numpy(), cut=g["cut"].to_numpy(float), mass=g["mass"].to_numpy(), depth=g["depth"].to_numpy(), path=g["path"].to_numpy(), leaf=g["node"].to_numpy().copy(), low=low, high=high)
        trees.append(t)
        points.append(low)  # a leaf's box is its point; leaf is its node number
        seqs.append(np.array([s[0] if s is not None and len(s) else -1 for s in g["leaf_seqs"]]))
    return Forest(trees, points, seqs)


def load(nodes: DataFrame, most: int = BROADCAST_NODES) -> Forest:
    """The forest of one group at the driver, after a check of its size."""
    found = nodes.limit(most + 1).toPandas()  # read once: nodes may still have to be trained
    if len(found) > most:
        raise ValueError(f"more than {most} nodes; query by group instead")
    return forest_of(found)


def query(points: DataFrame, nodes: DataFrame, f, schema: str, x: str = "x", keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """keep columns and what f returns for each point: f(forest, points array) -> dict of arrays, one row for each point.

    This is the extension point: any function of the forest's trees can be given. Without `by` the forest is broadcast
    and the points are not shuffled; with it each group of points meets its own forest.
    """
    keep = keep or []
    kinds = dict(points.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keep)
    rows = points.select(*keep, F.col(x).cast("array<double>").alias("__x"))

    def apply(forest: Forest, part: pd.DataFrame) -> pd.DataFrame:
        out = part[keep].reset_index(drop=True)
        for name, v in f(forest, np.array(part["__x"].tolist(), float)).items():
            out[name] = list(v) if getattr(v, "ndim", 1) > 1 else v
        return out

    if not by:
        sent = points.sparkSession.sparkContext.broadcast(load(nodes))

        def run(parts):
            for part in parts:
                for at in range(0, len(part), 2048):
                    yield apply(sent.value, part.iloc[at : at + 2048])

        return rows.where("__x is not null").mapInPandas(run, head + schema)

    def each(key, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(model):
            return pd.DataFrame()
        return apply(forest_of(model), part)

    return rows.where("__x is not null").groupBy(*by).cogroup(nodes.groupBy(*by)).applyInPandas(each, head + schema)


def scores(points, nodes, after: int = 1, **how):
    """score; 0 for all points while the model's trees hold fewer than `after` points (Options.output_after)."""

    def f(forest, q):
        ready = bool(forest.trees) and max(t.total for t in forest.trees) >= after
        return {"score": forest.score(q) if ready else np.zeros(len(q))}

    return query(points, nodes, f, "score double", **how)


def displacements(points, nodes, **how):
    return query(points, nodes, lambda f, q: {"score": f.displacement(q)}, "score double", **how)


def dynamic_scores(points, nodes, seen, unseen, damp, ignore: int = 0, normalizer=None, **how):
    """Mean over trees of a score with the caller's functions of depth and mass; not normalised unless a normaliser is given."""
    n = normalizer or (lambda s, m: s)
    return query(points, nodes, lambda f, q: {"score": f.raw_score(q, n, seen_f=seen, unseen_f=unseen, damp_f=damp, ignore=ignore)}, "score double", **how)


def approximate_scores(points, nodes, precision: float = 0.1, high_is_critical: bool = True, score: dict | None = None, **how):
    """Means over as many trees as it takes; `score`: the caller's seen_f, unseen_f, damp_f, ignore and normalizer."""
    def f(forest, q):
        mean, used = forest.approximate_score(q, precision, high_is_critical=high_is_critical, **(score or {}))
        return {"score": mean, "trees_used": used}

    return query(points, nodes, f, "score double, trees_used int", **how)


def approximate_attributions(points, nodes, precision: float = 0.1, high_is_critical: bool = True, score: dict | None = None, **how):
    def f(forest, q):
        high, low, used = forest.approximate_attribution(q, precision, high_is_critical=high_is_critical, **(score or {}))
        return {"total": high.sum(1) + low.sum(1), "high": high, "low": low, "trees_used": used}

    return query(points, nodes, f, "total double, high array<double>, low array<double>, trees_used int", **how)


def attributions(points, nodes, **how):
    def f(forest, q):
        high, low = forest.attribution(q)
        return {"score": high.sum(1) + low.sum(1), "high": high, "low": low}

    return query(points, nodes, f, "score double, high array<double>, low array<double>", **how)


def dynamic_attributions(points, nodes, seen, unseen, damp, ignore: int = 0, **how):
    def f(forest, q):
        parts = [t.attribution(q, seen_f=seen, unseen_f=unseen, damp_f=damp, ignore=ignore) for t in forest.trees]
        return {"high": np.mean([p[0] for p in parts], axis=0), "low": np.mean([p[1] for p in parts], axis=0)}

    return query(points, nodes, f, "high array<double>, low array<double>", **how)


def densities(points, nodes, q_share: float = 0.001, **how):
    def f(forest, q):
        found = forest.density(q)
        d = forest.directional_density(found, q_share)
        return {"density": forest.density_value(found, q_share), "up": d[:, :, 0], "down": d[:, :, 1], "prob_up": found["prob"][:, :, 0], "prob_down": found["prob"][:, :, 1]}

    return query(points, nodes, f, "density double, up array<double>, down array<double>, prob_up array<double>, prob_down array<double>", **how)


def neighbours(points, nodes, within: float = float("inf"), **how):
    """near: the distinct candidates (point, distance, seqs, count) of each point, nearest first."""
    def f(forest, q):
        return {"near": [[{"point": list(p), "distance": d, "seqs": s, "count": n} for p, d, s, n in near] for near in forest.neighbours_of(q, within)]}

    return query(points, nodes, f, "near array<struct<point:array<double>,distance:double,seqs:array<bigint>,count:int>>", **how)


def imputed(points, nodes, missing: list[int], **how):
    """filled: each point with its missing coordinates taken from the forest's conditional field."""
    return query(points, nodes, lambda f, q: {"filled": f.impute_many(*f._marked(q, missing))}, "filled array<double>", **how)


def conditional_summaries(points, nodes, missing: list[int], centrality: float = 1.0, **how):
    def f(forest, q):
        s = list(forest.summaries(q, missing, centrality))
        return {k: np.array([e[k] for e in s]) for k in ("mean", "median", "deviation", "lower", "upper")} | {"total": np.array([float(e["total"]) for e in s])}

    return query(points, nodes, f, "mean array<double>, median array<double>, deviation array<double>, lower array<double>, upper array<double>, total double", **how)


def extrapolations(points, nodes, inputs: int, horizon: int, cyclic: bool = False, **how):
    """value, lower, upper: horizon * inputs numbers each, step after step."""
    def f(forest, q):
        e = [forest.extrapolate(x, inputs, horizon, cyclic) for x in q]
        return {k: np.array([v[k].ravel() for v in e]) for k in ("value", "lower", "upper")}

    return query(points, nodes, f, "value array<double>, lower array<double>, upper array<double>", **how)


def own_extrapolations(points: DataFrame, options: Options, inputs: int, horizon: int, by: list[str], x: str = "x", seq: str = "seq", cyclic: bool = False) -> DataFrame:
    """extrapolations() of each group's last point (of greatest seq) by train()'s forest of that group, without a node table.

    A group's rows reach one task in order. Of a group that a batch leaves open its samples are kept and no other rows;
    the forests of all groups that end in a batch are grown and asked together. All points have as many dimensions.
    """
    kinds, trees, size = dict(points.dtypes), options.trees, options.sample_size
    schema = "".join(f"{k} {kinds[k]}, " for k in by) + "value array<double>, lower array<double>, upper array<double>"

    def sampled(s: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree the sampled rows of all groups and the numbers of their samples."""
        for t in range(trees):
            order = np.lexsort((s, -options.decay * s + np.log(-np.log(uniform_np(s, t, 1, options.seed))), group))
            g = group[order]
            take = order[np.arange(len(g)) - np.searchsorted(g, g, "left") < size]
            yield take, group[take] * trees + t

    def answer(heads: pa.Table, samples: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, at = (np.concatenate([s[k] for s in samples]) for k in (0, 1))
        order = np.argsort(at, kind="stable")  # tree after tree of one group after the other
        nodes = Nodes.grow(x[rows[order]], np.bincount(at), np.tile(np.arange(trees), len(last)), options.seed)
        found = nodes.extrapolate(x[last], nodes.roots.reshape(len(last), trees), inputs, horizon, cyclic)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(last) + 1, dtype=np.int32) * horizon * inputs), pa.array(found[k].ravel())) for k in ("value", "lower", "upper")]
        yield from pa.table([*heads.columns, *lists], names=[*by, "value", "lower", "upper"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Table, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, s = pa.Table.from_batches([batch]).select(by), batch.column("seq").to_numpy(zero_copy_only=False)
            q = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(s), -1)
            if held:
                heads, s, q = pa.concat_tables([held[0], heads]), np.concatenate([held[1], s]), np.concatenate([held[2], q])
            group = heads.to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            samples = list(sampled(s, group))
            whole, last = group[-1], np.append(np.flatnonzero(np.diff(group)), len(group) - 1)
            if whole:
                yield from answer(heads.take(pa.array(last[:-1])), [(r[at < whole * trees], at[at < whole * trees]) for r, at in samples], q, last[:-1])
            mine = np.unique(np.concatenate([r[at >= whole * trees] for r, at in samples] + [last[-1:]]))
            held = heads.take(pa.array(mine)), s[mine], q[mine]
        if held:
            last = np.array([len(held[1]) - 1])
            yield from answer(held[0].take(pa.array(last)), list(sampled(held[1], np.zeros(len(held[1]), np.int64))), held[2], last)

    rows = points.select(*by, F.col(seq).cast("long").alias("seq"), F.col(x).cast("array<double>").alias("x")).where("x is not null")
    return rows.repartition(*by).sortWithinPartitions(*by, "seq").mapInArrow(run, schema)


def simulated_scores(points, nodes, separation, **how):
    """Scores as if cuts were drawn by another separation vector: every node is reweighted by how likely it would be cut so.

    separation(low, high) -> weight of each dimension, for boxes of shape (rows, dims).
    """

    def one(t: Tree, q: np.ndarray) -> np.ndarray:
        leaf, equal, _, levels = t._walk(q, 0)
        d, m = t.depth[leaf].astype(float), t.mass[leaf].astype(float)
        s = np.where(equal, (1 - m / (2 * t.total)) / (d + np.log2(m + 1)), 1 / (d + 1))
        for rows, node, _, _ in levels:
            low, high = np.minimum(t.low[node], q[rows]), np.maximum(t.high[node], q[rows])
            whole, inner = separation(low, high), separation(t.low[node], t.high[node])
            total = whole.sum(1)
            p = np.where(total > 0, np.maximum(whole - inner, 0).sum(1) / np.where(total > 0, total, 1), 0.0)
            s[rows] = p / (t.depth[node] + 1.0) + (1 - p) * s[rows]
        return s * np.log2(t.total + 1.0)

    return query(points, nodes, lambda f, q: {"score": np.mean([one(t, q) for t in f.trees], axis=0)}, "score double", **how)


def centres_of_mass(nodes: DataFrame) -> DataFrame:
    """(tree, node, mass, centre): the mean point below every node, added up from the leaves."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node").set_index("node")
        dims = len(group["low"].iloc[0])
        sums = np.zeros((len(group), dims))
        for k in range(len(group) - 1, -1, -1):
            r = group.loc[k]
            if r["left"] < 0:
                sums[k] = np.asarray(r["low"]) * r["mass"]
            if r["parent"] >= 0:
                sums[r["parent"]] += sums[k]
        out = pd.DataFrame({"tree": group["tree"], "node": group.index, "mass": group["mass"]})
        out["centre"] = list(sums / group["mass"].to_numpy()[:, None])
        return out

    return nodes.select("tree", "node", "parent", "left", "mass", "low").groupBy("tree").applyInPandas(fold, "tree int, node int, mass int, centre array<double>")


def sizes(nodes: DataFrame) -> DataFrame:
    """(tree, nodes, leaves, points, depth): what a model holds."""
    leaf = F.col("left") < 0
    return nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.sum(F.when(leaf, 1).otherwise(0)).alias("leaves"), F.sum(F.when(leaf, F.col("mass")).otherwise(0)).alias("points"), F.max("depth").cast("long").alias("depth"))


def save(nodes: DataFrame, path: str) -> None:
    """Persist a model; its rows are the model."""
    nodes.write.mode("overwrite").parquet(path)


def valid(nodes: DataFrame) -> DataFrame:
    """(tree, valid): does each restored tree meet the invariants of a cut tree."""

    def check(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [int(group["tree"].iloc[0])], "valid": [forest_of(group).trees[0].check()]})

    return nodes.groupBy("tree").applyInPandas(check, "tree int, valid boolean")
