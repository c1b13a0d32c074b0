"""Trees of random cuts in numpy: build, and queries for many points at once. No Spark in here.

A tree is built top down from a sample: at each node a position is drawn uniformly along the sum of the box's ranges;
it names the dimension and the place of the cut. Draws come from a counter (seed, tree, path of the node), so a tree is
a function of its sample alone. Boxes are nested, so the leaf-to-root recursions below need no early exit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from ..functions.rng import P, uniform_np

LOG2 = math.log(2.0)


def seen(depth, mass):
    return 1.0 / (depth + np.log2(mass + 1.0))


def unseen(depth, mass=None):
    return 1.0 / (depth + 1.0)


def damp(leaf_mass, tree_mass):
    return 1.0 - leaf_mass / (2.0 * tree_mass)


def log_normalizer(score, mass):
    return score * np.log2(mass + 1.0)


def displacement_seen(depth, mass):
    return 1.0 / (1.0 + mass)


def displacement_unseen(depth, mass):
    return np.asarray(mass, float)


def no_damp(leaf_mass, tree_mass):
    return 1.0


def grown(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, seed: int = 42) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(the nodes of all trees, one tree after the other, by field of Tree; each tree's first node).

    The points of tree k are the next sizes[k] rows of x. All open nodes of a level are cut together; left, right,
    parent and leaf count inside a tree.
    """
    local = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.arange(len(x))
    # one segment of `order` for each open node: its tree, parent, side, path
    start, tree = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.arange(len(sizes))
    parent, side, path = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    made, depth, levels = np.zeros(len(sizes), np.int64), 0, []
    while len(start):
        count = np.diff(np.concatenate([start, [len(order)]]))
        part = x[order]
        low, high = np.minimum.reduceat(part, start), np.maximum.reduceat(part, start)
        first = np.minimum.reduceat(local[order], start)
        ranges = high - low
        run = np.cumsum(ranges, axis=1)
        total = ranges.sum(1)
        inner = total > 0
        r = uniform_np(path, numbers[tree], 3, seed) * total
        d = np.minimum((run <= r[:, None]).sum(1), x.shape[1] - 1)
        rows = np.arange(len(d))
        bad = inner & (ranges[rows, d] <= 0)  # rounding at the end of the line
        if bad.any():
            d[bad] = x.shape[1] - 1 - (ranges[bad][:, ::-1] > 0).argmax(1)
        lo, hi = low[rows, d], high[rows, d]
        cut = lo + (r - (run[rows, d] - ranges[rows, d]))
        cut = np.maximum(np.where(cut >= hi, np.nextafter(hi, lo), cut), lo)
        number = np.empty(len(start), np.int64)  # nodes of one tree are numbered as they come
        rank = np.arange(len(tree)) - np.searchsorted(tree, tree, "left")
        number[:] = made[tree] + rank
        np.add.at(made, tree, 1)
        levels.append((tree, number, parent, side, np.where(inner, d, -1), np.where(inner, cut, 0.0), count, path, np.where(inner, -1, first), low, high, depth))
        if not inner.any():
            break
        seg = np.repeat(rows, count)
        stay = inner[seg]
        order, seg = order[stay], seg[stay]
        right = x[order, d[seg]] > cut[seg]
        key = seg * 2 + right
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        up, side = key[start] // 2, key[start] % 2
        tree, parent, path = tree[up], number[up], (2 * path[up] + side) % P
        depth += 1
    cols = [np.concatenate([lv[c] for lv in levels]) for c in range(11)]
    tree, number, parent, side = cols[:4]
    first = np.concatenate([[0], np.cumsum(made)[:-1]])
    at = first[tree] + number
    out = {f: np.empty_like(v) for f, v in zip(("parent", "dim", "cut", "mass", "path", "leaf", "low", "high"), [parent, *cols[4:]], strict=True)}
    for f, v in zip(out, [parent, *cols[4:]], strict=True):
        out[f][at] = v
    out["depth"] = np.empty_like(number)
    out["depth"][at] = np.concatenate([np.full(len(lv[0]), lv[11]) for lv in levels])
    for f, s in (("left", 0), ("right", 1)):
        out[f] = np.full(len(at), -1)
        of = np.flatnonzero((parent >= 0) & (side == s))
        out[f][first[tree[of]] + parent[of]] = number[of]
    return out, first


class Tree:
    """Nodes in arrays; node 0 is the root; leaves have left -1 and carry the index of their point."""

    FIELDS = ("left", "right", "parent", "dim", "cut", "mass", "depth", "path", "leaf", "low", "high")

    def __init__(self, **arrays) -> None:
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    @classmethod
    def build(cls, points: np.ndarray, tree: int = 0, seed: int = 42) -> Tree:
        return cls.build_many([points], [tree], seed)[0]

    @classmethod
    def build_many(cls, samples: list[np.ndarray], numbers: list[int], seed: int = 42) -> list[Tree]:
        """Several trees at once; `numbers` name the trees to the draws."""
        if any(not len(x) for x in samples):
            raise ValueError("a tree needs points")
        sizes = np.array([len(s) for s in samples])
        cols, first = grown(np.concatenate([np.asarray(s, np.float64) for s in samples]), sizes, np.asarray(numbers, np.int64), seed)
        ends = np.append(first[1:], len(cols["left"]))
        return [cls(**{f: v[a:b].copy() for f, v in cols.items()}) for a, b in zip(first, ends, strict=True)]

    def lists(self) -> tuple:
        """The arrays as plain lists, for walks of a single point."""
        if not hasattr(self, "_lists"):
            self._lists = tuple(getattr(self, f).tolist() for f in ("left", "right", "dim", "cut", "mass", "depth", "low", "high"))
        return self._lists

    def score_one(self, x: list[float]) -> float:
        """score() of one point without arrays."""
        left, right, dim, cut, mass, depth, low, high = self.lists()
        way, node = [], 0
        while left[node] >= 0:
            way.append(node)
            node = left[node] if x[dim[node]] <= cut[node] else right[node]
        d, m = depth[node], mass[node]
        if low[node] == x:
            return (1 - m / (2 * mass[0])) / (d + math.log2(m + 1))
        s = 1 / (d + 1)
        for n in reversed(way):
            out = size = 0.0
            for v, lo, hi in zip(x, low[n], high[n], strict=True):
                size += hi - lo
                if v > hi:
                    out += v - hi
                elif v < lo:
                    out += lo - v
            if out <= 0:
                break  # boxes further up hold the point as well
            p = out / (out + size)
            s = p / (depth[n] + 1) + (1 - p) * s
        return s

    @property
    def total(self) -> int:
        return int(self.mass[0])

    def descend(self, q: np.ndarray) -> list[np.ndarray]:
        """Nodes on each query's way, level by level; a query that has reached its leaf stays there."""
        at = np.zeros(len(q), np.int64)
        way = [at]
        rows = np.arange(len(q))
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return way
            d = np.maximum(self.dim[at], 0)
            nxt = np.where(q[rows, d] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, nxt, at)
            way.append(at)

    def gaps(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How far each query lies above and below a box, by dimension, and the range sum of the box with it."""
        up, down = np.maximum(q - high, 0.0), np.maximum(low - q, 0.0)
        return up, down, (high - low).sum(1) + up.sum(1) + down.sum(1)

    def _walk(self, q: np.ndarray, ignore: int):
        """(leaf, equal, light, levels): levels from the leaf's parent up, each (rows, node, low, high) to measure with.

        Equal queries are measured with shadow boxes, which leave out the leaf itself.
        """
        way = self.descend(q)
        leaf = way[-1]
        equal = (self.low[leaf] == q).all(1)
        light = equal & (self.mass[leaf] <= ignore)
        shade_low = np.full(q.shape, np.inf)
        shade_high = np.full(q.shape, -np.inf)
        levels = []
        for below, at in zip(way[:0:-1], way[-2::-1], strict=True):
            rows = np.flatnonzero(below != at)
            if not len(rows):
                continue
            node, child = at[rows], below[rows]
            sib = np.where(self.left[node] == child, self.right[node], self.left[node])
            shade_low[rows] = np.minimum(shade_low[rows], self.low[sib])
            shade_high[rows] = np.maximum(shade_high[rows], self.high[sib])
            levels.append((rows, node, shade_low[rows], shade_high[rows]))
        return leaf, equal, light, levels

    def score(self, q: np.ndarray, seen_f: Callable = seen, unseen_f: Callable = unseen, damp_f: Callable = damp, ignore: int = 0) -> np.ndarray:
        """Expected score of each query, not normalised."""
        leaf, equal, light, levels = self._walk(q, ignore)
        d, m = self.depth[leaf].astype(float), self.mass[leaf].astype(float)
        known = equal & ~light
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(known, damp_f(m, self.total) * seen_f(d, m), unseen_f(d, m))
        for rows, node, lo, hi in levels:
            shadow = light[rows]
            low = np.where(shadow[:, None], lo, self.low[node])
            high = np.where(shadow[:, None], hi, self.high[node])
            up, down, size = self.gaps(q[rows], low, high)
            out = up.sum(1) + down.sum(1)
            p = np.where(out > 0, out / np.where(size > 0, size, 1.0), 0.0)
            s[rows] = p * unseen_f(self.depth[node].astype(float), self.mass[node].astype(float)) + (1 - p) * s[rows]
        return s

    def attribution(self, q: np.ndarray, seen_f: Callable = seen, unseen_f: Callable = unseen, damp_f: Callable = damp, ignore: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(high, low) of each query and dimension; their sum over dimensions is the score."""
        leaf, equal, light, levels = self._walk(q, ignore)
        dims = q.shape[1]
        d, m = self.depth[leaf].astype(float), self.mass[leaf].astype(float)
        known = equal & ~light
        with np.errstate(divide="ignore", invalid="ignore"):
            saved = np.where(known, damp_f(m, self.total) * seen_f(d, m), unseen_f(d, m))
        up, down, size = self.gaps(q, self.low[leaf], self.high[leaf])
        safe = np.where(size > 0, size, 1.0)[:, None]
        even = (saved / (2 * dims))[:, None]
        high = np.where(equal[:, None], even, saved[:, None] * up / safe)
        low = np.where(equal[:, None], even, saved[:, None] * down / safe)
        for rows, node, lo, hi in levels:
            shadow = equal[rows][:, None]
            up, down, size = self.gaps(q[rows], np.where(shadow, lo, self.low[node]), np.where(shadow, hi, self.high[node]))
            size = np.where(size > 0, size, 1.0)[:, None]
            new = unseen_f(self.depth[node].astype(float), self.mass[node].astype(float))[:, None]
            rest = 1 - (up.sum(1) + down.sum(1))[:, None] / size
            high[rows] = up / size * new + rest * high[rows]
            low[rows] = down / size * new + rest * low[rows]
        total = high.sum(1) + low.sum(1)
        fix = np.where(known & (total > 0), saved / np.where(total > 0, total, 1.0), 1.0)[:, None]
        return high * fix, low * fix

    def density(self, q: np.ndarray) -> dict[str, np.ndarray]:
        """measure, distance and probability of mass, each (queries, dimensions, direction: above, below)."""
        leaf, equal, _, levels = self._walk(q, 0)
        dims = q.shape[1]
        own = np.where(equal, 1.0 + self.mass[leaf], 1.0)
        up, down, size = self.gaps(q, self.low[leaf], self.high[leaf])
        gap = np.stack([up, down], 2)
        share = np.where(equal[:, None, None], 0.5 / dims, gap / np.where(size > 0, size, 1.0)[:, None, None])
        prob = share.copy()
        measure = np.where(equal[:, None, None], 0.5 * self.mass[leaf][:, None, None] / dims, share * (self.mass[leaf] + own)[:, None, None])
        distance = np.where(equal[:, None, None], 0.0, share * gap)
        for rows, node, lo, hi in levels:
            shadow = equal[rows][:, None]
            low, high = np.where(shadow, lo, self.low[node]), np.where(shadow, hi, self.high[node])
            up, down, size = self.gaps(q[rows], low, high)
            gap = np.stack([up, down], 2)
            share = gap / np.where(size > 0, size, 1.0)[:, None, None]
            rest = 1 - share.sum((1, 2), keepdims=True)
            prob[rows] = share + rest * prob[rows]
            measure[rows] = share * (self.mass[node] + own[rows])[:, None, None] + rest * measure[rows]
            distance[rows] = share * (gap + (high - low)[:, :, None]) + rest * distance[rows]
        return {"measure": measure, "distance": distance, "prob": prob}

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf's point index, Euclidean distance) of each query: one candidate for each tree."""
        leaf = self.descend(q)[-1]
        return self.leaf[leaf], np.sqrt(((q - self.low[leaf]) ** 2).sum(1))

    def check(self) -> bool:
        """Every inner node's cut divides its children's boxes, masses add up, boxes are nested."""
        inner = np.flatnonzero(self.left >= 0)
        a, b, d = self.left[inner], self.right[inner], self.dim[inner]
        ok = (self.mass[a] + self.mass[b] == self.mass[inner]).all()
        ok &= (self.high[a, d] <= self.cut[inner]).all() and (self.low[b, d] > self.cut[inner]).all()
        ok &= (np.minimum(self.low[a], self.low[b]) == self.low[inner]).all() and (np.maximum(self.high[a], self.high[b]) == self.high[inner]).all()
        return bool(ok)


class Nodes:
    """Nodes of several trees in common arrays; a leaf is its own child on both sides."""

    def __init__(self, kids: np.ndarray, dim: np.ndarray, cut: np.ndarray, mass: np.ndarray, low: np.ndarray, high: np.ndarray, roots: np.ndarray) -> None:
        self.kids, self.dim, self.cut, self.mass, self.low, self.high, self.roots = kids, dim, cut, mass, low, high, roots

    @classmethod
    def of(cls, trees: list[Tree]) -> Nodes:
        sizes = np.array([len(t.left) for t in trees])
        roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        join = lambda f: np.concatenate([getattr(t, f) for t in trees])
        kids, base = np.stack([join("left"), join("right")], 1), np.repeat(roots, sizes)[:, None]
        kids = np.where(kids < 0, np.arange(len(kids))[:, None], kids + base)
        return cls(kids, np.maximum(join("dim"), 0), join("cut"), join("mass"), join("low"), join("high"), roots)

    @classmethod
    def grow(cls, x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, seed: int = 42) -> Nodes:
        """As of(Tree.build_many()), from points laid end to end."""
        cols, first = grown(x, sizes, numbers, seed)
        kids, base = np.stack([cols["left"], cols["right"]], 1), np.repeat(first, np.diff(np.append(first, len(cols["left"]))))[:, None]
        kids = np.where(kids < 0, np.arange(len(kids))[:, None], kids + base)
        return cls(kids, np.maximum(cols["dim"], 0), cols["cut"], cols["mass"], cols["low"], cols["high"], first)

    def complete(self, q: np.ndarray, gone: np.ndarray, centrality: float = 1.0, seed: int = 42, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, L1 distance over known dimensions), each (queries, trees): the most ordinary way to complete each query.

        gone marks the missing dimensions of each query. Where the cut is on one of them both sides are followed and
        the lesser adjusted rank wins. All queries and trees go down and come up again level by level. roots: the trees
        of each query (queries, trees), where they are not the same for all.
        """
        roots = np.broadcast_to(self.roots, (len(q), len(self.roots))) if roots is None else roots
        many, trees = roots.shape
        node, row = roots.ravel(), np.repeat(np.arange(many), trees)
        tree, levels = np.tile(np.arange(trees), many), []
        while len(node):
            inner = np.flatnonzero(self.kids[node, 0] != node)
            at, of = node[inner], row[inner]
            d = self.dim[at]
            both, left = gone[of, d], q[of, d] <= self.cut[at]
            a, b = np.flatnonzero(both | left), np.flatnonzero(both | ~left)
            levels.append((node, row, tree, inner, a, b, both))
            node, row, tree = (np.concatenate([one[a], two[b]]) for one, two in ((self.kids[at, 0], self.kids[at, 1]), (of, of), (tree[inner], tree[inner])))
        rank = leaf = dist = draw = np.zeros(0)
        for depth in range(len(levels) - 1, -1, -1):
            node, row, tree, inner, a, b, both = levels[depth]
            below = rank, leaf, dist, draw
            x, known = q[row], ~gone[row]
            low, high = self.low[node], self.high[node]
            out = (np.maximum(np.maximum(low - x, x - high), 0.0) * known).sum(1)
            own = out <= 0
            # as leaves; inner nodes are overwritten
            rank = np.where(own, 1 / (depth + np.log2(self.mass[node] + 1.0)) if depth else 0.0, 1 / (depth + 1))
            leaf, dist = node.copy(), out.copy()
            draw = uniform_np(node - roots[row, tree], tree, 5, seed) if centrality != 1 else np.zeros(len(node))
            if len(inner):
                # each inner node's visited sides among the next level's entries; -1 where a side was not visited
                first, second = np.full(len(inner), -1), np.full(len(inner), -1)
                first[a], second[b] = np.arange(len(a)), len(a) + np.arange(len(b))
                adjusted = (1 - centrality) * below[3] + centrality * below[0]
                pick = np.where(first < 0, second, first)
                twice = np.flatnonzero(both)
                pick[twice] = np.where(adjusted[first[twice]] <= adjusted[second[twice]], first[twice], second[twice])
                wide = (high - low)[inner].sum(1)
                p = out[inner] / np.where(out[inner] > 0, out[inner] + wide, 1.0)
                rank[inner] = p / (depth + 1) + (1 - p) * below[0][pick]
                leaf[inner], dist[inner], draw[inner] = below[1][pick], below[2][pick], below[3][pick]
        return leaf.reshape(many, trees), dist.reshape(many, trees)

    def extrapolate(self, shingles: np.ndarray, roots: np.ndarray, inputs: int, horizon: int, cyclic: bool = False, at: int = 0, centrality: float = 1.0, percentile: float = 0.9) -> dict[str, np.ndarray]:
        """Forest.extrapolate() of each shingle by its own trees (roots: shingles, trees): value, lower, upper (shingles, horizon, inputs)."""
        q = np.array(shingles, float)
        size = q.shape[1] // inputs
        out = {k: np.zeros((len(q), horizon, inputs)) for k in ("value", "lower", "upper")}
        for h in range(horizon):
            if cyclic:
                block = ((at + h) % size) * inputs
            else:
                q[:, :-inputs] = q[:, inputs:]
                block = q.shape[1] - inputs
            idx = slice(block, block + inputs)
            gone = np.zeros(q.shape, bool)
            gone[:, idx] = True
            leaf, dist = self.complete(np.where(gone, 0.0, q), gone, centrality, roots=roots)
            found = completed(self.low[leaf, idx], dist, centrality, percentile)
            q[:, idx] = found["value"]
            for k, v in found.items():
                out[k][:, h] = v
        return out


def completed(values: np.ndarray, dist: np.ndarray, centrality: float = 1.0, percentile: float = 0.9) -> dict[str, np.ndarray]:
    """Median and bounds as in Forest.summaries(), of many queries at once: values (queries, trees, dimensions), dist (queries, trees).

    A point that several trees found counts once for each, which is its weight there.
    """
    keep = np.ones(dist.shape, bool)
    if centrality > 0:
        near = np.sort(dist, axis=1)
        run = np.cumsum(near > 0, axis=1)
        limit = centrality * near[np.arange(len(near)), (run < 0.5 * run[:, -1:]).sum(1)] + 1e-6
        limit += (1 - centrality) * near[:, -1]
        keep = dist <= limit[:, None]
    total, rank = keep.sum(1)[:, None], np.arange(1, dist.shape[1] + 1)
    value = np.sort(np.where(keep[:, :, None], values, np.inf), axis=1)
    pick = lambda p: np.take_along_axis(value, np.minimum((rank < p * total - 1e-9).sum(1), total[:, 0] - 1)[:, None, None], 1)[:, 0]
    return {"value": pick(0.5), "lower": pick(1 - percentile), "upper": pick(percentile)}


def early_mean(values, precision: float = 0.1, least: int = 5, high_is_critical: bool = True) -> tuple[float, int]:
    """One-sided mean that stops early: (mean, values used). A witness lies on the critical side by half a deviation."""
    total = square = 0.0
    witnesses, need = 0, max(1, round(1 / precision))
    sign = 1.0 if high_is_critical else -1.0
    n = 0
    for n, v in enumerate(values, 1):  # noqa: B007
        total += v
        square += v * v
        mean = total / n
        dev = math.sqrt(max(0.0, square / n - mean * mean))
        if n >= least:
            witnesses += sign * (v - mean) + 1e-6 > 0.5 * dev
            if witnesses >= need:
                break
    return (total / n if n else 0.0), n


class Forest:
    """Trees over one table of points; queries are means over trees."""

    def __init__(self, trees: list[Tree], points: list[np.ndarray], seqs: list[np.ndarray] | None = None) -> None:
        self.trees, self.points, self.seqs = trees, points, seqs or [np.arange(len(p)) for p in points]
        self._nodes: Nodes | None = None

    @property
    def nodes(self) -> Nodes:
        if self._nodes is None:
            self._nodes = Nodes.of(self.trees)
        return self._nodes

    @classmethod
    def build(cls, samples: list[np.ndarray], seed: int = 42, seqs: list[np.ndarray] | None = None) -> Forest:
        return cls(Tree.build_many(samples, list(range(len(samples))), seed), samples, seqs)

    def score(self, q: np.ndarray, **how) -> np.ndarray:
        q = np.atleast_2d(np.asarray(q, float))
        return np.mean([log_normalizer(t.score(q, **how), t.total) for t in self.trees], axis=0)

    def score_one(self, x) -> float:
        x = [float(v) for v in x]
        return sum(t.score_one(x) * math.log2(t.total + 1.0) for t in self.trees) / len(self.trees)

    def raw_score(self, q: np.ndarray, normalizer: Callable = lambda s, m: s, **how) -> np.ndarray:
        q = np.atleast_2d(np.asarray(q, float))
        return np.mean([normalizer(t.score(q, **how), t.total) for t in self.trees], axis=0)

    def displacement(self, q: np.ndarray, ignore: int = 0) -> np.ndarray:
        return self.raw_score(q, lambda s, m: s / (1.0 + m), seen_f=displacement_seen, unseen_f=displacement_unseen, damp_f=no_damp, ignore=ignore)

    def approximate(self, q: np.ndarray, each: Callable, precision: float = 0.1, least: int = 5, high_is_critical: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(means over trees, trees used) by the rule of early_mean for each query: a tree sees only the queries still open.

        each(tree, queries) gives one row of numbers for each query; their sum decides when a query's mean is good enough.
        """
        q = np.atleast_2d(np.asarray(q, float))
        if not self.trees or not len(q):
            return np.zeros((len(q), 1)), np.zeros(len(q), np.int64)
        need, sign, opened = max(1, round(1 / precision)), 1.0 if high_is_critical else -1.0, np.arange(len(q))
        sums, square, used, witnesses = None, np.zeros(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k, tree in enumerate(self.trees, 1):
            got = np.asarray(each(tree, q[opened]), float).reshape(len(opened), -1)
            sums = np.zeros((len(q), got.shape[1])) if sums is None else sums
            judged = got.sum(1)
            sums[opened] += got
            square[opened] += judged**2
            used[opened] = k
            mean = sums[opened].sum(1) / k
            if k >= least:
                dev = np.sqrt(np.maximum(0.0, square[opened] / k - mean**2))
                witnesses[opened] += sign * (judged - mean) + 1e-6 > 0.5 * dev
                opened = opened[witnesses[opened] < need]
                if not len(opened):
                    break
        return sums / used[:, None], used

    def approximate_score(self, q: np.ndarray, precision: float = 0.1, least: int = 5, high_is_critical: bool = True, normalizer: Callable = log_normalizer, **how) -> tuple[np.ndarray, np.ndarray]:
        mean, used = self.approximate(q, lambda t, part: normalizer(t.score(part, **how), t.total), precision, least, high_is_critical)
        return mean[:, 0], used

    def approximate_attribution(self, q: np.ndarray, precision: float = 0.1, least: int = 5, high_is_critical: bool = True, normalizer: Callable = log_normalizer, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, trees used)."""
        q = np.atleast_2d(np.asarray(q, float))
        mean, used = self.approximate(q, lambda t, part: normalizer(np.hstack(t.attribution(part, **how)), t.total), precision, least, high_is_critical)
        dims = q.shape[1]
        return mean[:, :dims], mean[:, dims:], used

    def attribution(self, q: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
        q = np.atleast_2d(np.asarray(q, float))
        parts = [tuple(log_normalizer(v, t.total) for v in t.attribution(q, **how)) for t in self.trees]
        return np.mean([p[0] for p in parts], axis=0), np.mean([p[1] for p in parts], axis=0)

    def density(self, q: np.ndarray) -> dict[str, np.ndarray]:
        q = np.atleast_2d(np.asarray(q, float))
        parts = [t.density(q) for t in self.trees]
        out = {k: np.mean([p[k] for p in parts], axis=0) for k in parts[0]}
        out["size"] = np.full(len(q), np.mean([t.total for t in self.trees]))
        return out

    @staticmethod
    def density_value(found: dict[str, np.ndarray], q: float = 0.001) -> np.ndarray:
        """Mass over volume, kept finite by a share q of the sample."""
        m = found["measure"].sum((1, 2)) / found["size"]
        d, p = found["distance"], found["prob"]
        dims = d.shape[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            volume = np.where((d > 0) & (p > 0), np.exp(np.log(d / p) * dims) * p, 0.0).sum((1, 2))
        return m / (q * m + volume)

    @classmethod
    def directional_density(cls, found: dict[str, np.ndarray], q: float = 0.001) -> np.ndarray:
        total = found["measure"].sum((1, 2))
        return found["measure"] * (cls.density_value(found, q) / np.where(total > 0, total, 1.0))[:, None, None]

    def neighbours_of(self, q: np.ndarray, within: float = math.inf) -> Iterator[list[tuple[tuple, float, list[int], int]]]:
        """neighbours() of every query; each tree takes all queries down at once."""
        q = np.atleast_2d(np.asarray(q, float))
        found = [t.neighbours(q) for t in self.trees]
        for k in range(len(q)):
            near: dict[tuple, list] = {}
            for (i, d), p, s in zip(found, self.points, self.seqs, strict=True):
                if d[k] < within:
                    e = near.setdefault(tuple(p[i[k]].tolist()), [float(d[k]), set(), 0])
                    e[1].add(int(s[i[k]]))
                    e[2] += 1
            yield sorted(((p, d, sorted(s), n) for p, (d, s, n) in near.items()), key=lambda e: (e[1], e[0]))

    def neighbours(self, x: np.ndarray, within: float = math.inf) -> list[tuple[tuple, float, list[int], int]]:
        """(point, distance, sorted sequence numbers, trees) of each distinct candidate nearer than `within`, nearest first."""
        return next(self.neighbours_of(x, within))

    def conditionals(self, q: np.ndarray, gone: np.ndarray, centrality: float = 1.0, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """conditional() of every query, whose missing dimensions `gone` marks; a block of queries at a time."""
        q, n = np.where(gone, 0.0, q), self.nodes
        for at in range(0, len(q), 64):
            for leaf, dist in zip(*n.complete(q[at : at + 64], gone[at : at + 64], centrality, seed), strict=True):
                found: dict[bytes, list] = {}
                for point, d in zip(n.low[leaf], dist.tolist(), strict=True):
                    found.setdefault(point.tobytes(), [d, tuple(point.tolist()), 0.0])[2] += 1.0
                order = sorted(found.values(), key=lambda e: (e[0], e[1]))
                yield np.array([e[1] for e in order]), np.array([e[0] for e in order]), np.array([e[2] for e in order])

    def conditional(self, x: np.ndarray, missing, centrality: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points, distances, weights) of the distinct completions of x, nearest first."""
        q, gone = self._marked([x], missing)
        return next(self.conditionals(q, gone, centrality, seed))

    @staticmethod
    def _marked(rows, missing) -> tuple[np.ndarray, np.ndarray]:
        """The queries, and a mark for each missing coordinate: the same for all, or those that `missing` already marks."""
        q = np.atleast_2d(np.asarray(rows, float))
        if isinstance(missing, np.ndarray) and missing.dtype == bool and missing.shape == q.shape:
            return q, missing
        gone = np.zeros(q.shape, bool)
        gone[:, np.asarray(missing, int)] = True
        return q, gone

    def summaries(self, rows, missing, centrality: float = 1.0, percentile: float = 0.9) -> Iterator[dict[str, np.ndarray]]:
        """Weighted mean, median, deviation and bounds of each row's completions within the adaptive distance threshold."""
        for points, dist, weight in self.conditionals(*self._marked(rows, missing), centrality):
            if centrality > 0 and len(dist) > 1:
                limit = centrality * dist[0] + 1e-6
                away = np.where(dist > 0, weight, 0.0)
                run = np.cumsum(away)
                for share in (1 / 3, 1 / 2):
                    j = int(np.searchsorted(run, share * run[-1])) if run[-1] > 0 else 0
                    limit = centrality * dist[min(j, len(dist) - 1)] + 1e-6
                limit += (1 - centrality) * dist[-1]
                keep = dist <= limit
                points, dist, weight = points[keep], dist[keep], weight[keep]
            yield weighted_summary(points, weight, percentile) | {"points": points, "distance": dist, "weight": weight}

    def summary(self, x: np.ndarray, missing, centrality: float = 1.0, percentile: float = 0.9) -> dict[str, np.ndarray]:
        return next(self.summaries([x], missing, centrality, percentile))

    def impute_many(self, rows: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Rows with the coordinates that `gone` marks filled by the median of their completions."""
        out = np.array(rows, float)
        holed = np.flatnonzero(gone.any(1))
        for k, found in zip(holed, self.summaries(out[holed], gone[holed]) if len(holed) else (), strict=True):
            out[k, gone[k]] = found["median"][gone[k]]
        return out

    def impute(self, x: np.ndarray, missing) -> np.ndarray:
        return self.impute_many(*self._marked([x], missing))[0]

    def extrapolate(self, shingle: np.ndarray, inputs: int, horizon: int, cyclic: bool = False, at: int = 0, centrality: float = 1.0, percentile: float = 0.9) -> dict[str, np.ndarray]:
        """values, lower, upper (horizon, inputs): the newest block is imputed again and again."""
        q = np.asarray(shingle, float).copy()
        size = len(q) // inputs
        out = {k: np.zeros((horizon, inputs)) for k in ("value", "lower", "upper")}
        for h in range(horizon):
            if cyclic:
                block = ((at + h) % size) * inputs
            else:
                q[:-inputs] = q[inputs:]
                block = len(q) - inputs
            idx = np.arange(block, block + inputs)
            s = self.summary(q, idx, centrality, percentile)
            q[idx] = s["median"][idx]
            out["value"][h], out["lower"][h], out["upper"][h] = s["median"][idx], s["lower"][idx], s["upper"][idx]
        return out


def weighted_pick(values: np.ndarray, weight: np.ndarray, level: float) -> float:
    by = np.argsort(values, kind="stable")
    run = np.cumsum(weight[by])
    return float(values[by][min(int(np.searchsorted(run, level * run[-1] - 1e-9)), len(by) - 1)])


def weighted_summary(points: np.ndarray, weight: np.ndarray, percentile: float = 0.9) -> dict[str, np.ndarray]:
    total = weight.sum()
    mean = (points * weight[:, None]).sum(0) / total
    dev = np.sqrt(np.maximum(0, (points**2 * weight[:, None]).sum(0) / total - mean**2))
    by = np.argsort(points, axis=0, kind="stable")
    run, value = np.cumsum(weight[by], axis=0), np.take_along_axis(points, by, 0)
    pick = lambda p: value[np.minimum((run < p * run[-1] - 1e-9).sum(0), len(value) - 1), np.arange(value.shape[1])]
    return {"mean": mean, "deviation": dev, "median": pick(0.5), "lower": pick(1 - percentile), "upper": pick(percentile), "total": np.array(total)}
