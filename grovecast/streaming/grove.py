"""Trees of random cuts that take in and give up single points, all trees of a forest at once. No Spark in here.

A point comes in along its way down: a node whose box does not hold it is cut off from it with the probability that a
fresh cut of the widened box would do so, and the first node cut off becomes its sibling. A point goes by lifting its
sibling into the parent's place. Either way a tree stays distributed as one built anew from its sample.
Ways are short and uneven, so they are walked node by node; what is measured along them is one array operation for all
trees. Draws are handed in.
"""

from __future__ import annotations

import math

import numpy as np

from ..operators.forest_kernel import Forest, Nodes, Tree, damp, log_normalizer, seen, unseen


def columns(v: np.ndarray, lanes: int = 8) -> np.ndarray:
    """Sums over the first axis, added in the order of numpy's sums over a contiguous last axis of as many numbers.

    lanes = 4: as if a zero came after each number.
    """
    k = len(v)
    if k > 16 * lanes:
        half = k // 2 - k // 2 % lanes
        return columns(v[:half], lanes) + columns(v[half:], lanes)
    whole = k - k % lanes
    if not whole:
        out, whole = v[0], 1
    else:
        run = [sum((v[i] for i in range(j + lanes, whole, lanes)), v[j]) for j in range(lanes)]
        while len(run) > 1:
            run = [a + b for a, b in zip(run[::2], run[1::2], strict=True)]
        out = run[0]
    for i in range(whole, k):
        out = out + v[i]
    return out


class Grove:
    """`trees` trees over at most `size` points each; places 0 .. size - 1 name a tree's points.

    Nodes of all trees share flat arrays: tree t owns `span` of them from t * span on, the first being its root. A leaf
    is its own child on both sides. One node past the last stands above all roots. A box is (low, -high), so that
    the box around two boxes is their minimum.
    """

    def __init__(self, trees: int, size: int, dims: int) -> None:
        self.count, self.size, self.dims, self.span = trees, size, dims, 2 * size - 1
        n = trees * self.span + 1
        kids, dim, cut = np.repeat(np.arange(n), 2), np.zeros(n, np.int64), np.zeros(n)
        self._fill(kids, dim, cut, np.full(n, -1), np.full((trees, size), -1), np.arange(trees)[:, None] * self.span + np.arange(self.span)[::-1], np.full(trees, self.span - 1))

    def _fill(self, kids, dim, cut, leaf, home, free, spare) -> None:
        """free lists spare slots of each tree, the root last, which is never taken."""
        n = len(dim)
        self.none, self.roots = n - 1, np.arange(self.count) * self.span
        self.kids, self.dim, self.cut, self.leaf, self.home, self.free, self.spare = kids.reshape(n, 2), dim, cut, leaf, home, free, spare
        self.parent, self.mass = np.full(n, self.none), np.zeros(n, np.int64)
        self.box, self.wide = np.zeros((n, 2 * self.dims)), np.zeros(n)
        self.made: list[Tree | None] = [None] * self.count
        self._logs = [math.log2(m + 1.0) for m in range(self.size + 1)]
        # single elements are read through views, which costs a fraction of indexing arrays
        self._kids, self._dim, self._cut, self._parent, self._mass = (memoryview(v) for v in (kids, dim, cut, self.parent, self.mass))

    # state: structure only; boxes, masses and parents follow from it and the points

    def __getstate__(self) -> dict:
        return {"shape": (self.count, self.size, self.dims, self.span), "cut": self.cut, "ints": [v.astype(np.int32) for v in (self.kids.ravel(), self.dim, self.leaf, self.home, self.free, self.spare)]}

    def __setstate__(self, state: dict) -> None:
        self.count, self.size, self.dims, self.span = state["shape"]
        kids, dim, leaf, home, free, spare = (v.astype(np.int64) for v in state["ints"])
        self._fill(kids, dim, state["cut"].copy(), leaf, home, free, spare)

    def refill(self, points: np.ndarray) -> None:
        """Boxes, masses and parents of a restored grove from its points (trees, places, dimensions)."""
        t, place = np.nonzero(self.home >= 0)
        node, x = self.home[t, place], points[t, place]
        np.add.at(self.mass, node, 1)
        self.box[node] = np.concatenate([x, -x], axis=1)
        for at in reversed(self.levels()):
            at = at[self.kids[at, 0] != at]
            a, b = self.kids[at, 0], self.kids[at, 1]
            self.parent[a] = self.parent[b] = at
            self.mass[at] = self.mass[a] + self.mass[b]
            self._bound(at, np.minimum(self.box[a], self.box[b]))

    def levels(self, trees=slice(None)) -> list[np.ndarray]:
        """Nodes by depth."""
        at, out = self.roots[trees], []
        while len(at):
            out.append(at)
            inner = at[self.kids[at, 0] != at]
            at = self.kids[inner].ravel()
        return out

    def _bound(self, node: np.ndarray, box: np.ndarray) -> None:
        self.box[node], self.wide[node] = box, -(box[:, : self.dims] + box[:, self.dims :]).sum(1)

    # one point against all trees

    def ways(self, x: list[float], trees: list[int]) -> tuple[list[int], list[int]]:
        """(nodes on x's ways down, one tree after the other; where each way ends)."""
        kids, dim, cut, span = self._kids, self._dim, self._cut, self.span
        nodes, ends = [], []
        add = nodes.append
        for t in trees:
            at = t * span
            while True:
                add(at)
                nxt = kids[2 * at + (x[dim[at]] > cut[at])]
                if nxt == at:
                    break
                at = nxt
            ends.append(len(nodes))
        return nodes, ends

    def outside(self, y: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(boxes; by how much the point misses them below and above, by dimension; the chance that a fresh cut parts the two)."""
        box = self.box.take(nodes, 0)
        miss = np.maximum(box - y, 0.0)
        out = miss.sum(1)
        return box, miss, out / np.where(out > 0, out + self.wide.take(nodes), 1.0)

    def score(self, x: np.ndarray) -> float:
        """Mean normalised expected depth score over the trees that have points."""
        mass, logs, span = self._mass, self._logs, self.span
        trees = [t for t in range(self.count) if mass[t * span]]
        if not trees:
            return 0.0
        nodes, ends = self.ways(x.tolist(), trees)
        p = self.outside(np.concatenate([x, -x]), np.array(nodes))[2].tolist()
        total, first = 0.0, 0
        for end in ends:
            last, all_of_it = end - 1, mass[nodes[first]]
            deep = last - first
            if p[last] <= 0:
                m = mass[nodes[last]]
                s = (1 - m / (2 * all_of_it)) / (deep + logs[m])
            else:
                s = 1 / (deep + 1)
                for k in range(last - 1, first - 1, -1):
                    if p[k] <= 0:
                        break  # boxes further up hold the point as well
                    s += p[k] * (1 / (k - first + 1) - s)
            total += s * logs[all_of_it]
            first = end
        return total / len(trees)

    def insert(self, x: np.ndarray, trees: np.ndarray, places: np.ndarray, depth_draw: np.ndarray, cut_draw: np.ndarray) -> None:
        """x comes into each of the distinct trees, under a free place of its sample; one draw of each kind for a tree."""
        y = np.concatenate([x, -x])
        mass, span = self._mass, self.span
        above_all, dup, new, stops = [], [], [], []
        here = trees.tolist()
        for t in here:
            self.made[t] = None
        bare = np.array([not mass[t * span] for t in here])
        if bare.any():
            root = self.roots[trees[bare]]
            self.mass[root], self.leaf[root], self.home[trees[bare], places[bare]], self.kids[root] = 1, places[bare], root, root[:, None]
            self.box[root], self.wide[root] = y, 0.0
            trees, places, depth_draw, cut_draw = (v[~bare] for v in (trees, places, depth_draw, cut_draw))
            here = trees.tolist()
            if not here:
                return
        nodes, ends = self.ways(x.tolist(), here)
        way = np.array(nodes)
        box, miss, part = self.outside(y, way)
        p, first = part.tolist(), 0
        for i, (end, u) in enumerate(zip(ends, depth_draw.tolist(), strict=True)):
            left, stop = 1.0, end  # the chance that no node so far has been cut off
            if p[end - 1] > 0:
                for k in range(first, end):
                    left *= 1 - p[k]
                    if left <= u:
                        stop = k
                        break
                new.append(i)
                stops.append(stop)
            else:
                dup.append((i, nodes[end - 1]))
            # nodes above the place widen and gain a point; so does, for a repeated point, its leaf
            above_all.extend(range(first, stop))
            first = end
        if above_all:
            above = way[above_all]
            self.mass[above] += 1
            self._bound(above, np.minimum(box[above_all], y))
        for i, n in dup:
            self.home[trees[i], places[i]] = n
        if not new:
            return
        self._part(np.broadcast_to(x, (len(new), self.dims)), trees[new], places[new], way[stops], box[stops], miss[stops], cut_draw[new])

    def _part(self, x: np.ndarray, trees: np.ndarray, places: np.ndarray, at: np.ndarray, box: np.ndarray, gap: np.ndarray, draw: np.ndarray) -> None:
        """Each of the points is cut off from the node `at` of its tree, whose box it misses by `gap`."""
        y = np.concatenate([x, -x], axis=1)
        # given that a cut parts them, it falls evenly on the gaps between the point and the box
        run = np.cumsum(gap, axis=1)
        r = draw * run[:, -1]
        rows = np.arange(len(at))
        j = np.minimum((run <= r[:, None]).sum(1), 2 * self.dims - 1)
        bad = gap[rows, j] <= 0  # rounding at the end of the line
        if bad.any():
            j[bad] = 2 * self.dims - 1 - (gap[bad][:, ::-1] > 0).argmax(1)
        below = j < self.dims
        d = np.where(below, j, j - self.dims)
        edge = np.where(below, box[rows, j], -box[rows, j])
        a, b = np.where(below, x[rows, d], edge), np.where(below, edge, x[rows, d])  # the cut is in [a, b)
        cut = a + np.maximum(r - (run[rows, j] - gap[rows, j]), 0.0)
        cut = np.maximum(np.where(cut >= b, np.nextafter(b, a), cut), a)
        moved, fresh = self.free[trees, self.spare[trees] - 1], self.free[trees, self.spare[trees] - 2]
        self.spare[trees] -= 2
        self._move(trees, at, moved)
        self.mass[fresh], self.leaf[fresh], self.kids[fresh] = 1, places, fresh[:, None]
        self.box[fresh], self.wide[fresh] = y, 0.0
        self.home[trees, places] = fresh
        self.parent[moved] = self.parent[fresh] = at
        self.dim[at], self.cut[at], self.leaf[at] = d, cut, -1
        self.kids[at, 0], self.kids[at, 1] = np.where(below, fresh, moved), np.where(below, moved, fresh)
        self.mass[at] += 1
        self._bound(at, np.minimum(box, y))

    def _move(self, trees: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        """Nodes take other slots, with all that refers to them from below."""
        for f in (self.dim, self.cut, self.mass, self.leaf, self.box, self.wide):
            f[dst] = f[src]
        leaf = self.kids[src, 0] == src
        self.kids[dst] = np.where(leaf[:, None], dst[:, None], self.kids[src])
        inner = dst[~leaf]
        self.parent[self.kids[inner, 0]] = self.parent[self.kids[inner, 1]] = inner
        if leaf.any():
            t = trees[leaf]
            here = self.home[t]
            self.home[t] = np.where(here == src[leaf][:, None], dst[leaf][:, None], here)

    def remove(self, trees: np.ndarray, places: np.ndarray) -> None:
        """The points at these places leave their trees."""
        parent, kids, mass, none = self._parent, self._kids, self._mass, self.none
        node = self.home[trees, places]
        y = self.box[node]
        self.home[trees, places] = -1
        nodes, ends = [], []
        for at in node.tolist():
            while at != none:
                nodes.append(at)
                at = parent[at]
            ends.append(len(nodes))
        way = np.array(nodes)
        self.mass[way] -= 1
        lane = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        edge = (self.box.take(way, 0) == y[lane]).any(1).tolist()
        gone, shrunk, first = [], [], 0
        for i, (t, end) in enumerate(zip(trees.tolist(), ends, strict=True)):
            self.made[t] = None
            at = nodes[first]
            if mass[at]:  # a repeated point: another place speaks for the leaf
                self.leaf[at] = np.flatnonzero(self.home[t] == at)[0]
            elif end - first == 1:
                self.leaf[at] = -1  # the tree is empty
            else:
                gone.append(i)
                # boxes shrink on the way up, beyond the parent, for as long as the point lay on their edge
                below, up = at, nodes[first + 1]
                lifted = kids[2 * up] + kids[2 * up + 1] - below
                below, low = up, self.box[lifted]
                for k in range(first + 2, end):
                    if not edge[k]:
                        break
                    up = nodes[k]
                    low = np.minimum(low, self.box[kids[2 * up] + kids[2 * up + 1] - below])
                    self.box[up] = low
                    shrunk.append(up)
                    below = up
            first = end
        if shrunk:
            self._bound(np.array(shrunk), self.box[shrunk])
        if not gone:
            return
        self._lift(trees[gone], node[gone])

    def _lift(self, t: np.ndarray, leaf: np.ndarray) -> None:
        """The leaves go, and each one's sibling takes the place of their parent."""
        up = self.parent[leaf]
        sibling = self.kids[up].sum(1) - leaf
        self._move(t, sibling, up)
        for old in (leaf, sibling):
            self.free[t, self.spare[t]] = old
            self.spare[t] += 1
            self.kids[old], self.mass[old], self.leaf[old], self.parent[old] = old[:, None], 0, -1, self.none
            self.dim[old], self.cut[old] = 0, 0.0

    # many points, each against trees of its own, level by level

    def scores(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """score() of each point by its own trees (points, trees), none of them empty."""
        logs, y = np.array(self._logs), np.repeat(np.concatenate([x, -x], axis=1), trees.shape[1], axis=0)
        lane, at, levels = np.arange(trees.size), self.roots[trees.ravel()], []
        all_of_it, s = self.mass[at], np.zeros(trees.size)
        while len(lane):
            p, m = self.outside(y[lane], at)[2], self.mass[at]
            nxt = self.kids[at, (y[lane, self.dim[at]] > self.cut[at]).astype(np.int64)]
            deep, inner = len(levels), nxt != at
            end = ~inner
            s[lane[end]] = np.where(p <= 0, (1 - m / (2 * all_of_it[lane])) / np.maximum(deep + logs[m], 1e-300), 1 / (deep + 1))[end]
            levels.append((lane[inner], p[inner]))
            lane, at = lane[inner], nxt[inner]
        for k in range(len(levels) - 1, -1, -1):
            lane, p = levels[k]
            s[lane] += p * (1 / (k + 1) - s[lane])
        s = (s * logs[all_of_it]).reshape(trees.shape)
        total = np.zeros(len(x))
        for k in range(trees.shape[1]):
            total += s[:, k]
        return total / trees.shape[1]

    def scores_distances(self, x: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """scores(), and the sum of density()'s distances, of each point by its own trees (points, trees), none of them empty.

        One way down serves both. Lanes lie along the last axis, and a point is above or below nested boxes on one side
        at most, so that a number for each dimension is enough until the mean over trees. Distances equal density()'s to the
        last bit in few dimensions (9 were tried), beyond that but for rounding (16 and 20).
        """
        dims, of, logs = self.dims, trees.shape[1], np.array(self._logs)
        every = np.repeat(np.concatenate([x, -x], axis=1).T, of, axis=1)
        kids = self.kids.reshape(-1)
        lane, at, y, levels = np.arange(trees.size), self.roots.take(trees.ravel()), every, []
        all_of_it, s, dist = self.mass.take(at), np.zeros(trees.size), np.zeros((dims, trees.size))
        above, equal = np.zeros((dims, trees.size), bool), np.zeros(trees.size, bool)
        while len(lane):
            box, wide = np.ascontiguousarray(self.box.take(at, 0).T), self.wide.take(at)
            miss = np.maximum(box - y, 0.0)
            out = columns(miss)
            p = out / np.where(out > 0, out + wide, 1.0)
            size = wide + columns(miss[dims:]) + columns(miss[:dims])
            gap = miss[:dims] + miss[dims:]
            right = y[self.dim.take(at), np.arange(len(at))] > self.cut.take(at)
            nxt = kids.take(2 * at + right)
            deep, leaf = len(levels), nxt == at
            end, inner = np.flatnonzero(leaf), np.flatnonzero(~leaf)
            if len(end):
                to, m, same = lane[end], self.mass.take(at[end]), out[end] <= 0
                s[to] = np.where(same, (1 - m / (2 * all_of_it[to])) / np.maximum(deep + logs[m], 1e-300), 1 / (deep + 1))
                part = gap.take(end, 1)
                dist[:, to] = part / np.where(same, 1.0, size[end]) * part
                above[:, to], equal[to] = miss[dims:].take(end, 1) > 0, same
            lane, at, nxt, y = lane[inner], at[inner], nxt[inner], y.take(inner, 1)
            levels.append((lane, at, nxt, p[inner], gap.take(inner, 1), -(box[:dims] + box[dims:]).take(inner, 1), size[inner]))
            at = nxt
        shade = np.full((2 * dims, trees.size), np.inf) if equal.any() else None
        for k in range(len(levels) - 1, -1, -1):
            lane, at, below, p, gap, width, size = levels[k]
            known = np.flatnonzero(equal[lane])
            if len(known):  # measured without the point's own leaf
                to, sibling = lane[known], kids.take(2 * at[known]) + kids.take(2 * at[known] + 1) - below[known]
                box = np.minimum(shade[:, to], self.box.take(sibling, 0).T)
                miss = np.maximum(box - every[:, to], 0.0)
                shade[:, to], width[:, known] = box, -(box[:dims] + box[dims:])
                gap[:, known] = miss[:dims] + miss[dims:]
                size[known] = columns(width[:, known]) + columns(miss[dims:]) + columns(miss[:dims])
                above[:, to] |= miss[dims:] > 0
            share = gap / np.where(size > 0, size, 1.0)
            dist[:, lane] = share * (gap + width) + (1 - columns(share, 4)) * dist.take(lane, 1)
            s[lane] += p * (1 / (k + 1) - s[lane])
        s = (s * logs[all_of_it]).reshape(trees.shape)
        high, low = (np.where(side, dist, 0.0).reshape(dims, *trees.shape) for side in (above, ~above))
        total, far = np.zeros(len(x)), np.zeros((2 * dims, len(x)))
        for k in range(of):
            total += s[:, k]
            far[::2] += high[:, :, k]
            far[1::2] += low[:, :, k]
        return total / of, columns(far / of)

    def attributions(self, x: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forest.attribution() of each point by its own trees (points, trees)."""
        dims, q = self.dims, np.repeat(x, trees.shape[1], axis=0)
        lane, at, levels = np.arange(trees.size), self.roots[trees.ravel()], []
        total, leaf, deep = self.mass[at], at.copy(), np.zeros(trees.size)
        while len(lane):
            nxt = self.kids[at, (q[lane, self.dim[at]] > self.cut[at]).astype(np.int64)]
            inner = nxt != at
            leaf[lane], deep[lane] = at, len(levels)
            lane, at, nxt = lane[inner], at[inner], nxt[inner]
            levels.append((lane, at, nxt))
            at = nxt

        def gaps(q, box):
            low, high = box[:, :dims], -box[:, dims:]
            up, down = np.maximum(q - high, 0.0), np.maximum(low - q, 0.0)
            size = (high - low).sum(1) + up.sum(1) + down.sum(1)
            return up, down, np.where(size > 0, size, 1.0)[:, None]

        box, m = self.box[leaf], self.mass[leaf].astype(float)
        equal = (box[:, :dims] == q).all(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            saved = np.where(equal, damp(m, total) * seen(deep, m), unseen(deep))
        up, down, size = gaps(q, box)
        even = (saved / (2 * dims))[:, None]
        high = np.where(equal[:, None], even, saved[:, None] * up / size)
        low = np.where(equal[:, None], even, saved[:, None] * down / size)
        shade = np.full(self.box[leaf].shape, np.inf)
        for k in range(len(levels) - 1, -1, -1):
            lane, at, below = levels[k]
            shade[lane] = np.minimum(shade[lane], self.box[self.kids[at].sum(1) - below])  # measured without the point's own leaf
            up, down, size = gaps(q[lane], np.where(equal[lane][:, None], shade[lane], self.box[at]))
            rest = 1 - (up.sum(1) + down.sum(1))[:, None] / size
            high[lane] = up / size * unseen(float(k)) + rest * high[lane]
            low[lane] = down / size * unseen(float(k)) + rest * low[lane]
        both = high.sum(1) + low.sum(1)
        fix = np.where(equal & (both > 0), saved / np.where(both > 0, both, 1.0), 1.0)[:, None]
        high, low = (log_normalizer(v * fix, total[:, None]).reshape(*trees.shape, dims) for v in (high, low))
        return high.mean(1), low.mean(1)

    def insert_each(self, x: np.ndarray, trees: np.ndarray, places: np.ndarray, depth_draw: np.ndarray, cut_draw: np.ndarray) -> None:
        """insert() of points of their own into distinct trees."""
        y = np.concatenate([x, -x], axis=1)
        bare = self.mass[self.roots[trees]] == 0
        if bare.any():
            root = self.roots[trees[bare]]
            self.mass[root], self.leaf[root], self.home[trees[bare], places[bare]], self.kids[root] = 1, places[bare], root, root[:, None]
            self.box[root], self.wide[root] = y[bare], 0.0
            x, y, trees, places, depth_draw, cut_draw = (v[~bare] for v in (x, y, trees, places, depth_draw, cut_draw))
        lane, at, left, found = np.arange(len(trees)), self.roots[trees], np.ones(len(trees)), []
        while len(lane):
            box, miss, p = self.outside(y[lane], at)
            left = left * (1 - p)
            cut_off = left <= depth_draw[lane]
            found.append((lane[cut_off], at[cut_off], box[cut_off], miss[cut_off]))
            stay = ~cut_off
            lane, at, left = lane[stay], at[stay], left[stay]
            self.mass[at] += 1
            self._bound(at, np.minimum(box[stay], y[lane]))
            nxt = self.kids[at, (y[lane, self.dim[at]] > self.cut[at]).astype(np.int64)]
            inner = nxt != at
            same = lane[~inner]  # repeated points
            self.home[trees[same], places[same]] = at[~inner]
            lane, at, left = lane[inner], nxt[inner], left[inner]
        if found:
            lane, at, box, miss = (np.concatenate(v) for v in zip(*found, strict=True))
            if len(lane):
                self._part(x[lane], trees[lane], places[lane], at, box, miss, cut_draw[lane])

    def remove_each(self, trees: np.ndarray, places: np.ndarray) -> None:
        """remove() from distinct trees."""
        none, node = self.none, self.home[trees, places]
        y = self.box[node]
        self.home[trees, places] = -1
        at = node
        while len(at):
            self.mass[at] -= 1
            at = self.parent[at]
            at = at[at != none]
        kept, root = self.mass[node] > 0, self.parent[node] == none
        self.leaf[node[kept]] = (self.home[trees[kept]] == node[kept][:, None]).argmax(1)
        self.leaf[node[~kept & root]] = -1
        gone = np.flatnonzero(~kept & ~root)
        if not len(gone):
            return
        leaf, y = node[gone], y[gone]
        below = self.parent[leaf]
        low, at = self.box[self.kids[below].sum(1) - leaf], self.parent[below]
        while len(at):
            on = np.flatnonzero(at != none)
            on = on[(self.box[at[on]] == y[on]).any(1)]
            at, below, low, y = at[on], below[on], low[on], y[on]
            low = np.minimum(low, self.box[self.kids[at].sum(1) - below])
            self._bound(at, low)
            below, at = at, self.parent[at]
        self._lift(trees[gone], leaf)

    def trees(self, which) -> list[Tree]:
        """The trees as they are now, for queries; those that have not changed since are not made again."""
        stale = np.array([t for t in which if self.made[t] is None], np.int64)
        if len(stale):
            depth = np.zeros(self.none + 1, np.int64)
            for k, at in enumerate(self.levels(stale)):
                depth[at] = k
            for t in stale:
                own = slice(self.roots[t], self.roots[t] + self.span)
                kids = self.kids[own] - self.roots[t]
                leaf = kids[:, 0] == np.arange(self.span)
                kids[leaf] = -1
                up = np.where(self.parent[own] == self.none, -1, self.parent[own] - self.roots[t])
                self.made[t] = Tree(
                    left=kids[:, 0], right=kids[:, 1], parent=up, dim=np.where(leaf, -1, self.dim[own]), cut=np.where(leaf, 0.0, self.cut[own]), mass=self.mass[own].copy(),
                    depth=depth[own], path=np.zeros(self.span, np.int64), leaf=self.leaf[own].copy(), low=self.box[own, : self.dims].copy(), high=-self.box[own, self.dims :],
                )
        return [self.made[t] for t in which]


class LiveForest(Forest):
    """Queries of a grove as it is now, until its next change; trees are only made where a query needs them."""

    def __init__(self, grove: Grove, live: np.ndarray, points: list[np.ndarray], seqs: list[np.ndarray]) -> None:
        self.grove, self.live, self.points, self.seqs = grove, live, points, seqs

    @property
    def trees(self) -> list[Tree]:
        return self.grove.trees(self.live)

    @property
    def nodes(self) -> Nodes:
        g = self.grove
        return Nodes(g.kids, g.dim, g.cut, g.mass, g.box[:, : g.dims], -g.box[:, g.dims :], g.roots[self.live])

    def near(self, x: np.ndarray, within: float) -> int:
        """The number of trees whose candidate in neighbours() is nearer than `within`."""
        nodes, ends = self.grove.ways(x.tolist(), self.live.tolist())
        leaf = np.array(nodes)[np.array(ends) - 1]
        return int((np.sqrt(((x - self.grove.box[leaf, : self.grove.dims]) ** 2).sum(1)) < within).sum())

    def density(self, q: np.ndarray) -> dict[str, np.ndarray]:
        """One query goes through all trees at once, a step up from the leaves at a time; several as in any forest."""
        q = np.atleast_2d(np.asarray(q, float))
        if len(q) != 1 or not len(self.live):
            return super().density(q)
        g, dims, x = self.grove, self.grove.dims, q[0]
        nodes, ends = g.ways(x.tolist(), self.live.tolist())
        way, last = np.array(nodes), np.array(ends) - 1
        steps = np.diff(last, prepend=-1) - 1  # inner nodes above each leaf
        leaf = way[last]
        box, mass = g.box.take(way, 0), g.mass.take(way)
        low, high = box[:, :dims], -box[:, dims:]
        equal = (low[last] == x).all(1)
        here = equal[:, None, None]

        def shares(low, high):
            gap = np.stack([np.maximum(x - high, 0.0), np.maximum(low - x, 0.0)], 2)
            size = (high - low).sum(1) + gap[:, :, 0].sum(1) + gap[:, :, 1].sum(1)
            return gap, gap / np.where(size > 0, size, 1.0)[:, None, None]

        own, m = np.where(equal, 1.0 + mass[last], 1.0), mass[last]
        gap, share = shares(low[last], high[last])
        prob = np.where(here, 0.5 / dims, share)
        measure = np.where(here, 0.5 * m[:, None, None] / dims, share * (m + own)[:, None, None])
        distance = np.where(here, 0.0, share * gap)
        shade, below = np.full((len(last), 2 * dims), np.inf), leaf.copy()
        for k in range(1, int(steps.max(initial=0)) + 1):
            rows = np.flatnonzero(steps >= k)
            at = last[rows] - k
            a, b = low[at], high[at]
            known = equal[rows]
            if known.any():  # measured without the point's own leaf
                node = way[at]
                shade[rows] = np.minimum(shade[rows], g.box[g.kids[node].sum(1) - below[rows]])
                below[rows] = node
                a, b = np.where(known[:, None], shade[rows, :dims], a), np.where(known[:, None], -shade[rows, dims:], b)
            gap, share = shares(a, b)
            rest = 1 - share.sum((1, 2), keepdims=True)
            prob[rows] = share + rest * prob[rows]
            measure[rows] = share * (mass[at] + own[rows])[:, None, None] + rest * measure[rows]
            distance[rows] = share * (gap + (b - a)[:, :, None]) + rest * distance[rows]
        out = {"measure": measure, "distance": distance, "prob": prob}
        return {k: v.mean(0)[None] for k, v in out.items()} | {"size": np.full(1, g.mass[g.roots[self.live]].mean())}
