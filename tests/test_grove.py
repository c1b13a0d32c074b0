import math

import numpy as np
import pytest

from grovecast.operators.forest_kernel import Forest
from grovecast.streaming.grove import Grove
from grovecast.streaming.online import OnlineForest, dump, restore


def rows(n, dims=3, seed=0):
    """Points of single precision, some of them repeated."""
    x = np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32).astype(float)
    x[n // 2 : n // 2 + n // 8] = x[: n // 8]
    x[-n // 8 :] = x[3]
    return x


def sound(m: OnlineForest) -> None:
    """Every tree is valid, holds its sample's points and nothing else, and its places lead to their leaves."""
    f = m.forest()
    for tree, points in zip(f.trees, f.points, strict=True):
        assert tree.check() and tree.total == len(points)
        leaves = np.flatnonzero((tree.left < 0) & (tree.mass > 0))
        held = {tuple(tree.low[n]): int(tree.mass[n]) for n in leaves}
        values, counts = np.unique(points, axis=0, return_counts=True)
        assert held == {tuple(v): int(c) for v, c in zip(values, counts, strict=True)}
        assert (points[tree.leaf[leaves]] == tree.low[leaves]).all() and (tree.low[leaves] == tree.high[leaves]).all()
        assert (tree.depth[tree.left[tree.left >= 0]] == tree.depth[tree.left >= 0] + 1).all()


@pytest.mark.parametrize("size", [1, 2, 3, 16, 50])
def test_trees_follow_their_samples(size):
    m = OnlineForest(3, 7, size, 0.02)
    for k, x in enumerate(rows(300)):
        m.update(x)
        if k < 20 or k % 37 == 0:
            sound(m)
    sound(m)


def test_constant_and_straight_rows():
    for x in (np.zeros((80, 2)), np.stack([np.arange(80.0), np.zeros(80)], 1), np.exp(np.arange(80.0))[:, None] * np.ones(2)):
        m = OnlineForest(2, 5, 16, 0.05)
        for v in x:
            m.update(v)
        sound(m)


def test_score_equals_the_walk_of_the_exported_trees():
    m = OnlineForest(4, 9, 32, 0.01)
    x = rows(200, 4)
    for v in x:
        m.update(v)
    f = m.forest()
    for v in [*x[:40], x[3], np.full(4, 9.0), np.zeros(4)]:
        assert math.isclose(m.score(v), f.score_one(v), rel_tol=1e-12)


@pytest.mark.parametrize("size", [1, 2, 20])
def test_density_equals_that_of_the_exported_trees(size):
    """One query goes through all trees at once, without their export; known points and new ones."""
    m = OnlineForest(3, 6, size, 0.02)
    for k, x in enumerate(rows(160)):
        m.update(x)
        for q in (x, x + 0.1, rows(160)[k // 2], np.full(3, 1e6)):
            f = m.forest()
            got = f.density(q)
            assert f.grove.made == [None] * f.grove.count
            want = Forest.density(f, q)
            assert got.keys() == want.keys()
            for name in want:
                assert got[name].shape == want[name].shape and (got[name] == want[name]).all(), (k, name)
            f.grove.made = [None] * f.grove.count


def test_inserting_and_deleting_equals_building():
    """Scores by trees that took points in and gave others up are distributed as by trees built from the same points."""
    x = np.random.default_rng(5).normal(size=(24, 2)).astype(np.float32).astype(float)
    x[:3] += 6
    trees, draw = 3000, np.random.default_rng(6)
    g, every = Grove(trees, 24, 2), np.arange(trees)
    for k in draw.permutation(24):
        g.insert(x[k], every, np.full(trees, k), draw.uniform(size=trees), draw.uniform(size=trees))
    for k in (1, 7, 12, 20):  # gone and back again, in another order
        g.remove(every, np.full(trees, k))
    for k in (20, 1):
        g.insert(x[k], every, np.full(trees, k), draw.uniform(size=trees), draw.uniform(size=trees))
    keep = [k for k in range(24) if k not in (7, 12)]
    built = Forest.build([x[keep]] * trees, 9)
    live = Forest(g.trees(every), [x] * trees)
    for q in (x[0], x[5], np.array([3.0, 3.0]), np.array([-9.0, 1.0])):
        a, b = ([t.score_one(q.tolist()) for t in f.trees] for f in (live, built))
        assert abs(np.mean(a) - np.mean(b)) < 4 * math.sqrt((np.var(a) + np.var(b)) / trees)
        assert abs(np.std(a) - np.std(b)) < 0.08 * np.std(b) + 1e-9
    # the first cut's dimension and place as well
    for tree_set in (0, 1):
        cuts = [[t.cut[0] for t in f.trees if t.dim[0] == tree_set] for f in (live, built)]
        assert abs(len(cuts[0]) - len(cuts[1])) < 4 * math.sqrt(trees / 2)
        assert abs(np.mean(cuts[0]) - np.mean(cuts[1])) < 4 * math.sqrt((np.var(cuts[0]) + np.var(cuts[1])) / min(map(len, cuts)))


def test_restored_forests_go_on_alike():
    a = OnlineForest(3, 6, 20, 0.02)
    x = rows(260)
    for v in x[:130]:
        a.update(v)
    b = restore(dump(a))
    for v in x[130:]:
        assert a.score(v) == b.score(v)
        a.update(v)
        b.update(v)
    sound(b)
    assert all((s == t).all() for s, t in zip(a.seqs, b.seqs, strict=True))


def test_state_of_another_format():
    import pickle

    for old in (pickle.dumps(OnlineForest(1)), pickle.dumps((1, OnlineForest(1)))):
        with pytest.raises(ValueError, match="format"):
            restore(old)


def test_early_samples_thin_out():
    m = OnlineForest(1, 40, 64, 0.0, initial_accept=0.25)
    for k in range(64):
        m.update([float(k)])
    assert all(16 <= n < 64 for n in m._have)
    for k in range(2000):
        m.update([float(k)])
    sound(m)
    assert (m._have == 64).all()


def test_merged_trees_are_sound():
    a, b = OnlineForest(3, 4, 16), OnlineForest(3, 4, 16, seed=1)
    for v, w in zip(rows(60), rows(60, seed=1), strict=True):
        a.update(v)
        b.update(w)
    a.merge(b)
    sound(a)
    v = rows(90, seed=2)
    for x in v:  # and go on
        a.update(x)
    sound(a)
    c = OnlineForest(3, 4, 16)
    c.hold(a.keys, a.points, a.seqs)
    sound(c)
    c.hold([k[:0] for k in a.keys], [p[:0] for p in a.points], [s[:0] for s in a.seqs])
    assert c.forest() is None
    with pytest.raises(ValueError):
        c.hold(a.keys[:2], a.points[:2], a.seqs[:2])
