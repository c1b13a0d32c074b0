import math

import numpy as np
import pytest

from grovecast.functions.rng import uniform_np
from grovecast.operators import forest_kernel as fk


def slow_score(t, x):
    """One point by recursion over explicit paths."""
    path, node = [], 0
    while t.left[node] >= 0:
        path.append(node)
        node = t.left[node] if x[t.dim[node]] <= t.cut[node] else t.right[node]
    d, m, M = t.depth[node], t.mass[node], t.mass[0]
    if (t.low[node] == x).all():
        return (1 - m / (2 * M)) / (d + math.log2(m + 1)) * math.log2(M + 1)
    s = 1 / (d + 1)
    for n in reversed(path):
        out = np.maximum(0, x - t.high[n]).sum() + np.maximum(0, t.low[n] - x).sum()
        p = out / (out + (t.high[n] - t.low[n]).sum()) if out else 0
        s = p / (t.depth[n] + 1) + (1 - p) * s
    return s * math.log2(M + 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 4))
    x[50:60] = x[40]  # repeated points
    return x


@pytest.fixture(scope="module")
def forest(data):
    rng = np.random.default_rng(4)
    return fk.Forest.build([data[rng.choice(300, 128, replace=False)] for _ in range(25)])


def test_trees_are_valid(forest):
    assert all(t.check() for t in forest.trees)
    assert all(t.total == 128 for t in forest.trees)


def test_score_matches_recursion(forest, data):
    q = np.concatenate([data[:40], np.full((1, 4), 9.0)])
    want = [np.mean([slow_score(t, x) for t in forest.trees]) for x in q]
    assert np.allclose(forest.score(q), want)
    assert forest.score(np.full((1, 4), 9.0))[0] > forest.score(np.zeros((1, 4)))[0]


def test_attribution_adds_up(forest, data):
    q = np.concatenate([data[:60], [[0, 0, 8.0, 0], [0, -8.0, 0, 0]]])
    high, low = forest.attribution(q)
    assert np.allclose(high.sum(1) + low.sum(1), forest.score(q), atol=1e-9)
    assert high[-2].argmax() == 2 and low[-1].argmax() == 1


def test_ignoring_light_leaves(forest, data):
    assert (forest.raw_score(data[:20], ignore=1) >= forest.raw_score(data[:20], ignore=0) - 1e-9).mean() > 0.9
    assert (forest.displacement(np.full((1, 4), 9.0)) > forest.displacement(np.zeros((1, 4)))).all()


def test_density(forest):
    near, far = forest.density(np.zeros((1, 4))), forest.density(np.full((1, 4), 7.0))
    assert forest.density_value(near)[0] > 10 * forest.density_value(far)[0]
    d = forest.directional_density(near)
    assert np.isclose(d.sum(), forest.density_value(near)[0])


def test_neighbours(forest, data):
    found = forest.neighbours(data[40] + 0.01, within=1.0)
    assert found and all(d < 1.0 for _, d, _, _ in found) and [f[1] for f in found] == sorted(f[1] for f in found)


def test_imputation_follows_the_known_coordinates():
    rng = np.random.default_rng(8)
    side = rng.integers(0, 2, 400) * 8.0 - 4
    x = np.stack([side + rng.normal(0, 0.3, 400), side + rng.normal(0, 0.3, 400), -side + rng.normal(0, 0.3, 400)], 1)
    forest = fk.Forest.build([x[k::2] for k in range(2)] * 8)
    for s in (4.0, -4.0):
        out = forest.impute([s, s, 0.0], [2])
        assert out[0] == out[1] == s and abs(out[2] + s) < 1.5
    assert (forest.impute([1.0, 2.0, 3.0], []) == [1.0, 2.0, 3.0]).all()


def test_extrapolation_of_a_cosine():
    wave = np.cos(2 * np.pi * np.arange(400) / 20)
    shingles = np.lib.stride_tricks.sliding_window_view(wave, 20)
    forest = fk.Forest.build([shingles[k::3] for k in range(12)])
    out = forest.extrapolate(shingles[-1], 1, 10)["value"].ravel()
    assert np.abs(out - np.cos(2 * np.pi * (400 + np.arange(10)) / 20)).max() < 0.1


def test_early_mean():
    mean, n = fk.early_mean([1.0, 2.0] * 50)
    assert n < 100 and abs(mean - 1.5) < 0.2
    assert fk.early_mean([]) == (0.0, 0)


def test_approximate_scores_stop_as_the_early_mean(forest, data):
    own = dict(seen_f=lambda d, m: 1 / (d + 2.0), unseen_f=lambda d, m: 1 / (d + 1.5), damp_f=fk.no_damp, ignore=1)
    q = np.concatenate([data[:60], np.full((1, 4), 9.0)])
    for how, norm in (({}, fk.log_normalizer), (own, lambda s, m: s)):
        for critical in (True, False):
            got, used = forest.approximate_score(q, 0.25, high_is_critical=critical, normalizer=norm, **how)
            high, low, spent = forest.approximate_attribution(q, 0.25, high_is_critical=critical, normalizer=norm, **how)
            for i, x in enumerate(q):
                mean, n = fk.early_mean([float(norm(t.score(x[None], **how)[0], t.total)) for t in forest.trees], 0.25, high_is_critical=critical)
                assert np.isclose(got[i], mean) and used[i] == n
                parts = [norm(np.hstack(t.attribution(x[None], **how))[0], t.total) for t in forest.trees]
                mean, n = fk.early_mean([float(p.sum()) for p in parts], 0.25, high_is_critical=critical)
                assert spent[i] == n and np.allclose(np.concatenate([high[i], low[i]]), np.mean(parts[:n], axis=0))
            assert used.min() < len(forest.trees)
    assert forest.approximate_score(np.zeros((0, 4)))[0].shape == (0,)


def test_uniform_is_uniform():
    u = uniform_np(np.arange(100000), 3, 1, 42)
    hist = np.histogram(u, 20, (0, 1))[0]
    assert u.min() > 0 and u.max() < 1 and abs(hist - 5000).max() < 350
    assert abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02


def test_one_point_walks(forest, data):
    for x in (data[0], data[40], np.full(4, 9.0), np.zeros(4)):
        assert np.isclose(forest.score_one(x), forest.score(x)[0])


def test_many_trees_at_once(data):
    samples = [data[:5], data[:1], data[40:60], np.ones((4, 4))]
    many = fk.Tree.build_many(samples, [7, 8, 9, 10], 3)
    for s, n, t in zip(samples, [7, 8, 9, 10], many, strict=True):
        one = fk.Tree.build(s, n, 3)
        assert t.check() and sorted(t.path) == sorted(one.path) and t.total == len(s)
        assert np.allclose(np.sort(t.cut), np.sort(one.cut))
    assert len(many[3].left) == 1 and many[3].total == 4


def test_valid_finds_broken_trees(spark, sf_dir):
    from pyspark.sql import functions as F

    from grovecast.operators import forest
    from grovecast.plans import table_queries as tq

    nodes = tq.nodes(spark, sf_dir)
    broken = nodes.withColumn("mass", F.when((F.col("tree") == 1) & (F.col("node") == 0), F.col("mass") + 1).otherwise(F.col("mass")))
    assert {r.tree: r.valid for r in forest.valid(broken).collect()} == {t: t != 1 for t in range(tq.TREES)}


def slow_completion(t, x, gone, centrality, draw, node=0, depth=0):
    """(rank, draw, leaf, distance) of one query in one tree, by recursion."""
    known = ~gone
    miss = (np.maximum(0, x - t.high[node]) + np.maximum(0, t.low[node] - x))[known].sum()
    if t.left[node] < 0:
        rank = 1 / (depth + 1) if miss > 0 else 1 / (depth + math.log2(t.mass[node] + 1)) if depth else 0.0
        return rank, draw(node), node, miss
    d = t.dim[node]
    sides = [c for c, go in ((t.left[node], gone[d] or x[d] <= t.cut[node]), (t.right[node], gone[d] or x[d] > t.cut[node])) if go]
    rank, drawn, leaf, dist = min((slow_completion(t, x, gone, centrality, draw, c, depth + 1) for c in sides), key=lambda r: (1 - centrality) * r[1] + centrality * r[0])
    if miss > 0:
        p = miss / (miss + (t.high[node] - t.low[node]).sum())
        rank = p / (depth + 1) + (1 - p) * rank
    return rank, drawn, leaf, dist


@pytest.mark.parametrize("centrality", [1.0, 0.4, 0.0])
def test_completions_match_recursion(forest, data, centrality):
    rng = np.random.default_rng(9)
    q = np.concatenate([data[:12], data[40:42], rng.normal(0, 2, (6, 4)), np.full((1, 4), 9.0)])
    gone = rng.random(q.shape) < 0.4
    gone[0], gone[1] = True, False
    q = np.where(gone, 0.0, q)
    nodes = forest.nodes
    leaf, dist = nodes.complete(q, gone, centrality)
    for i in range(len(q)):
        for k, t in enumerate(forest.trees):
            _, _, n, d = slow_completion(t, q[i], gone[i], centrality, lambda node, k=k: float(uniform_np(node, k, 5, 42)) if centrality != 1 else 0.0)
            assert (t.low[n] == nodes.low[leaf[i, k]]).all() and np.isclose(d, dist[i, k])


def test_many_rows_are_imputed_as_one_by_one(forest, data):
    gone = np.random.default_rng(10).random((90, 4)) < 0.3
    many = forest.impute_many(data[:90], gone)
    one = [forest.impute(x, np.flatnonzero(g)) for x, g in zip(data[:90], gone, strict=True)]
    assert (many == np.array(one)).all() and (many[~gone] == data[:90][~gone]).all()
    assert forest.impute_many(np.zeros((0, 4)), np.zeros((0, 4), bool)).shape == (0, 4)
