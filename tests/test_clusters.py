"""Clusters describe the whole table, not their sample."""

import numpy as np

from grovecast.operators import clustering
from grovecast.plans import catalogue


def test_weights_add_up_to_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    rows = catalogue.QUERIES["cluster_summarize"](spark, sf).collect()
    assert abs(sum(r.weight for r in rows) - n) < 1e-6


def test_sampled_clusters_measure_all_rows(spark):
    """Of two groups, one with a heavy point, sampled far below their size."""
    rng = np.random.default_rng(0)
    rows = [(g, 1000 * g + k, [float(v) for v in rng.normal(20 * (k % 2), 1, 2)], 50.0 if (g, k) == (1, 7) else 1.0) for g in (0, 1) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, seq long, x array<double>, w double")
    found = clustering.clusters(df, 2, 100, ["g"]).collect()
    for g in (0, 1):
        mine = [r for r in found if r.g == g]
        part = [r for r in rows if r[0] == g]
        want = [clustering.Cluster([np.array(r.rep)], [1.0]) for r in mine]
        clustering.assign([np.array(r[2]) for r in part], [r[3] for r in part], want, clustering.l2)
        assert len(mine) == 2 and abs(sum(r.weight for r in mine) - sum(r[3] for r in part)) < 1e-6
        assert all(abs(r.weight - c.weight) < 1e-6 and abs(r.radius - c.radius) < 1e-9 for r, c in zip(mine, want))


def test_merge_of_outlier_models_on_one_clock():
    """After a merge the sample leans to the rows of the later clock, whichever model they came from."""
    from grovecast.operators.clustering import GlobalLocal, l1

    old, new = (GlobalLocal(l1, capacity=40, decay=0.05, seed=s) for s in (1, 2))
    for k in range(60):
        old.process(np.array([0.0, k % 3]))
    for k in range(600):
        new.process(np.array([9.0, k % 3]))
    for a, b in ((old, new), (new, old)):
        both = GlobalLocal(l1, capacity=40, decay=0.05)
        both.keys, both.objects, both.weights, both.n, both.elapsed = list(a.keys), list(a.objects), list(a.weights), a.n, a.elapsed
        both.merge(b)
        # both models' last rows count as equally recent: about half of the sample is of either
        assert 8 <= sum(x[0] == 0 for x in both.objects) <= 32 and both.elapsed == new.elapsed
