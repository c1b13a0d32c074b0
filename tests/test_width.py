"""Queries see whole embeddings and all series."""

from grovecast.plans import catalogue


def test_queries_use_all_coordinates(spark, sf_dir):
    """They call V and nodes at full width, and so does the SQL of those that have any."""
    wide = ("anomaly_attribution approximate_score approximate_attribution dynamic_attribution simulated_score simple_density impute_missing conditional_summary forest_attributes forest_per_label "
            "run_score run_attribution run_density run_impute cluster_summarize cluster_multi_representative").split()
    from unittest import mock

    from grovecast.plans import table_queries as tq

    assert tq.DIMS is None and all("v63" in catalogue.ORACLES[n] for n in ("anomaly_score", "simulated_score", "run_score", "knn_in_sample"))
    real = tq.V
    for name in wide:
        seen = []
        with mock.patch.object(tq, "V", lambda s, sf, dims=tq.DIMS, seen=seen: (seen.append(dims), real(s, sf, dims))[1]):
            catalogue.QUERIES[name](spark, sf_dir)
        assert seen and set(seen) == {None}, name


def test_extrapolate_covers_every_series(spark, sf_dir):
    """Each series that fills a shingle is extrapolated."""
    from grovecast.operators import framing
    from grovecast.plans import series_queries as sq

    want = {r.series for r in framing.shingle(sq.E(spark, sf_dir), 4).select("series").distinct().collect()}
    got = [r.series for r in catalogue.QUERIES["extrapolate"](spark, sf_dir).select("series").distinct().collect()]
    assert set(got) == want and len(want) > 5


def test_extrapolate_without_node_tables(spark, sf_dir):
    """one pass gives what a node table of each series gives, also where batches end inside a series; the query trains no table."""
    from unittest import mock

    from pyspark.sql import functions as F

    from grovecast.operators import forest, framing
    from grovecast.plans import series_queries as sq

    sh = framing.shingle(sq.E(spark, sf_dir), 4).withColumn("x", F.col("shingle"))
    last = sh.groupBy("series").agg(F.max(F.struct("seq", "x")).alias("m")).select("series", "m.x")
    model = forest.train(sh.select("seq", "series", "x"), forest.Options(10, 32, 0.001), by=["series"])
    want = {r.series: r for r in forest.extrapolations(last, model, 1, 5, keep=["series"], by=["series"]).collect()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in (was, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            with mock.patch.object(forest, "train", side_effect=AssertionError):
                got = catalogue.QUERIES["extrapolate"](spark, sf_dir).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert len(got) == len(want) and all(r == want[r.series] for r in got)


def test_caster_goes_in_step(spark, sf_dir):
    """series in step give, to the last bit, what Caster gives row by row, also where a series has a hole or batches end inside series."""
    import math
    from unittest import mock

    import pandas as pd

    from grovecast.plans import series_queries as sq
    from grovecast.streaming import detect, fleet
    from grovecast.streaming.online import Caster, Settings

    names = ["score", "threshold", "grade", "confidence", "relative_index", "mode", "expected", "attribution_high", "attribution_low", "forecast", "upper", "lower", "precision"]
    settings = Settings(trees=10, size=32)
    frame = sq.E(spark, sf_dir).toPandas().sort_values(["series", "t", "seq"])
    holed = sorted(frame["series"].unique())[0]
    frame.loc[(frame["series"] == holed) & (frame["seq"] == 20), "x"] = math.nan
    spike = frame.groupby("series").cumcount() % 31 == 30
    frame.loc[spike, "x"] += 1e4  # graded rows
    want, odd = {}, 0
    for series, part in frame.groupby("series"):
        caster = Caster(settings, 3)
        for t, x in zip(part["t"], part["x"], strict=True):
            r = caster.process(int(t), x)
            want[series, r.seq] = [getattr(r, n) for n in names]
            odd += r.expected is not None
    assert odd > 20
    df = spark.createDataFrame(pd.DataFrame(frame), "series long, seq long, t long, x double")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch, rows in ((was, fleet.ROWS), ("20", 50)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            with mock.patch.object(fleet, "ROWS", rows):
                out = detect.process(df, settings, horizon=3)
            assert "MapInArrow" in out._jdf.queryExecution().toString()
            got = {(r.series, r.seq): [r[n] for n in names] for r in out.collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        assert got == want
    plain = [p["x"].to_numpy(float) for s, p in frame.groupby("series") if s != holed]
    with mock.patch.object(fleet, "TREE_BYTES", 1):
        alone = fleet.process(settings, 3, plain)
    assert (alone["forecast"] == fleet.process(settings, 3, plain)["forecast"]).all()


def test_anomalies_go_in_step(spark, sf_dir):
    """F1: detector_anomalies_only takes series in step and gives, to the last bit, what Detector gives row by row; so do other settings of two scores."""
    from collections import Counter
    from unittest import mock

    import pandas as pd

    from grovecast.plans import series_queries as sq
    from grovecast.streaming import detect
    from grovecast.streaming.online import Detector, Settings

    names = ["score", "threshold", "grade", "confidence", "relative_index", "mode", "expected", "attribution_high", "attribution_low"]
    frame = sq.E(spark, sf_dir).toPandas().sort_values(["series", "t", "seq"])
    spike = frame.groupby("series").cumcount() % 31 == 30
    frame.loc[spike, "x"] += 1e4
    runs = frame["series"] % 3 == 0
    frame.loc[runs, "x"] = frame.loc[runs, "x"] // 50  # repeated points
    df = spark.createDataFrame(pd.DataFrame(frame), "series long, seq long, t long, x double")
    with mock.patch.object(sq, "E", lambda s, sf: df):
        out = catalogue.QUERIES["detector_anomalies_only"](spark, sf_dir)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    parts = [(series, p["t"].to_numpy(), p["x"].to_numpy(float)) for series, p in frame.groupby("series")]
    modes = Counter()
    for settings in (Settings(trees=10, size=32, scoring="MULTI_MODE", auto_adjust=True), Settings(trees=4, size=16, shingle=9, scoring="MULTI_MODE_RECALL", transform="NONE")):
        want = {}
        for series, t, x in parts:
            model = Detector(settings)
            for k, v in zip(t, x, strict=True):
                r = model.process(int(k), v)
                want[series, r.seq] = [getattr(r, n) for n in names]
                modes[r.mode, r.grade > 0] += 1
        got = {(r.series, r.seq): [r[n] for n in names] for r in detect.process(df, settings).collect()}
        assert got == want
        if settings.scoring == "MULTI_MODE":
            assert {(r.series, r.seq): [r[n] for n in names] for r in out.collect()} == {k: v for k, v in want.items() if v[2] > 0}
    assert modes["NONE", True] > 10 and modes["MULTI_MODE", False] and modes["CONDITIONAL_FORECAST", False] and modes["ANOMALY_IN_SHINGLE", False]


def test_sums_of_distances():
    """many points at once, each by its own trees, have the sum of the distances that density() gives one by one; and trees near a point are counted without neighbours."""
    import numpy as np

    from grovecast.streaming.grove import columns
    from grovecast.streaming.online import OnlineForest

    rng = np.random.default_rng(3)
    for n in (1, 3, 7, 8, 9, 23, 130, 300):
        v = np.abs(rng.normal(size=(5, n)))
        assert (columns(v.T) == v.sum(1)).all()
        assert (columns(v.T, 4) == np.stack([v, 0 * v], 2).reshape(5, -1).sum(1)).all()
    for dims in (1, 4, 9, 20):
        m = OnlineForest(dims, 6, 16, 0.02)
        x = rng.integers(0, 3, (120, dims)).astype(float)
        x[::2] = rng.normal(size=(60, dims)).astype(np.float32)
        for k, v in enumerate(x):
            m.update(v)
            if k < 20:
                continue
            q = np.stack([v, x[k // 2], v + 1, np.full(dims, 1e6)]).astype(np.float32).astype(float)
            f = m.forest()
            score, far = m.grove.scores_distances(q, np.tile(np.arange(6), (4, 1)))
            assert score.tolist() == [m.score(p) for p in q]
            want = np.array([f.density(p)["distance"].sum() for p in q])
            assert (far == want).all() if dims < 10 else np.allclose(far, want, rtol=1e-15, atol=0)
            if k % 20 == 0:
                assert [f.near(p, 2.0) for p in q] == [sum(e[3] for e in f.neighbours(p, 2.0)) for p in q]
