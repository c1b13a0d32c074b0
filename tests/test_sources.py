"""Delimited text: rows are numbered in file order, and series are framed in blocks that tasks share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovecast import cli
from grovecast.operators import framing
from grovecast.operators.forest import Options
from grovecast.operators.sampling import reservoir
from grovecast.sources import delimited
from grovecast.streaming.online import OnlineForest


def test_seq_over_files_and_splits(spark, tmp_path):
    n = 0
    for name, rows in (("a", 50), ("b", 4000), ("c", 0), ("d", 700)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{k},NA\n" for k in range(n, n + rows)))
        n += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        points = delimited.read_points(spark, str(tmp_path))
        got = points.collect()
        assert len({r.seq for r in got}) == n and all(r.x == [float(r.seq), None] for r in got)
        # a decayed sample prefers late rows of all files, not those of one task
        late = reservoir(points.select("seq"), 4, 64, 1 / 1000).agg(F.avg("seq"), F.min("seq")).first()
        assert late[0] > n / 2 and late[1] < n - 700
        assert reservoir(points.select("seq"), 4, 64, 0.0).where(f"seq < {n // 2}").count() > 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("1,2\n")
    assert [tuple(r) for r in delimited.read_points(spark, str(tmp_path)).collect()] == [(0, [1.0, 2.0])]


def test_shingle_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), F.array(F.col("id").cast("double")).alias("x"))
    for rotate in (False, True):
        want = framing.shingle(df.withColumn("series", F.lit(0)), 4, rotate=rotate).select("seq", "shingle")
        for rows in (4, 7, 1000):
            got = framing.shingle_blocks(df.repartition(3), 4, rotate=rotate, rows=rows).select("seq", "shingle")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "in.csv").write_text("".join(f"{x:.4f}\n" for x in rng.normal(size=300)))
    cli.main(["score", str(tmp_path / "in.csv"), str(tmp_path / "out"), "-n", "5", "-s", "32", "-g", "4", "-w", "100"], spark)
    assert spark.read.csv(str(tmp_path / "out")).count() == 297


def test_sequential_runs(spark):
    """Each row is answered by the model of the rows before it, for any partitioning."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)).astype(np.float32).astype(float)
    x[90] = 9.0
    options = Options(6, 16, 0.01, output_after=8)
    holed = {k: k % 3 for k in range(5, 120, 10)}
    rows = [(k, [None if holed.get(k) == i else float(v) for i, v in enumerate(r)]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, x array<double>").union(spark.createDataFrame([(500, None)], "seq long, x array<double>"))
    got = {run: sorted(map(tuple, delimited.sequential(df.repartition(5), options, run).collect())) for run in delimited.RUNS}
    model, want = OnlineForest(3, 6, 16, 0.01, output_after=8), {run: [] for run in delimited.RUNS}
    for k, r in enumerate(x):
        f = model.forest() if model.ready else None
        if k in holed:
            filled = r.copy()
            filled[holed[k]] = 0.0
            want["impute"].append((k, list(f.impute(filled, [holed[k]]) if f else filled)))
            continue
        high, low = (v[0] for v in f.attribution(r)) if f else (np.zeros(3),) * 2
        prob = f.density(r)["prob"][0] if f else np.zeros((3, 2))
        want["score"].append((k, list(r), f.score_one(r) if f else 0.0))
        want["attribution"].append((k, list(r), list(low), list(high)))
        want["density"].append((k, list(r), list(prob[:, 0]), list(prob[:, 1])))
        want["impute"].append((k, list(r)))
        model.update(r)
    for run in delimited.RUNS:
        assert len(got[run]) == len(want[run])
        for a, b in zip(got[run], want[run], strict=True):
            assert a[0] == b[0] and all(np.allclose(u, v) for u, v in zip(a[1:], b[1:], strict=True))
    assert max(got["score"], key=lambda r: r[2])[0] == 90
    assert got["score"][0][2] == 0.0 and delimited.sequential(df.limit(0), options, "score").collect() == []
    with pytest.raises(ValueError):
        delimited.sequential(df, options, "update")


def test_command_line_sequential(spark, tmp_path):
    rng = np.random.default_rng(5)
    (tmp_path / "in.csv").write_text("".join(f"{a:.3f},{b:.3f}\n" for a, b in rng.normal(size=(100, 2))))
    cli.main(["attribution", str(tmp_path / "in.csv"), str(tmp_path / "out"), "-n", "4", "-s", "16", "--sequential"], spark)
    out = spark.read.csv(str(tmp_path / "out"))
    assert out.count() == 100 and len(out.columns) == 7


def test_options():
    assert Options(sample_size=8).output_after == 2
