import math
import os

import numpy as np
import pandas as pd
import pytest

from grovecast.operators import clustering
from grovecast.operators.forest_kernel import Tree
from grovecast.streaming import detect, online


def wave(n=500, spikes=(), noise=0.1, seed=0):
    rng = np.random.default_rng(seed)
    x = 10 * np.cos(2 * math.pi * np.arange(n) / 20) + noise * rng.normal(size=n)
    for s in spikes:
        x[s] += 40
    return x


def run(model, x, step=1_000_000):
    return [model.process(k * step, v) for k, v in enumerate(x)]


def test_decayed():
    d = online.Decayed(0.1)
    w = s = q = 0.0
    for v in (3.0, 1.0, 4.0):
        w, s, q = w * 0.9 + 1, s * 0.9 + v, q * 0.9 + v * v
        d.add(v)
    assert math.isclose(d.mean, s / w) and math.isclose(d.dev, math.sqrt(q / w - (s / w) ** 2))


def test_sample_is_the_least_keys():
    """The retained set is the top-k of the keys, whatever the order of eviction."""
    m = online.OnlineForest(1, 3, 8, 0.01)
    for k in range(200):
        m.update([float(k)])
    from grovecast.functions.rng import uniform_np

    seq = np.arange(200)
    for t in range(3):
        key = -0.01 * (seq + 1) + np.log(-np.log(uniform_np(seq, t, 1, 42)))
        assert sorted(m.seqs[t]) == sorted(np.argsort(key)[:8])


def test_recency():
    m = online.OnlineForest(1, 50, 64, 0.05)
    for k in range(2000):
        m.update([float(k)])
    age = 2000 - np.concatenate(m.seqs)
    assert np.median(age) < 150


def test_spike_is_found_and_explained():
    got = run(online.Detector(online.Settings(shingle=8, trees=20, size=128)), wave(spikes=(350, 430)))
    hits = [r.seq - 1 for r in got if r.grade > 0]
    assert 350 in hits and 430 in hits and len(hits) <= 8
    r = got[350]
    assert r.relative_index == 0 and abs(r.expected[0] - wave()[350]) < 8
    assert math.isclose(sum(r.attribution_high) + sum(r.attribution_low), r.score, rel_tol=1e-6)
    assert sum(r.attribution_high) > sum(r.attribution_low)
    assert 0 < got[-1].confidence <= 1


@pytest.mark.parametrize("transform", ["NONE", "WEIGHTED", "SUBTRACT_MA", "NORMALIZE", "DIFFERENCE", "NORMALIZE_DIFFERENCE"])
@pytest.mark.parametrize("scoring", ["EXPECTED_INVERSE_DEPTH", "MULTI_MODE", "MULTI_MODE_RECALL", "DISTANCE"])
def test_settings(transform, scoring):
    got = run(online.Detector(online.Settings(shingle=4, trees=8, size=32, transform=transform, scoring=scoring, auto_adjust=True, alert_once=True)), wave(160, (140,)))
    assert got[140].score >= np.median([r.score for r in got[60:135]])


def test_bad_settings():
    for bad in (dict(inputs=0), dict(transform="X"), dict(mode="X"), dict(imputation="X"), dict(scoring="X"), dict(weights=[1.0, 2.0]), dict(transform="NONE", weights=[2.0]), dict(mode="STREAMING_IMPUTE", shingle=1)):
        with pytest.raises(ValueError):
            online.Settings(**bad)
    with pytest.raises(ValueError):
        online.OnlineForest(0)
    with pytest.raises(ValueError):
        Tree.build(np.zeros((0, 2)))


def test_late_rows_leave_the_model_alone():
    m = online.Detector(online.Settings(shingle=2, trees=4, size=16))
    run(m, wave(40))
    before = m.forest.updates
    assert m.process(5, 1.0).late and m.forest.updates == before


def test_gaps_are_filled():
    for how in ("ZERO", "FIXED_VALUES", "PREVIOUS", "NEXT", "LINEAR", "FOREST"):
        m = online.Detector(online.Settings(shingle=4, trees=5, size=32, mode="STREAMING_IMPUTE", imputation=how))
        run(m, wave(60))
        assert m.process(64_000_000, 1.0).imputed == 4
        m.process(65_000_000, float("nan"))


def test_forecast_of_a_wave():
    m = online.Caster(online.Settings(shingle=20, trees=20, size=128), 5, error_horizon=20)
    got = run(m, wave(400, noise=0.05))
    f = got[-1]
    want = 10 * np.cos(2 * math.pi * (np.arange(400, 405)) / 20)
    assert np.abs(np.array(f.forecast) - want).mean() < 3
    assert all(a <= b <= c for a, b, c in zip(f.lower, f.forecast, f.upper, strict=True))
    assert f.precision > 0.7


def test_error_estimator():
    m = online.Caster(online.Settings(shingle=4, trees=8, size=32), 2, error_horizon=10, calibration="MINIMAL", estimator=True)
    got = run(m, wave(150, noise=0.5))
    assert all(a <= b <= c for a, b, c in zip(got[-1].lower, got[-1].forecast, got[-1].upper, strict=True))
    assert m.errors.forest.ready


def test_intervals_of_inputs_of_different_scale():
    """Every input has its own errors: a quiet one keeps a narrow interval beside a loud one."""
    rng = np.random.default_rng(12)
    m = online.Caster(online.Settings(shingle=4, trees=10, size=64, inputs=2, transform="NONE"), 2, error_horizon=10, calibration="MINIMAL")
    for k in range(260):
        out = m.process(k * 1_000_000, [rng.normal(0, 0.1), rng.normal(0, 20.0)])
    width = (np.array(out.upper) - np.array(out.lower)).reshape(2, 2)
    assert (width[:, 0] * 20 < width[:, 1]).all()
    spread = [[st["up"].mean ** 0.5 for st in step] for step in m.errors.stats]
    assert all(a < 0.5 and b > 5 for a, b in spread)


def test_first_rows_are_replayed_with_their_gaps():
    m = online.Detector(online.Settings(shingle=1, trees=3, size=16, mode="TIME_AUGMENTED", transform="NORMALIZE"))
    pushed = []
    was = m._transform
    m._transform = lambda x, gap: (pushed.append(gap), was(x, gap))[1]
    for k in range(m.s.start):
        m.process(k * 3_000_000, [float(k % 5)])
    assert pushed == [0.0] + [3.0] * (m.s.start - 1)


def test_state_round_trip():
    x = wave(120)
    a = online.Caster(online.Settings(shingle=4, trees=6, size=32), 2)
    run(a, x[:100])
    b = online.restore(online.dump(a))
    for k in range(100, 120):
        assert a.process(k * 1_000_000, x[k]) == b.process(k * 1_000_000, x[k])


def test_merge():
    a, b = online.OnlineForest(1, 4, 16), online.OnlineForest(1, 4, 16, seed=1)
    for k in range(50):
        a.update([float(k)])
        b.update([float(k + 100)])
    a.merge(b)
    assert a.updates == 100 and all(len(k) == 16 for k in a.keys) and a.score([1e4]) > a.score([50.0])


def test_bandit():
    b = online.Bandit(2, 10)
    for _ in range(20):
        b.add([1.0, 0.5])
    assert b.chosen == 1 and b.switches == 1 and b.affirmations == 1


def test_predictive():
    p = online.Predictive(online.Settings(shingle=1, trees=20, size=64, inputs=2, transform="NONE"))
    rng = np.random.default_rng(1)
    for k in range(200):
        side = rng.integers(0, 2) * 10.0
        p.update(k, [side, side + rng.normal()])
    assert p.score([100.0, 100.0]) > p.score([10.0, 10.0]) and p.density([10.0, 10.0]) > p.density([60.0, 60.0])
    assert abs(p.predict([10.0, np.nan], [1])[1] - 10) < 4


def test_clusters_of_blades():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 4, 400)
    x = np.array([[math.cos(t * math.pi / 2) * 5, math.sin(t * math.pi / 2) * 5] for t in truth]) + rng.normal(0, 0.3, (400, 2))
    for reps, norm in ((1, "L2"), (3, "L1"), (1, "LINF")):
        found = clustering.summarize(list(x), None, 8, norm, reps)
        assert len(found) == 4 and abs(sum(c.weight for c in found) - 400) < 1e-6
        assert all(min(abs(np.linalg.norm(r) - 5) for r in c.reps) < 1 for c in found)


def test_strings_out_of_place():
    rng = np.random.default_rng(3)
    g = clustering.GlobalLocal(clustering.edit_distance, capacity=80, most=4, every=60)
    scores = []
    for k in range(260):
        odd = k % 50 == 49
        s = "".join(rng.choice(list("xyz" if odd else "ab"), 20, p=None if odd else [0.9, 0.1]))
        scores.append((odd, g.process(s)[0]))
    late = scores[100:]
    assert np.mean([s for o, s in late if o]) > 1.5 * np.mean([s for o, s in late if not o])


def test_batch_equals_stream(spark, tmp_path):
    rows = [(s, k, k * 1_000_000, float(v)) for s in (1, 2) for k, v in enumerate(wave(60, (50,), seed=s))]
    df = spark.createDataFrame(rows, "series long, seq long, t long, x double")
    settings = online.Settings(shingle=4, trees=5, size=16)
    want = sorted(map(tuple, detect.process(df, settings).select("series", "seq", "score", "grade").collect()))
    for n, part in enumerate((df.where("seq < 30"), df.where("seq >= 30"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", detect.ROCKSDB)
        live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        detect.stream(live, settings).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        assert n < 2
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("series", "seq", "score", "grade").collect()))
    assert got == want
    # any partitioning gives the same
    again = detect.process(df.repartition(7), settings).select("series", "seq", "score", "grade")
    assert sorted(map(tuple, again.collect())) == want


def test_ascending(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0)], "series long, t long, x double")
    with pytest.raises(Exception, match="ascend"):
        detect.process(df, online.Settings(), ascending=True).collect()


def test_command_line(spark, tmp_path):
    from grovecast import cli

    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.normal(size=(200, 3)).round(4))
    x.iloc[150] = 9.0
    x.to_csv(tmp_path / "in.csv", header=False, index=False)
    cli.main(["score", str(tmp_path / "in.csv"), str(tmp_path / "out"), "-n", "10", "-s", "64"], spark)
    rows = [r for f in os.listdir(tmp_path / "out") if f.endswith(".csv") for r in open(tmp_path / "out" / f).read().split()]
    table = np.array([[float(v) for v in r.split(",")] for r in rows])
    assert table.shape == (200, 5) and table[table[:, -1].argmax(), 1] == 9.0
    y = x.astype(object)
    y.iloc[3, 1] = "NA"
    y.to_csv(tmp_path / "holes.csv", header=False, index=False)
    cli.main(["impute", str(tmp_path / "holes.csv"), str(tmp_path / "filled"), "-n", "5", "-s", "64"], spark)
    rows = [r for f in os.listdir(tmp_path / "filled") if f.endswith(".csv") for r in open(tmp_path / "filled" / f).read().split()]
    assert len(rows) == 200 and not any("NA" in r or ",," in r for r in rows)
    cli.main(["update", str(tmp_path / "in.csv"), str(tmp_path / "model"), "-n", "3", "-s", "16"], spark)
    assert spark.read.parquet(str(tmp_path / "model")).select("tree").distinct().count() == 3
