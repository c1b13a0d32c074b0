"""Every query with SQL gives the rows that DuckDB gives; the others give rows of a stable schema."""

import glob
import os

import duckdb
import pytest

from grovecast.plans import catalogue

#: sequential models: run on a few short series below; test_online.py has what they compute
SLOW = {n for n in catalogue.QUERIES if n.startswith(("detector_", "caster_", "sequential_", "prequential_", "predictive_", "stream_process"))}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_rows(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


@pytest.fixture(scope="module")
def short_dir(spark, sf_dir, tmp_path_factory):
    """The tables, with 40 events of each of three users."""
    import shutil

    out = tmp_path_factory.mktemp("short")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        if os.path.basename(f) != "events.parquet":
            (shutil.copytree if os.path.isdir(f) else shutil.copy)(f, out / os.path.basename(f))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id % 3 AS user_id) FROM '{sf_dir}/events.parquet' ORDER BY event_id LIMIT 120) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_sequential_queries(spark, short_dir, name):
    df = catalogue.QUERIES[name](spark, short_dir)
    rows = df.collect()
    assert df.columns
    if name == "detector_anomalies_only":  # short quiet series have none
        assert all(r.grade > 0 for r in rows)
        return
    assert rows
    if "series" in df.columns:
        assert {int(r.series) for r in rows} == {0, 1, 2}


def differing(spark, name, path):
    """Rows that only the query or only its SQL gives, over the tables at path."""
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    df = catalogue.QUERIES[name](spark, path)
    got = {tuple(plain(v) for v in r) for r in df.collect()}
    want = {tuple(plain(v) for v in r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()}
    assert got and want
    return got ^ want


def test_contribution_block_of_near_ties_and_holes(spark, tmp_path):
    """Sums of cents that are equal but for rounding, and windows with holes."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 40 AS user_id, 'x' AS event_type, CASE WHEN hash(i, 'n') % 13 = 0 THEN NULL ELSE (hash(i) % 40)::DOUBLE / 100 END AS value, '' AS props
  FROM (SELECT unnest(range(0, 8000))::BIGINT AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    assert not differing(spark, "contribution_block", str(tmp_path))


def test_normalised_steps_on_the_clip(spark, tmp_path):
    """Second values 100 away from the first: only the rounding of the first row's statistics tells whether they are clipped."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 3 AS user_id, 'x' AS event_type,
  (CASE WHEN i % 3 = 2 THEN hash(i) ELSE hash(i // 3) END % 45000) / 100.0::DOUBLE + CASE WHEN i % 3 <> 1 THEN 0 WHEN i % 2 = 0 THEN 100 ELSE -100 END AS value, '' AS props
  FROM (SELECT unnest(range(0, 6000))::BIGINT AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    for name in ("inverse_normalize", "transform_normalize"):
        assert not differing(spark, name, str(tmp_path)), name


def test_alerts_do_not_depend_on_files(spark, tmp_path):
    """values in runs, where a series' mean equals its value but for rounding: the same alerts from one file and from seven."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i // 72 AS user_id, 'x' AS event_type, (hash(i // 6) % 50000) / 100.0::DOUBLE AS value, '' AS props
  FROM (SELECT unnest(range(0, 28800))::BIGINT AS i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    other = tmp_path / "other"
    other.mkdir()
    spark.read.parquet(f"{tmp_path}/events.parquet").repartition(7, "event_id").write.parquet(f"{other}/events.parquet")
    one, seven = ({tuple(r) for r in catalogue.QUERIES["alert_filter"](spark, str(p)).collect()} for p in (tmp_path, other))
    assert one and one == seven


def test_run_score_numbers_rows_by_id(spark, sf_dir, tmp_path):
    """The table in several files, its rows in no order."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 3 <> 1")
    v.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert not differing(spark, "run_score", str(tmp_path))


def test_knn_over_blocks(spark, sf_dir, tmp_path, monkeypatch):
    """Many blocks, copies of a vector, a vector that is missing; and no bound on the rows of the sample."""
    from grovecast.operators import distance

    monkeypatch.setattr(distance, "BLOCK", 150)
    monkeypatch.setattr(distance, "CENTRES_MOST", 100)
    monkeypatch.setattr(distance.small, "__defaults__", (100,))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id, CASE WHEN vec_id = 7 THEN NULL WHEN vec_id % 9 = 0 THEN (SELECT embedding FROM '{sf_dir}/embeddings.parquet' WHERE vec_id = 0) ELSE embedding END AS embedding, label FROM '{sf_dir}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    assert not differing(spark, "knn_in_sample", str(tmp_path))


def test_llm_is_optional():
    """The library imports and lists its queries where the subpackage for training data is missing."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['grovecast.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'anomaly_score' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
