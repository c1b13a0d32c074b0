"""Queries over sequential models, clustering, persistence and text sources; mostly beyond SQL, tested by behaviour."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import clustering, forest
from ..sources import delimited
from ..streaming import detect
from ..streaming.online import OnlineForest, Predictive, Settings
from . import series_queries as sq
from . import table_queries as tq

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FAST = dict(trees=10, size=32)


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def folder(spark) -> str:
    """A new folder that executors and driver share: under the cluster's checkpoint folder, else a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
    return f"{named or tempfile.mkdtemp(prefix='grovecast-')}/{uuid.uuid4().hex}"


@query("csv_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    path = folder(spark)
    df = tq.read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    delimited.write_rows(df, path, "|", header=True)
    return spark.read.schema(df.schema).option("sep", "|").option("header", True).csv(path)


def _points(spark, sf):
    """The vectors as points of a run, numbered by vec_id: the place in a file would depend on how the table was written and is read."""
    return tq.V(spark, sf, None).select("seq", "x")


def _holed(spark, sf):
    """Every seventh point without its second coordinate."""
    return _points(spark, sf).withColumn("x", F.when(F.col("seq") % 7 == 0, F.transform("x", lambda v, i: F.when(i != 1, v))).otherwise(F.col("x")))


OPT = forest.Options(10, 32, 0.0)
_RUN = f"(SELECT id AS seq, 0 AS series, {tq._V}, tree, {tq.key_sql('tree', 0.0).replace('seq', 'id')} AS key FROM {tq._E}, (SELECT unnest(range(0, 10)) AS tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY key, seq) <= 32)"
_RUN_SCORE = tq.fold_sql(tq._SEEN, "1 / (depth + 1)", "{s} * log2(max(total) + 1)").replace(tq._S, _RUN)
query("run_score", f"SELECT id AS seq, score AS anomaly_score FROM ({_RUN_SCORE})")(lambda s, sf: delimited.score_run(_points(s, sf), OPT).select("seq", F.round("anomaly_score", 6).alias("anomaly_score")))
query("run_attribution")(lambda s, sf: delimited.attribution_run(_points(s, sf), OPT))
query("run_density")(lambda s, sf: delimited.density_run(_points(s, sf), OPT))
query("run_impute")(lambda s, sf: delimited.impute_run(_holed(s, sf), OPT))
for _run in ("score", "attribution", "density"):
    query(f"run_{_run}_sequential")(lambda s, sf, run=_run: delimited.sequential(_points(s, sf), OPT, run))
query("run_impute_sequential")(lambda s, sf: delimited.sequential(_holed(s, sf), OPT, "impute"))


@query("save_load_score", tq.ORACLES["anomaly_score"])
def _(spark, sf):
    path = folder(spark)
    forest.save(tq.nodes(spark, sf), path)
    return tq.R6(forest.scores(tq.V(spark, sf), spark.read.parquet(path), keep=["id"]))


query("prequential_score")(lambda s, sf: detect.prequential_scores(sq.E(s, sf), 10, 32))
query("detector_process")(lambda s, sf: detect.process(sq.E(s, sf), Settings(**FAST)).select("series", "seq", "score", "threshold", "grade", "confidence", "mode", "relative_index", "expected"))
query("detector_anomalies_only")(lambda s, sf: detect.anomalies(detect.process(sq.E(s, sf), Settings(**FAST, scoring="MULTI_MODE", auto_adjust=True))))
query("detector_time_augmented")(lambda s, sf: detect.process(sq.E(s, sf), Settings(**FAST, mode="TIME_AUGMENTED")).select("series", "seq", "score", "grade"))
query("detector_streaming_impute")(lambda s, sf: detect.process(sq.H(s, sf), Settings(**FAST, mode="STREAMING_IMPUTE", imputation="LINEAR")).select("series", "seq", "score", "grade", "imputed"))
query("caster_process")(lambda s, sf: detect.process(sq.E(s, sf), Settings(**FAST), horizon=3).select("series", "seq", "score", "forecast", "upper", "lower", "precision"))
query("sequential_forecast")(lambda s, sf: detect.analyse(sq.E(s, sf), Settings(**FAST), 3)[1])


@query("multi_series_shared_models")
def _(spark, sf):
    e = sq.E(spark, sf)
    return detect.multi(e, detect.shared_models(e, 3, 4, 10, 32), 4)


@query("stream_process")
def _(spark, sf):
    """The detector over a file stream, run until the files are read."""
    path, was = folder(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source = f"{path}/in"
    sq.E(spark, sf).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", detect.ROCKSDB)
    try:
        live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        done = detect.stream(live, Settings(**FAST)).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.parquet(f"{path}/out").select("series", "seq", "score", "threshold", "grade", "late")


@query(
    "stream_windowed_counts",
    "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'",
)
def _(spark, sf):
    path = folder(spark)
    source = f"{sf}/events.parquet"
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf}/events*.parquet")
    df = detect.windowed_counts(live.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x")), "1 day", "1 hour")
    done = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


query("cluster_summarize")(lambda s, sf: clustering.clusters(tq.V(s, sf, None).select("seq", "x", F.lit(1.0).alias("w")), 6))
query("cluster_multi_representative")(lambda s, sf: clustering.clusters(tq.V(s, sf, None).select("label", "seq", "x", F.lit(1.0).alias("w")), 3, by=["label"], reps=3, shrinkage=0.2, distance="L1"))
query("object_outliers")(lambda s, sf: clustering.outliers(tq.read(s, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("o")), clustering.edit_distance, "brand", capacity=60, most=3, every=40))


@query("predictive_forest")
def _(spark, sf):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        p = Predictive(Settings(**FAST, transform="NONE"))
        for t, x in zip(part["t"], part["x"], strict=True):
            p.update(t, x)
        return pd.DataFrame({"series": [part["series"].iloc[0]], "score": [p.score(1e6)], "density": [p.density(0.0)], "predicted": [float(p.predict([np.nan], [0])[0])]})

    return sq.E(spark, sf).groupBy("series").applyInPandas(run, "series long, score double, density double, predicted double")


@query("forest_merge")
def _(spark, sf):
    """Two halves of every series, modelled apart and merged."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("seq")["x"].to_numpy(float)
        a, b = OnlineForest(1, 5, 16), OnlineForest(1, 5, 16, seed=43)
        for m, half in ((a, x[: len(x) // 2]), (b, x[len(x) // 2 :])):
            for v in half:
                m.update([v])
        a.merge(b)
        return pd.DataFrame({"series": [part["series"].iloc[0]], "updates": [a.updates], "size": [sum(map(len, a.keys))], "score": [a.score([1e6])]})

    return sq.E(spark, sf).groupBy("series").applyInPandas(run, "series long, updates long, size long, score double")


