"""Delimited text in and out, and the runs that read points from it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest


def read_points(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, marker: str = "NA") -> DataFrame:
    """(seq, x): every column is a coordinate; marker cells and empty ones are null.

    seq numbers the rows from 0 without gaps, by file name and then by place in the file: rows of each piece of a file
    are counted first, and the pieces' offsets, as many as the scan has pieces, are joined to the rows.
    """
    df = spark.read.option("sep", delimiter).option("header", header).option("nullValue", marker).csv(path)
    piece = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    rows = df.select(F.array(*(F.col(f"`{c}`").cast("double") for c in df.columns)).alias("x"), *piece, F.monotonically_increasing_id().alias("__id"))
    sizes = rows.groupBy("__file", "__start").agg(F.min("__id").alias("first"), F.count("*").alias("n")).orderBy("__file", "__start").collect()
    ends = list(accumulate((r["n"] for r in sizes), initial=0))
    offsets = spark.createDataFrame([(r["__file"], r["__start"], end - r["first"]) for r, end in zip(sizes, ends, strict=False)], "__file string, __start long, __shift long")
    return rows.join(F.broadcast(offsets), ["__file", "__start"]).select((F.col("__id") + F.col("__shift")).alias("seq"), "x")


def write_rows(df: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    """Array columns are laid out as one column for each element."""
    lists = [c for c, kind in df.dtypes if kind.startswith("array")]
    sizes = df.agg(*(F.max(F.size(c)).alias(c) for c in lists)).first().asDict() if lists else {}
    out = []
    for c in df.columns:
        out += [F.col(c)[i].alias(f"{c}_{i}") for i in range(sizes[c] or 0)] if c in sizes else [F.col(c)]
    df.select(*out).write.mode("overwrite").option("sep", delimiter).option("header", header).csv(path)


def whole(points: DataFrame) -> DataFrame:
    return points.where(~F.exists("x", lambda v: v.isNull()))


def score_run(points: DataFrame, options: forest.Options) -> DataFrame:
    """seq, x and anomaly_score by a model of all the points."""
    rows = whole(points)
    return forest.scores(rows, forest.train(rows, options), keep=["seq", "x"]).withColumnRenamed("score", "anomaly_score")


def attribution_run(points: DataFrame, options: forest.Options) -> DataFrame:
    rows = whole(points)
    return forest.attributions(rows, forest.train(rows, options), keep=["seq", "x"]).select("seq", "x", F.col("low").alias("anomaly_low"), F.col("high").alias("anomaly_high"))


def density_run(points: DataFrame, options: forest.Options) -> DataFrame:
    rows = whole(points)
    return forest.densities(rows, forest.train(rows, options), keep=["seq", "x"]).select("seq", "x", F.col("prob_up").alias("prob_mass_up"), F.col("prob_down").alias("prob_mass_down"))


def impute_run(points: DataFrame, options: forest.Options) -> DataFrame:
    """seq and x with null cells filled by a model of the rows without any."""
    model = forest.train(whole(points), options)
    holed = points.withColumn("z", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))))

    def fill(f, q):
        import numpy as np

        return {"filled": f.impute_many(np.nan_to_num(q), np.isnan(q))}

    return forest.query(holed, model, fill, "filled array<double>", x="z", keep=["seq"]).select("seq", F.col("filled").alias("x"))


def update_run(points: DataFrame, options: forest.Options, path: str) -> None:
    """Train only; the model is left at path."""
    forest.save(forest.train(whole(points), options), path)


def sequential(points: DataFrame, options: forest.Options, run: str) -> DataFrame:
    """A run in which each row is answered by the model of the rows before it, in the order of seq, and then learned.

    score, attribution, density and impute give the columns of the runs above; answers are 0 until options.output_after
    rows have been learned, and holes are filled with 0 until then. Rows with holes are never learned; the runs other than
    impute leave them out. This order admits one model only: one task reads the sorted rows as a stream, so its memory
    is that of the model, but its time grows with the rows. The runs above are the form for large inputs.
    """
    if run not in RUNS:
        raise ValueError(f"unknown run {run}")
    kinds = {"score": "anomaly_score double", "attribution": "anomaly_low array<double>, anomaly_high array<double>", "density": "prob_mass_up array<double>, prob_mass_down array<double>"}
    schema = "seq long, x array<double>" + (", " + kinds[run] if run in kinds else "")

    def work(parts):
        import numpy as np
        import pandas as pd

        from ..streaming.online import OnlineForest

        model = None
        for part in parts:
            out = []
            for seq, row in zip(part["seq"], part["x"], strict=True):
                x = np.array([np.nan if v is None else v for v in row], float)
                if model is None:
                    model = OnlineForest(len(x), options.trees, options.sample_size, options.decay, options.seed, options.output_after)
                gone = np.isnan(x)
                x = np.nan_to_num(x)
                live = model.forest() if model.ready and run != "score" else None
                if run == "score":
                    found = (model.score(x),)
                elif run == "attribution":
                    found = tuple(v[0] for v in reversed(live.attribution(x))) if live else (np.zeros(len(x)),) * 2
                elif run == "density":
                    found = tuple(live.density(x)["prob"][0].T) if live else (np.zeros(len(x)),) * 2
                else:
                    x, found = (live.impute(x, gone[None]) if live and gone.any() else x), ()
                out.append((seq, x, *found))
                if not gone.any():
                    model.update(x)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    rows = (points.where("x is not null") if run == "impute" else whole(points)).select(F.col("seq").cast("long").alias("seq"), F.col("x").cast("array<double>").alias("x"))
    return rows.repartition(1).sortWithinPartitions("seq").mapInPandas(work, schema)


RUNS = {"score": score_run, "attribution": attribution_run, "density": density_run, "impute": impute_run}
