"""spark-submit grovecast/cli.py RUN INPUT OUTPUT [options]: score, attribute, density, impute or update over delimited text."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grovecast", description=__doc__)
    p.add_argument("run", choices=["score", "attribution", "density", "impute", "update"])
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-n", "--number-of-trees", type=int, default=100)
    p.add_argument("-s", "--sample-size", type=int, default=256)
    p.add_argument("-w", "--window-size", type=int, default=0, help="rows after which a point's weight has fallen by a factor e; 0 for no decay")
    p.add_argument("-g", "--shingle-size", type=int, default=1)
    p.add_argument("-c", "--shingle-cyclic", action="store_true")
    p.add_argument("-d", "--delimiter", default=",")
    p.add_argument("--header-row", action="store_true")
    p.add_argument("--random-seed", type=int, default=42)
    p.add_argument("--missing-value-marker", default="NA")
    p.add_argument("--sequential", action="store_true", help="answer each row by the model of the rows before it, in one task, instead of training on all rows first")
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from grovecast.operators import framing
    from grovecast.operators.forest import Options
    from grovecast.sources import delimited

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("grovecast").getOrCreate()
    options = Options(a.number_of_trees, a.sample_size, 1.0 / a.window_size if a.window_size else 0.0, a.random_seed)
    points = delimited.read_points(spark, a.input, a.delimiter, a.header_row, a.missing_value_marker)
    if a.shingle_size > 1:
        points = framing.shingle_blocks(points, a.shingle_size, rotate=a.shingle_cyclic).select("seq", F.col("shingle").alias("x"))
    if a.run == "update":
        delimited.update_run(points, options, a.output)
    else:
        run = delimited.sequential(points, options, a.run) if a.sequential else delimited.RUNS[a.run](points, options)
        delimited.write_rows(run, a.output, a.delimiter, a.header_row)


if __name__ == "__main__":
    main()
