"""The library's queries by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, series_queries, table_queries

MODULES = (series_queries, table_queries, model_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding scored against a forest trained on a time-decayed sample of the table."""
    return QUERIES["anomaly_score"](spark, sf_dir)
