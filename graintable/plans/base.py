"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parents[2])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; without SQL, tests hold it to a plain computation."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:  # Python workers find this package where the driver has it
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
