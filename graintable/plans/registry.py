"""All registered queries of the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graintable.plans import base, cleaning, extraction, flows, modelling, relational, statistics  # noqa: F401  (they register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
