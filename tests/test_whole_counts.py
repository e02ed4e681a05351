"""Counts cover the whole table."""

import pytest
from pyspark.sql import functions as F

from graintable.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("query", "name"), [("ag9_counts_of_all_orders", "orders"), ("ag23_fold_rare_parts", "lineitem")])
def test_counts_cover_the_table(spark, query, name):
    got = registry.queries()[query](spark, DATA)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/{name}.parquet").count()
    assert got.where("n = 0" if name == "orders" else "class = 'other'").count()
