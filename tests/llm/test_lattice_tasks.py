"""Tasks of the piece lattice hold a bounded number of units, and its table of pieces starts no Python workers."""

import re

from graintable.llm import pieces as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lattice_tasks_grow_in_number_not_in_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    letters = str.maketrans("0123456789abcdef", "aeiounrtslmdcpbg")
    texts = [" ".join(f"{i * 7919:x}".translate(letters) for i in range(k, k + 1000)) for k in range(0, 90_000, 1000)]
    units = len(set(P.loaded(P.default_model()).cuts.cut(texts)[0].to_pylist()))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        found = P.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frequent=1, check=True)
        sizes = [int(x) for x in re.findall(r"hashpartitioning\(key#\d+, group#\d+L?, (\d+)\)", plan(found))]
        assert units > 51_000 and sizes and min(sizes) * 25_000 >= units - 1  # one is known beforehand
        assert found.where("not round_trip").count() == 0 and found.count() == 90
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pieces_are_a_local_table(spark):
    words = spark.range(3).selectExpr("concat('ab', id) as word").selectExpr("word as key", "0L as group", "word", "array(named_struct('block', 0L, 'number', 0)) as places")
    edges = P.unit_lattice(words, P.loaded(P.default_model()), True)
    assert "ExistingRDD" not in plan(edges) and edges.count() == 3
