"""Rows that begin with a word, against the SQL's pattern."""

import duckdb

from graintable.plans import registry

TEXTS = ["Le\u00ea\u00e9r\u00e9 la", "le\u00e7vi", "le chat", "lemon", "le_x", "Le", " \t\nThe end", "\rthe end", "the\n", "der9", "d\u00c9r", "", None, "\u00eale la"]


def test_prefixes_equal_sql_on_odd_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(r[0] for r in con.execute(registry.oracle_sql()["mp14_drop_by_prefix"]).fetchall())
    assert sorted(r.doc_id for r in registry.queries()["mp14_drop_by_prefix"](spark, str(tmp_path)).collect()) == want
