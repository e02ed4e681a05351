"""Long texts count too."""

from graintable.plans import registry

DATA = "/root/testdata/sf0.001"


def test_long_texts_are_rebuilt(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert docs.where("n_chars >= 3000").count()
    assert registry.queries()["tx10_reconstruct_whole_text"](spark, DATA).count() == docs.count()
