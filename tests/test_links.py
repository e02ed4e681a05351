"""Links over symbols of a text, counts in the same pass."""

from pyspark.sql import functions as F

from graintable.operators import extract as X
from graintable.sources import files as S


def links(spark, text, terms=(("salt", "salt"), ("sea salt", "sea salt"), ("oak wood", "oak"))):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    found = X.symbol_links(df, "k", "t", spark.createDataFrame(list(terms), "term string, name string"))
    return sorted((r.name, r.type, r.value, r.unit, r.form, r.score) for r in found.collect())


def test_the_longest_name_and_the_surest_form(spark):
    assert links(spark, "Then 2.5 g of fine sea salt was used") == [("sea salt", "mass", 2.5, "g", "quantity_of_name", 0.95)]
    assert links(spark, "5 M salt solution") == [("salt", "concentration", 5.0, "M", "concentration_name_solution", 0.95)]
    assert links(spark, "5 mL salt; 5 mL salt and 7 % Oak Wood (3 kg)") == [("oak", "fraction", 7.0, "%", "quantity_then_name", 0.9), ("oak", "mass", 3.0, "kg", "name_parenthesis_quantity", 0.95), ("salt", "volume", 5.0, "mL", "quantity_then_name", 0.9)]


def test_what_is_no_link(spark):
    for text in ("", None, "salt", "5 g", "5 g was salt", "5 g. Salt", "5 gallons of salt", "salt (about 5 g)", "5 g of salted nuts"):
        assert links(spark, text) == [], text
    assert links(spark, "5 g of salt", terms=(("x", "x"),)) == []


def test_long_texts(spark):
    got = links(spark, "we took 2 g of salt and left. " * 3_000)
    assert got == [("salt", "mass", 2.0, "g", "quantity_of_name", 0.95)]


def test_lines_are_counted_by_the_read_that_drops_them(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n\n{"k": 2\n{"k": 3, "x": [1]}\nnot json\n   \n{}\n')
    rows, seen = S.read_jsonl_counted(spark, str(tmp_path), "k long")
    assert sorted((r.k for r in rows.collect()), key=str) == [1, 3, None]
    assert seen.get["unparsable"] == 2 and seen.get["lines"] - seen.get["unparsable"] == 3
    df, counts = S.with_counts(spark.range(10), all=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.write.parquet(f"{tmp_path}/out")
    assert counts.get == {"all": 10, "even": 5}
