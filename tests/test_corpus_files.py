"""Texts as files, written and read back whole."""

from graintable.sources import files as S


def test_whole_texts_come_back_from_a_corpus(spark, tmp_path):
    texts = {1: "two\nlines", 2: "", 3: "ends with two\n\n", 4: "a\r\nb\rc\u2028d\x85e", 5: "\n", 6: "word " * 50_000, 7: "é 漢字"}
    S.write_corpus(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), f"{tmp_path}/c", "doc_id", "text")
    got = S.read_corpus(spark, f"{tmp_path}/c", "doc_id=([^/]+)/", ended=True).collect()
    assert sorted((int(r.stem), r.text) for r in got) == sorted(texts.items())


def test_corpus_by_file_name(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("one\ntwo\n")
    assert [tuple(r) for r in S.read_corpus(spark, str(tmp_path)).collect()] == [("a.b", "one\ntwo\n")]
