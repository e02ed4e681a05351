"""Whole texts in files that hold many."""

import glob

from graintable.plans import registry
from graintable.sources import files as S

TEXTS = sorted([(1, "a/b", "two\nlines"), (2, "a/b", ""), (3, None, None), (4, "c=d", "a\r\nb\rc\u2028d\x85e\x00\x01\\n\"{}"), (5, "", "\n"), (6, "7", "word " * 50_000), (8, "__", "x"), (9, "__HIVE_DEFAULT_PARTITION__", "y"), (7, "007", "\u00e9 \u6f22\u5b57 \U0001f600")], key=lambda t: t[0])


def test_texts_come_back_from_packs(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "doc_id long, source string, text string")
    S.write_packs(df, f"{tmp_path}/c", "doc_id", "text")
    assert sorted((int(r.stem), r.text) for r in S.read_packs(spark, f"{tmp_path}/c").collect()) == [(k, t) for k, _, t in TEXTS]
    S.write_packs(df, f"{tmp_path}/f", "doc_id", "text", "source")
    assert sorted((int(r.stem), r.source, r.text) for r in S.read_packs(spark, f"{tmp_path}/f", "source").collect()) == TEXTS


def test_files_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """The queries write as many files as tasks and sources, not one a document."""
    for name in ("src7_corpus", "src7_corpus_texts"):
        monkeypatch.setattr(S, "work_path", lambda spark, tag, name=name: f"{tmp_path}/{name}")
        registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert 0 < len(glob.glob(f"{tmp_path}/{name}/**/part-*", recursive=True)) <= 20
