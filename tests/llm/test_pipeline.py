"""The pipeline's stages against plain computations on the smallest tables."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from graintable.llm import decontaminate, line_dedup, pieces, toxicity
from tests.llm.test_operators import brute_tree, plain_components, plain_cover, plain_fingerprint, plain_viterbi

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seen(spark, tmp_path_factory):
    """What each stage was given and what it left."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == before.columns
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxicity_stage(spark, seen):
    before, after = map(texts, seen["toxicity"])
    model = toxicity.fit_toxicity(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert after == {i: t for i, t in before.items() if model.probability(model.features(t)[0]) < 0.5}


def test_line_dedup_stage(seen):
    """Against a plain template tree; a document without any text left goes."""
    frame, left = seen["line_dedup"]
    before, after = texts(frame), texts(left)
    found = line_dedup.template_lines(frame, "doc_id", "text", 3)
    at = {(r._id, r.pos): (r.masked, r.leaf, r.k1, r.k2) for r in found.collect()}
    docs_of, lines = {}, {}
    for (i, _), (m, *_) in at.items():
        docs_of.setdefault(m, set()).add(i)
    for m, leaf, k1, k2 in at.values():
        lines[m] = (leaf, len(docs_of[m]), k1, k2)
    of, groups = brute_tree(lines), {}
    for m, ids in docs_of.items():
        groups.setdefault(of[m], set()).update(ids)
    want = {}
    for i, t in before.items():
        parts = (t or "").split("\n")
        kept = [x for p, x in enumerate(parts) if (i, p) not in at or len(groups[of[at[i, p][0]]]) < 2 or min(groups[of[at[i, p][0]]]) == i]
        if len(kept) == len(parts) or "".join(kept).strip():
            want[i] = "\n".join(kept)
    assert after == want
    assert {r.doc_id: r.n_chars for r in left.collect()} == {i: len(t) for i, t in after.items()}


def test_near_dedup_stage(seen):
    before, after = map(texts, seen["near_dedup"])
    fps = {i: plain_fingerprint(t) for i, t in before.items()}
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    assert set(after) == set(plain_components(ids, [(ids[i], ids[j]) for i, j in near]).values())


def test_decontamination_stage(spark, seen):
    before, after = map(texts, seen["decontamination"])
    items = [decontaminate.token_hashes(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def covers(text):
        t = decontaminate.token_hashes(text)
        return any(len(p) and np.isin(p, t).mean() >= 0.5 and plain_cover(p, t, min(5, len(p))) >= 0.5 * len(p) for p in items)

    assert after == {i: t for i, t in before.items() if not covers(t)}


def test_sentencepiece_stage(seen):
    before, after = seen["sentencepiece"]
    p = pieces.loaded(pieces.default_model())
    rows = {r.doc_id: r for r in after.collect()}
    for i, t in texts(before).items():
        ids = plain_viterbi(p, t)
        assert rows[i].n_pieces == len(ids) and rows[i].round_trip
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert len(rows) == before.count()


def test_run_equals_the_stages(spark, seen):
    rows = lambda df: sorted((r.doc_id, r.n_pieces, bytes(r.ids), r.ids_crc32, r.round_trip) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(seen["sentencepiece"][1])
    assert corpus_pipeline.ORACLE_SQL is None
