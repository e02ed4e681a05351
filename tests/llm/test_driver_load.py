"""What the driver holds and starts: no texts of the training sample, no round of components that changes nothing."""

from __future__ import annotations

import os

import pytest

from graintable.llm import components, toxicity


def test_toxicity_is_fit_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "you utter idiot" if i % 2 else "a fine day") for i in range(200)], "doc_id long, text string")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    rows = [(r.text, r.doc_id % 2) for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").collect()]
    want = toxicity.fit(sorted(rows))

    def elsewhere(rows, fit=toxicity.fit, driver=os.getpid()):
        assert os.getpid() != driver, "the driver fits the model"
        return fit(rows)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    found = toxicity.fit_toxicity(docs, labels)
    assert found.stems == want.stems and found.stems
    assert found.weights[:-1].tolist() == want.weights[:-1].tolist()


def test_toxicity_without_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert not model.stems and model.probability([0.0, 0.0, 0.0]) < 1e-5


@pytest.mark.parametrize(("links", "rounds"), [
    ([(5, 1), (7, 1), (1, 9), (4, 2), (2, 4)], 0),  # stars around the least
    ([], 0),
    ([(2, 1), (3, 2)], 1),
    ([(1, 9), (2, 9), (3, 9)], 1),  # a star around the greatest
    ([(3, 1), (3, 2), (8, 2), (8, 6), (5, 5)], 2),
])
def test_no_round_once_all_are_stars(spark, monkeypatch, links, rounds):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, tag, write=components.materialize: written.append(tag) or write(df, tag))
    found = components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()
    root = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in root:
        for u, v in links:
            if u in root:
                root[u] = root[v] = min(root[u], root[v])
    assert sorted((r.vertex, r.root) for r in found) == sorted(root.items())
    assert len(written) == 1 + rounds
