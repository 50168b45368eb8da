"""Central sentences against a dense walk, and summaries of the tables."""

import numpy as np
import pytest

from findling.operators import segmentation, summary
from findling.sources import documents as src

DOC = "doc_id bigint, lang string, text string"


def dense_walk(rows, damping=0.85):
    """The limit as the solution of the linear equations of the written-out graph."""
    n = len(rows)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, size, out=np.zeros(rows.shape), where=size > 0)
    edges = unit @ unit.T
    np.fill_diagonal(edges, 0)
    edges[edges < 1e-12] = 0
    total = edges.sum(axis=1, keepdims=True)
    step = np.where(total > 0, np.divide(edges, total, out=np.zeros_like(edges), where=total > 0), 1 / n)
    return np.linalg.solve(np.eye(n) - damping * step.T, np.full(n, (1 - damping) / n))


@pytest.mark.parametrize("seed", range(20))
def test_shares_equal_the_dense_walk(seed):
    rnd = np.random.Generator(np.random.PCG64(seed))
    rows = rnd.integers(0, 3, (int(rnd.integers(1, 30)), 6)).astype(np.float32)
    rows[rnd.random(len(rows)) < 0.2] = 0
    got = summary.centrality(rows)
    assert got == pytest.approx(dense_walk(rows.astype(float)), abs=1e-8) and got.sum() == pytest.approx(1)


def test_the_bound_on_steps_holds():
    rnd = np.random.Generator(np.random.PCG64(9))
    rows = rnd.random((40, 5)) * (rnd.random((40, 5)) < 0.3)
    limit = dense_walk(rows)
    for tolerance in (0.1, 0.01, 1e-4, 1e-7):
        assert np.abs(summary.centrality(rows, tolerance=tolerance) - limit).sum() <= tolerance
    assert summary.steps_for(0.1) < summary.steps_for(1e-9) < 150


def test_the_sentence_that_shares_most_words_comes_first(spark):
    text = "Rivers carry stone. Stone and sand fill rivers slowly. Cats sleep. Sand and stone and rivers. Cats sleep."
    rows = [(1, "en", text), (2, "en", None), (3, "en", ""), (4, None, "one only"), (5, "en", "!!! ... ???\n?!")]
    got = {}
    for r in summary.extractive_summary(spark.createDataFrame(rows, DOC), "doc_id", most=2).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_no, r.text))
    assert got[1] == [(1, "Stone and sand fill rivers slowly."), (3, "Sand and stone and rivers.")]
    assert got[4] == [(0, "one only")] and set(got) == {1, 4, 5}
    three = summary.extractive_summary(spark.createDataFrame(rows[:1], DOC), "doc_id", most=9).collect()
    assert [r.sentence_no for r in three] == [0, 1, 2, 3]  # what is said twice is taken once


def test_documents_of_the_table(spark):
    docs = src.scan_documents(spark, "/root/testdata/sf0.001")
    rows = summary.extractive_summary(docs, "doc_id", "tenant_id").collect()
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    by = {}
    for r in rows:
        assert r.text in texts[r.doc_id] and 0 < r.share <= 1
        by.setdefault(r.doc_id, []).append(r.sentence_no)
    assert all(p == sorted(p) and len(p) <= 3 for p in by.values())
    model = segmentation.hashed_words()
    longest = max(docs.collect(), key=lambda r: len(r.text))
    first = {}
    for place, tokens in enumerate(segmentation.sentences(longest.text)):
        first.setdefault(" ".join(tokens).lower(), place)
    want = dict(zip(first.values(), dense_walk(model(list(first), longest.lang).astype(float))))
    share = {r.sentence_no: r.share for r in rows if r.doc_id == longest.doc_id}
    assert share and all(want[p] == pytest.approx(s, abs=2e-6) for p, s in share.items())


@pytest.mark.parametrize("n", [1, 2, 30, summary.SQUARED, 100])
def test_a_walk_ends_when_it_has_arrived(monkeypatch, n):
    """Ten million allowed steps are not taken one by one."""
    monkeypatch.setattr(summary, "steps_for", lambda *_: 10**7)
    rnd = np.random.Generator(np.random.PCG64(n))
    rows = rnd.integers(0, 3, (n, 9)) * (rnd.random((n, 9)) < 0.4)
    rows[rnd.random(n) < 0.1] = 0
    assert summary.centrality(rows.astype(np.float32)) == pytest.approx(dense_walk(rows.astype(float)), abs=1e-8)
