"""Coherent chunks against all ways to cut, and against fixed windows on joined documents."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.operators import ingest, segmentation
from findling.sources import documents as src

FOLDER = "/root/testdata/sf0.001"
DOC = "tenant_id string, doc_id bigint, lang string, text string"


def all_ways(sizes, least, most):
    n = len(sizes)
    for k in range(n):
        for inner in itertools.combinations(range(1, n), k):
            cuts = [0, *inner]
            lengths = [sum(sizes[a:b]) for a, b in zip(cuts, [*inner, n])]
            if all(x <= most for x in lengths) and all(x >= least for x in lengths[:-1]):
                yield cuts


@pytest.mark.parametrize("seed", range(40))
def test_no_other_way_costs_less(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 12)
    sizes = [rnd.randrange(1, 6) for _ in range(n)]
    costs = np.array([rnd.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(n - 1)])
    least, most = rnd.randrange(1, 6), rnd.randrange(10, 16)
    price = lambda cuts: sum(costs[c - 1] for c in cuts[1:])
    ways = list(all_ways(sizes, least, most))
    got = segmentation.best_cuts(np.array(sizes), costs, least, most)
    assert got in ways
    assert price(got) == pytest.approx(min(map(price, ways)))


def test_sentences():
    cut = segmentation.sentences("One two. Three\nfour  five! six\n\n \n" + "w " * 7, 3)
    assert [len(s) for s in cut] == [2, 1, 2, 1, 3, 3, 1]
    assert segmentation.sentences("") == segmentation.sentences(" \n") == []


@pytest.mark.parametrize("at_once", [1, 3, 2048])
def test_similarities_do_not_depend_on_blocks(monkeypatch, at_once):
    rnd = random.Random(7)
    tokens = [rnd.choices("aa bb cc dd ee ff".split(), k=rnd.randrange(0, 6)) for _ in range(40)]
    model = segmentation.hashed_words()
    rows = model([" ".join(t) for t in tokens], "en").astype(float)
    monkeypatch.setattr(segmentation, "AT_ONCE", at_once)
    got = segmentation.gap_similarities(tokens, "en", model, beside=3)
    for g in range(39):
        a, b = rows[max(g - 2, 0) : g + 1].sum(axis=0), rows[g + 1 : g + 4].sum(axis=0)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        assert got[g] == pytest.approx(a @ b / size if size else 0.0)


def test_chunks_cover_the_text(spark):
    docs = src.scan_documents(spark, FOLDER)
    odd = docs.limit(1).select(*[F.lit(None).cast(t).alias(n) if n == "text" else F.col(n) for n, t in docs.dtypes])
    docs = docs.unionByName(odd.withColumn("doc_id", F.lit(-1).cast("bigint")))
    chunks = segmentation.chunk_coherent(docs, 60, 0.1, 20)
    rows = chunks.orderBy("doc_id", F.length("chunk_id"), "chunk_id").collect()
    texts = {r.doc_id: " ".join((r.text or "").split()) for r in docs.collect()}
    own = {}
    for r in rows:
        assert r.n_tokens <= 60 and len(r.text.split()) == r.n_tokens
        before = own.setdefault(r.doc_id, [])
        assert r.start_tok <= len(before)
        before += r.text.split()[len(before) - r.start_tok :]
    assert {i: " ".join(t) for i, t in own.items()} == {i: t for i, t in texts.items() if t}
    fixed = ingest.chunk_fixed(docs, 60).agg(F.max("last_page")).first()[0]
    assert max(r.last_page for r in rows) == fixed


def topical(seed, n_topics, per_topic):
    """Text of several topics, and the tokens at which they change."""
    rnd, parts, marks, at = random.Random(seed), [], [], 0
    for topic in range(n_topics):
        words = [f"w{topic}x{k}" for k in range(30)] + ["the", "of", "common", "thing"] * 3
        for _ in range(rnd.randrange(*per_topic)):
            own = rnd.choices(words, k=rnd.randrange(6, 18))
            at += len(own)
            parts.append(" ".join(own) + ".")
        marks.append(at)
    return " ".join(parts), marks[:-1]


def test_cuts_fall_between_topics_where_fixed_ones_do_not(spark):
    made = [topical(seed, 5, (8, 24)) for seed in range(30)]
    docs = spark.createDataFrame([("t", i, "en", text) for i, (text, _) in enumerate(made)], DOC)
    found, missed = {}, {}
    for name, chunks in (
        ("coherent", segmentation.chunk_coherent(docs, 400, 0.0, 60)),
        ("fixed", ingest.chunk_fixed(docs, 200, 0.0)),
    ):
        starts = {}
        for r in chunks.select("doc_id", "start_tok").collect():
            starts.setdefault(r.doc_id, set()).add(r.start_tok)
        near = [any(abs(s - m) <= 12 for s in starts[i]) for i, (_, marks) in enumerate(made) for m in marks]
        extra = [all(abs(s - m) > 12 for m in [0, *made[i][1]]) for i in starts for s in starts[i]]
        found[name], missed[name] = np.mean(near), np.mean(extra)
    assert found["coherent"] > 0.85 and found["fixed"] < 0.4
    assert missed["coherent"] < missed["fixed"] / 2


def test_joined_documents_are_cut_where_they_meet(spark):
    """Texts of the table, joined two by two in one language and cut again."""
    rows = [r for r in src.scan_documents(spark, FOLDER).filter("lang = 'en'").collect() if 120 < len(r.text.split()) < 700]
    pairs = list(zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame(
        [("t", i, "en", a.text + "\n" + b.text) for i, (a, b) in enumerate(pairs)], DOC)
    off = {}
    for name, chunks in (("coherent", segmentation.chunk_coherent(docs, 500, 0.0)), ("fixed", ingest.chunk_fixed(docs, 300, 0.0))):
        starts = {}
        for r in chunks.select("doc_id", "start_tok").collect():
            starts.setdefault(r.doc_id, []).append(r.start_tok)
        off[name] = np.mean([min(abs(s - len(a.text.split())) for s in starts[i]) for i, (a, _) in enumerate(pairs)])
    assert len(pairs) > 10 and off["coherent"] < off["fixed"]


def test_bounds_are_checked(spark):
    docs = spark.createDataFrame([("t", 1, "en", "a b")], DOC)
    with pytest.raises(ValueError, match="least"):
        segmentation.chunk_coherent(docs, 100, 0.1, 95)
    assert segmentation.chunk_coherent(docs.limit(0)).count() == 0
