"""The FM-index and decontamination against plain Python."""

import os
import random
import subprocess
import sys

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findling.llm import decontamination as dc
from findling.llm import fm_index
from findling.llm.common import flat_texts

DOC = "doc_id bigint, text string, lang string"


def make(seed: int, n: int, vocabulary: str = "a b c dé E f1 gg") -> str:
    return " ".join(random.Random(seed).choices(vocabulary.split(), k=n))


@pytest.mark.parametrize("n,alphabet", [(1, 1), (2, 1), (9, 1), (200, 1), (300, 2), (500, 5), (700, 300)])
def test_suffix_array(n, alphabet):
    symbols = np.random.Generator(np.random.PCG64(n)).integers(0, alphabet, n)
    got = fm_index.suffix_array(symbols.astype(np.int64), alphabet)
    assert got.tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())


def test_wavelet_ranks():
    symbols = np.random.Generator(np.random.PCG64(3)).integers(0, 37, 900)
    matrix = fm_index.WaveletMatrix(symbols, 6)
    at = np.arange(900)
    for s in (0, 5, 36, 37):
        want = np.concatenate([[0], np.cumsum(symbols == s)])
        assert matrix.rank(np.full(901, s), np.arange(901)).tolist() == want.tolist()
    got, before = matrix.get(at)
    assert got.tolist() == symbols.tolist()
    assert before.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(900)]


def test_search_and_locate():
    rnd = np.random.Generator(np.random.PCG64(4))
    symbols = np.concatenate([[0], rnd.integers(1, 4, 400)])  # begins with a separator
    index = fm_index.FMIndex(symbols, 4)
    phrases = [rnd.integers(1, 4, k).tolist() for k in (1, 2, 3, 5, 8) for _ in range(20)]
    width = 8
    rows = np.array([[-9] * (width - len(p)) + p for p in phrases])
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(symbols)) if symbols[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.fixture(scope="module")
def tables(spark):
    passage, short = make(1, 35, "q w e r t y u i o p l k j h"), "x y z"
    items = [(1, passage), (20, short), (3, None), (4, "  ,, "), (5, passage + " more"), (5, passage),
             (None, make(9, 12)), (6, "Été ÉTÉ")]
    texts = [None, "", "...", passage, passage.upper(), "lead " + passage + " tail " + passage,
             " ".join(passage.split()[5:15]), " ".join(passage.split()[5:14]), "x, y-z", "x y zz", "xyz x y",
             "Été ÉTÉ", "été ÉTÉ", make(9, 12), make(7, 6000), (passage + "\n") * 30, "x y", "z"]
    texts += [passage] * 5 + [make(1, 9, "q w e r t y u i o p l k j h")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOC)
    return docs, spark.createDataFrame(items, "item_id bigint, text string"), items


def check(got, docs, items):
    known = plain.windows(items)
    got = {r.doc_id: r for r in got.collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n, hit, names = plain.contamination(r.text, known)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(names), hit > 0), r.doc_id
        assert g.items_sha256 == plain.sha(",".join(names))
    return {i for i, g in got.items() if g.contaminated}


def test_hits_equal_brute_force(tables):
    docs, benchmark, items = tables
    assert len(check(dc.report(docs, benchmark), docs, items)) > 8


def test_small_shards_and_many_blocks(tables, monkeypatch):
    docs, benchmark, items = tables
    monkeypatch.setattr(dc, "BLOCK_BYTES", 60)
    monkeypatch.setattr(dc, "SHARD_BYTES", 100)
    check(dc.report(docs, benchmark), docs, items)


def test_blocks_keep_rows_without_or_with_the_same_id(spark, tables, monkeypatch):
    docs, benchmark, items = tables
    passage = items[0][1]
    texts = [(None, passage), (None, "x y z"), (None, "clean"), (None, "clean"), (7, passage), (7, "clean"),
             (7, passage + " x y z"), (7, None)]
    same = spark.createDataFrame([(i, t, "en") for i, t in texts], DOC)
    known = plain.windows(items)
    want = []
    for i, t in texts:
        n, hit, names = plain.contamination(t, known)
        want.append((i, n, hit, len(names), plain.sha(",".join(names)), hit > 0))
    for size in (dc.BLOCK_BYTES, 60):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = [tuple(r) for r in dc.report(same, benchmark).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), size


def test_occurrences_located_a_few_at_a_time(tables, monkeypatch):
    docs, _, items = tables
    phrases = dc.make_phrases(*map(list, zip(*[(i, t or "") for i, t in items])))
    flat, offsets = flat_texts(pa.array([r.text for r in docs.collect()]))
    whole = dc.shard_hits(flat, offsets, phrases)
    monkeypatch.setattr(dc, "LOCATE_AT_ONCE", 7)
    few = dc.shard_hits(flat, offsets, phrases)
    assert (whole.spans, whole.items) == (few.spans, few.items) and sum(map(len, few.spans)) > 10


def test_clean_and_cut(tables):
    docs, benchmark, items = tables
    odd = docs.withColumn("spans", F.lit("s")).withColumn("items", F.array(F.lit(1)))
    known = plain.windows(items)
    dirty = {r.doc_id for r in docs.collect() if plain.contamination(r.text, known)[1]}
    clean = dc.clean_documents(odd, benchmark)
    assert clean.columns == odd.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - dirty
    cut = {r.doc_id: r.text for r in dc.cut_spans(odd, benchmark).collect()}
    assert cut[5] == "lead   tail  "
    assert cut[3].strip() == ""
    assert all(cut[r.doc_id] == r.text for r in docs.collect() if r.doc_id not in dirty)


def test_cut_does_not_depend_on_blocks(spark, monkeypatch):
    long = make(1, 40, "q w e r t y u i o p l k j h").split()
    items = [(k, " ".join(long[at : at + 10])) for k, at in enumerate((0, 4, 12, 18, 30))]
    across = " ".join(long[25:30] + long[35:40])  # stands together only once a span between is cut
    items.append((9, across))
    texts = [" ".join(long), " ".join(long[25:30] + long[0:10] + long[35:40]), across, "a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = ["  " + " ".join(long[28:30]) + "  ", " ".join(long[25:30]) + "   " + " ".join(long[35:40]), " ",
            "a b", None]
    for size in (dc.BLOCK_BYTES, 60, 25):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = {r.doc_id: r.text for r in dc.cut_spans(docs, benchmark).collect()}
        assert [got[i] for i in range(len(texts))] == want, size


def test_repeated_words_stay_in_bounded_memory():
    """20,000 equal words against an item of 200 of them, in a process of its own."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from findling.llm import decontamination as dc
from findling.llm.common import flat_texts
phrases = dc.make_phrases([1, 2], [" ".join(["a"] * 200), " ".join(["a"] * 100)])
flat, offsets = flat_texts(pa.array([" ".join(["A"] * 20000), "a b"]))
hits = dc.shard_hits(flat, offsets, phrases)
assert hits.spans == [[(0, 20000)], []] and hits.items == [[1, 2], []]
assert len(phrases.rows) == 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=60,
                          env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


@pytest.mark.parametrize("size", [90, 400, 3000])
def test_a_text_longer_than_a_shard(tables, monkeypatch, size):
    docs, benchmark, items = tables
    known = plain.windows(items)
    text = "  ".join((r.text or "") + " " + make(k, 30) for k, r in enumerate(docs.collect())) + " x y z" * 3
    text += " giant" + "x" * 1000 + " " + items[0][1] + "."
    phrases = dc.make_phrases(*map(list, zip(*[(i, t or "") for i, t in items])))
    hits = dc.long_text_hits(np.frombuffer(text.encode(), np.uint8), lambda: [phrases], size)
    n, hit, names = plain.contamination(text, known)
    assert int(hits.n_words[0]) == n and sum(b - a for a, b in hits.spans[0]) == hit
    assert sorted(map(str, hits.items[0])) == sorted(names)
    whole = dc.shard_hits(*flat_texts(pa.array([text])), phrases)
    assert hits.spans[0] == whole.spans[0] and hits.byte_spans[0] == whole.byte_spans[0]


def test_colliding_hashes(tables, monkeypatch):
    """With hashes of a few values only, words are still told apart."""
    docs, _, items = tables
    phrases = lambda: dc.make_phrases(*map(list, zip(*[(i, t or "") for i, t in items])))
    flat, offsets = flat_texts(pa.array([r.text for r in docs.collect()]))
    want = dc.shard_hits(flat, offsets, phrases())
    whole = dc.split_words

    def few(flat, offsets):
        words = whole(flat, offsets)
        words.code = words.code % np.uint64(5)
        return words

    monkeypatch.setattr(dc, "split_words", few)
    got = dc.shard_hits(flat, offsets, phrases())
    assert got.spans == want.spans and list(map(sorted, got.items)) == list(map(sorted, want.items))


def test_empty_tables(spark, tables):
    docs, benchmark, _ = tables
    assert dc.report(docs.limit(0), benchmark).collect() == []
    got = dc.report(docs, benchmark.limit(0)).collect()
    assert not any(r.contaminated or r.n_items for r in got)
    assert {r.items_sha256 for r in got} == {plain.sha("")}
    assert dc.clean_documents(docs, benchmark.limit(0)).count() == docs.count()
