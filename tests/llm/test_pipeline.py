"""The pipeline, stage by stage, against plain Python over what the stage before kept."""

import random

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findling.session import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Raw documents with cases planted, and what each stage makes of them."""
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    passage = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    texts = {r.doc_id: r.text for r in raw.collect()}
    rnd = random.Random(1)
    long = max(texts.values(), key=len)
    planted = [(5000 + k, texts[k], "en", "src0", 1) for k in range(8)]  # exact copies
    for k in range(12):  # near copies, one word of some thousands changed
        words = long.split()
        words[rnd.randrange(len(words))] = f"changed{k}"
        planted.append((6000 + k, " ".join(words), "en", "src1", 1))
    planted += [(7000, texts[3] + " " + passage, "en", "src2", 1), (7001, passage.upper(), "en", None, 1)]
    planted += [(8000, "12 34 !!", None, "src3", 1), (8001, None, None, None, None), (8002, "", "en", "src3", 0)]
    docs = raw.unionByName(spark.createDataFrame(planted, raw.schema)).withColumn("score", F.lit(1))
    steps = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        steps.append((name, written(stage(spark, steps[-1][1], FOLDER), "stage")))
    return steps


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_and_columns(kept):
    assert [n for n, _ in kept[1:]] == [n for n, _ in corpus_pipeline.STAGES] and len(kept) == 6
    for _, df in kept[1:-1]:
        assert df.columns == kept[0][1].columns
    assert kept[-1][1].columns == [*kept[0][1].columns, "copy_no"]


def test_language_drops_what_has_no_letters_and_keeps_prose(kept):
    before, after = rows(kept[0][1]), rows(kept[1][1])
    assert {8000, 8001, 8002} & set(after) == set()
    assert len(after) >= 0.99 * (len(before) - 3)


def test_exact_copies(kept):
    before, after = rows(kept[1][1]), rows(kept[2][1])
    best = {}
    for i, r in before.items():
        best[r.text] = max(i, best.get(r.text, i))
    assert set(after) == set(best.values())
    assert {5000 + k for k in range(8)} <= set(after)


def test_near_copies(kept):
    before, after = rows(kept[2][1]), rows(kept[3][1])
    parts = plain.components({i: plain.fingerprint(r.text) for i, r in before.items()})
    assert set(after) == set(parts.values())
    assert not {6000 + k for k in range(12)} & set(after)


def test_contamination(spark, kept):
    before, after = rows(kept[3][1]), rows(kept[4][1])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    known = plain.windows(items)
    assert set(after) == {i for i, r in before.items() if not plain.contamination(r.text, known)[1]}
    assert {7000, 7001} & set(before) and not {7000, 7001} & set(after)


def test_mix(kept):
    before = rows(kept[4][1])
    sizes = {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(plain.SPACED.findall(r.text))
    targets = plain.targets(sizes)
    want = {}
    for i, r in before.items():
        n = plain.copies(i, r.text, targets[r.source] / sizes[r.source] if sizes[r.source] else 0)
        if n:
            want[i] = n
    got = {r.doc_id: r["count"] for r in kept[5][1].groupBy("doc_id").count().collect()}
    assert got == want


def test_run_is_the_stages_in_order(spark):
    one = corpus_pipeline.run(spark, FOLDER).select("doc_id", "copy_no").collect()
    two = corpus_pipeline.run(spark, FOLDER).select("doc_id", "copy_no").collect()
    assert sorted(one) == sorted(two) and len(one) > 100
