"""Learned operators: held-out accuracy, properties, and defined results for odd rows."""

import time
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from findling.llm import langid, lm_scoring, queries, secrets_forest, toxicity
from findling.llm.common import flat_texts, held_out

FOLDER = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string"
ODD = [(None, "the and of", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, "12 ... 34", "en", "a"),
       (4, "the", "en", None), (5, "été", "fr", "b"), (5, "été", "fr", "b"), (6, "x " * 60_000, "en", "c"),
       (7, "日本語のテキスト", "ja", "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("score", F.lit("mine")).withColumn("accepted", F.lit(3))


def test_language_on_the_held_out_fold(spark, docs):
    got = queries.op2_language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    fold = got[got["held_out"]]
    assert len(fold) > 250 and (fold["lang"] == fold["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    assert got["accepted"].mean() > 0.995


def test_language_learns_from_the_other_folds_only(docs):
    model = langid.fit(docs)
    changed = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    again = langid.fit(changed)
    assert model.languages == again.languages
    assert np.allclose(model.centroids, again.centroids)


def test_language_of_odd_rows(odd):
    model = langid.fit(odd)
    got = {}
    for r in langid.identify(odd.select("doc_id", "text"), model, "doc_id").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[5]) == 2
    for i in (1, 2, 3):
        assert (got[i][0].lang_pred, got[i][0].score, got[i][0].accepted) == ("und", 0.0, False)
    assert all(got[i][0].lang_pred in model.languages for i in (None, 4, 5, 6, 7))
    kept = langid.accepted_documents(odd)
    assert kept.columns == odd.columns
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_language_without_anything_to_learn_from(odd):
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    got = langid.identify(blank.select("doc_id", "text"), langid.fit(blank), "doc_id").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert {r.doc_id for r in got if not r.accepted} == {1, 2, 3}


def test_language_rejects_what_is_like_nothing_learned(spark, docs):
    rows = [(10_000 + k, "zqxj wvkq jjxq " * 50, "en", "s", 5) for k in range(3)]
    junk = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    model = langid.fit(docs)
    assert not any(r.accepted for r in langid.identify(junk, model, "doc_id").collect())


def test_toxicity_on_the_held_out_fold(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = queries.op5_toxicity(spark, FOLDER).join(labels, "doc_id").toPandas()
    fold = got[got["held_out"]]
    assert ((fold["score"] >= 0.7) == (fold["predicted"] == 1)).all()
    assert (fold["predicted"] == fold["toxic"]).mean() > 0.9
    assert fold[fold["toxic"] == 0]["predicted"].mean() < 0.02
    assert fold[fold["toxic"] == 1]["score"].median() > fold[fold["toxic"] == 0]["score"].max() / 2


def test_toxicity_learns_from_the_other_folds_only(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.allclose(one.weights, two.weights) and math.isclose(one.bias, two.bias)


def test_toxicity_of_odd_rows(spark, odd):
    bad = [(k, "you stupid thing " * (k % 3 + 1) if k % 2 else "a kind thing", "en", "s") for k in range(60)]
    train = spark.createDataFrame(bad, DOC)
    rows = [(k, k % 2) for k in range(60)] + [(1, None), (None, 1), (3, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    model = toxicity.fit(train, labels)
    got = toxicity.score(odd.select("doc_id", "text"), model, "doc_id").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(empty) == 1
    none = toxicity.fit(train, labels.filter("toxic = 2"))
    assert {r.score for r in toxicity.score(odd, none, "doc_id").collect()} == {1 / (1 + math.exp(500))}


def test_ratio_of_known_counts():
    ratios = toxicity.log_count_ratios(np.array([[9, 0], [0, 9], [4, 4]]))
    assert math.isclose(ratios[0], math.log(10)) and math.isclose(ratios[1], -math.log(10)) and ratios[2] == 0


def by_hand(text, lexicon, network):
    """Score of one text word by word."""
    flat, offsets = flat_texts(pa.array([text]))
    words = lm_scoring.split_words(flat, offsets)
    classes, inside = lm_scoring.classify(words, lexicon)
    total = 0.0
    for t in range(len(classes)):
        beside = []
        for step in (-2, -1, 1, 2):
            beside.append(int(classes[t + step]) if 0 <= t + step < len(classes) else 0)
        hidden = np.tanh(sum(network.embed[k * lm_scoring.CLASSES + c] for k, c in enumerate(beside)) + network.shift)
        scores = (hidden @ network.out + network.bias).astype(np.float64)
        total += scores[classes[t]] - math.log(np.exp(scores).sum()) + inside[t]
    return len(classes), total


def test_lm_scores(docs, odd):
    texts = docs.select("doc_id", "text")
    lexicon = lm_scoring.make_lexicon(lm_scoring.corpus_counts(texts))
    network = lm_scoring.train(texts, lexicon)
    some = texts.filter("doc_id BETWEEN 30 AND 55").union(odd.select("doc_id", "text"))
    got = {r.doc_id: r for r in lm_scoring.score(some, lexicon, network).collect()}
    for r in some.collect():
        if len(r.text or "") < 20_000:
            n, total = by_hand(r.text or "", lexicon, network)
            assert got[r.doc_id].n_words == n
            assert abs(got[r.doc_id].log_prob - total) < 1e-3 * max(1, n)
    assert got[1].log_prob == 0 and got[1].mean_log_prob is None

    def mean(texts, net):
        flat, offsets = flat_texts(pa.array(texts))
        words = lm_scoring.split_words(flat, offsets)
        classes, _ = lm_scoring.classify(words, lexicon)
        return net.log_probabilities(lm_scoring.windows(classes, words.first), classes).mean()

    held = [r.text for r in docs.filter("doc_id % 10 = 0").collect()]
    random.seed(2)
    shuffled = [" ".join(random.sample(t.split(), len(t.split()))) for t in held]
    assert mean(held, network) > mean(held, lm_scoring.Network()) + 0.5
    assert mean(held, network) > mean(shuffled, network)


def test_word_shares_sum_to_one(docs):
    lexicon = lm_scoring.make_lexicon(lm_scoring.corpus_counts(docs.select("text")))
    for c in range(1, lm_scoring.CLASSES):
        known = np.exp(lexicon.log_share[lexicon.classes == c]).sum()
        assert math.isclose(known + math.exp(lexicon.log_other[c]), 1, abs_tol=1e-6)
    assert np.allclose(np.exp(lexicon.log_bigram).sum(1), 1)


def test_secret_findings(spark, docs):
    found = secrets_forest.scan(docs, F.col("source")).toPandas()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(texts[d][a : a + len(v)] == v for d, a, v in zip(found["doc_id"], found["at"], found["value"]))
    import re

    n = sum(len(re.findall(secrets_forest.CANDIDATE, t)) for t in texts.values())
    assert len(found) == n
    hexes = found["value"].str.fullmatch("[0-9a-fA-F]{40}")
    assert hexes.sum() > 5 and found[hexes]["is_secret"].all()
    assert not found[found["value"].str.fullmatch("[0-9]+|[A-Za-z]+")]["is_secret"].any()


def test_short_unquoted_and_punctuated_secrets(spark):
    rnd = random.Random(4)

    def key(n, letters="abcdefghkmXYZ0123456789"):
        return "a1" + "".join(rnd.choices(letters, k=n - 2))

    forms = [('password = "{}"', lambda: "s3cr3t!" + key(5)), ("pwd={}", lambda: "hunter" + str(rnd.randrange(10))),
             ("API_KEY={}", lambda: key(24)), ("DATABASE_PASSWORD={}", lambda: key(8)),
             ("Authorization: Bearer {}", lambda: key(12) + "." + key(9)), ("see {} in prose",
             lambda: "AKIA" + "".join(rnd.choices("ABCDEFGH0123456789", k=16))), ("/api/v1/users/password: '{}'.",
             lambda: "p w;" + key(5)), ("\n{}\n", lambda: "-----BEGIN RSA PRIVATE KEY-----")]
    rows, want = [], {}
    for k in range(400):
        form, made = forms[k % len(forms)]
        value = made()
        text = f"été {form.format(value)}, the end plainwordplainword{'ab'[k % 2] * 3}"
        rows.append((k, text, "en", None))
        want[k] = (text.index(value), value)
    found = secrets_forest.scan(spark.createDataFrame(rows, DOC), F.col("source")).toPandas()
    got = {(r.doc_id, r.at, r.value): r.is_secret for r in found.itertuples()}
    for k, (at, value) in want.items():
        assert got.get((k, at, value)), rows[k]
    assert not found[found["value"].str.startswith("plainword")]["is_secret"].any()


def test_long_runs_take_time_by_their_length(spark):
    """A megabyte of the name of a credential, assigned and not."""
    run = "token" * 200_000
    texts = [run, run + ' = "k3yk3yk3yk3y"', "x " + run + ":", "=".join(["token"] * 50_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").cache()
    docs.count()
    start = time.perf_counter()
    found = secrets_forest.candidates(docs, F.lit("")).select("doc_id", "at", F.length("value").alias("n")).collect()
    assert time.perf_counter() - start < 20
    assert {(r.doc_id, r.at, r.n) for r in found if r.doc_id < 3} == {
        (0, 0, len(run)), (1, len(run) + 4, 12), (2, 2, len(run))}


def test_forest_generalises_from_given_labels(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        value = "".join(rnd.choices("abcdefABCDEF0123456789xyzXYZ", k=32)) if k % 2 else "plainword" * 3 + "abc"[k % 3] * 4
        rows.append((k, f"see {value} here", None, "src/a.py"))
        if k < 120:
            labels.append((value, k % 2))
    docs = spark.createDataFrame([*rows, *ODD], DOC)
    reviewed = spark.createDataFrame(labels, "value string, label int")
    found = secrets_forest.scan(docs, F.col("source"), reviewed).toPandas()
    unseen = found[(found["doc_id"] >= 120)]
    assert ((unseen["doc_id"] % 2 == 1) == unseen["is_secret"]).mean() > 0.97


def test_no_labels_no_forest(spark):
    docs = spark.createDataFrame([(1, "see ab12CD34ef56GH78ij here", "en", None)], DOC)
    assert [r.score for r in secrets_forest.scan(docs, F.col("source")).collect()] == [0.5]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert langid.identify(none, langid.fit(none), "doc_id").collect() == []
    assert toxicity.score(none, toxicity.fit(none, labels), "doc_id").collect() == []
    assert lm_scoring.report(none).collect() == []
    assert secrets_forest.report(none, F.col("source")).collect() == []
