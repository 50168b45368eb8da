"""Resampling tests against plain Python with the same seed, and arguments of any shape."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from findling.operators import metrics, significance

SCORE = "method string, query_id string, ndcg double"


def plain(rows, resamples, seed):
    by = {}
    for method, query, value in rows:
        if value is not None:
            by.setdefault(query, {})[method] = round(value * 1e6)
    out = {}
    for a, b in itertools.combinations(sorted({m for m, _, _ in rows}), 2):
        d = {q: s[a] - s[b] for q, s in by.items() if a in s and b in s}
        if not d:
            continue
        means, extreme = [], 0
        for r in range(resamples):
            wd = w = sd = 0
            for q, x in d.items():
                digest = hashlib.md5(f"{seed}|{r}|{q}".encode()).hexdigest()
                chance = int(digest[:13], 16) / 2**52
                k, total = 0, math.exp(-1)
                while chance >= total and k < 12:
                    k += 1
                    total = sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))
                wd, w, sd = wd + k * x, w + k, sd + (-x if int(digest[13], 16) % 2 else x)
            if w:
                means.append(wd / w / 1e6)
            extreme += abs(sd) >= abs(sum(d.values()))
        means.sort()
        at = lambda q, means=means: means[max(math.ceil(len(means) * q) - 1, 0)]
        out[a, b] = (len(d), sum(d.values()) / len(d) / 1e6, at((1 - 0.95) / 2), at(1 - (1 - 0.95) / 2),
                     (extreme + 1) / (resamples + 1))
    return out


def test_pairs_equal_plain_python(spark):
    rnd = random.Random(3)
    rows = [(m, f"q{i}", round(rnd.random() ** p, 6)) for m, p in (("x", 1), ("y", 1), ("z", 3)) for i in range(25)]
    rows += [("x", "only", 0.5), ("w", "q1", None), ("w", "q2", 0.25)]
    got = significance.compare_pairs(spark.createDataFrame(rows, SCORE).repartition(5), "ndcg", 60, 11)
    got = {(r.a, r.b): tuple(r)[2:] for r in got.collect()}
    want = plain(rows, 60, 11)
    assert set(got) == set(want) and ("w", "x") in got
    for pair, values in want.items():
        assert got[pair] == pytest.approx(values, abs=2e-6)


def test_a_clear_difference_is_found_and_none_is_not(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(80):
        base = rnd.random() * 0.5
        rows += [("same", f"q{i}", base + rnd.gauss(0, 0.05)), ("base", f"q{i}", base + rnd.gauss(0, 0.05)),
                 ("more", f"q{i}", base + 0.1 + rnd.gauss(0, 0.05))]
    got = {(r.a, r.b): r for r in significance.compare_pairs(spark.createDataFrame(rows, SCORE), "ndcg", 400).collect()}
    assert got["base", "more"].p_value < 0.01 and got["base", "more"].high < 0
    assert got["base", "same"].p_value > 0.05 and got["base", "same"].low < 0 < got["base", "same"].high
    assert significance.compare_pairs(spark.createDataFrame([], SCORE)).count() == 0


def test_weights_are_poisson(spark):
    weight, sign = significance._drawn(1)
    drawn = spark.range(20_000).select(F.lit("q").alias("query_id"), F.col("id").alias("r")).select(weight.alias("w"), sign.alias("s"))
    row = drawn.agg(F.avg("w"), F.var_pop("w"), F.avg("s")).first()
    assert row[0] == pytest.approx(1, abs=0.03) and row[1] == pytest.approx(1, abs=0.06) and abs(row[2]) < 0.03


def test_arguments_of_any_shape(spark):
    args = ['{"k": 1}', '{"k": "x", "deep": {"a": [1, 2.5, {"b": true}]}}', '{"k": null}', "{broken", None, "7", "[]", "{}",
            '{"deep": {"a": "text"}, "other key": {}}']
    traces = spark.createDataFrame([(a, i % 2 == 0) for i, a in enumerate(args)], "args string, failed boolean")
    got = {(r.path, r.kind): (r.n_calls, r.n_values, r.n_failed) for r in metrics.argument_stats(traces).collect()}
    assert got == {
        (None, "malformed"): (2, 2, 1),  # no JSON, and none at all
        ("$", "OBJECT"): (5, 5, 3), ("$", "BIGINT"): (1, 1, 0), ("$", "ARRAY"): (1, 1, 1),
        ("$.k", "BIGINT"): (1, 1, 1), ("$.k", "STRING"): (1, 1, 0), ("$.k", "VOID"): (1, 1, 1),
        ("$.deep", "OBJECT"): (2, 2, 1), ("$.deep.a", "ARRAY"): (1, 1, 0), ("$.deep.a", "STRING"): (1, 1, 1),
        ("$.deep.a[]", "BIGINT"): (1, 1, 0), ("$.deep.a[]", "DECIMAL"): (1, 1, 0), ("$.deep.a[]", "OBJECT"): (1, 1, 0),
        ("$.deep.a[].b", "BOOLEAN"): (1, 1, 0), ("$.other key", "OBJECT"): (1, 1, 1),
    }
    shallow = {r.path for r in metrics.argument_stats(traces, depth=1).collect()}
    assert shallow == {None, "$", "$.k", "$.deep", "$.other key"}
