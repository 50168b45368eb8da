"""Toxicity scores from character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a text holds is counted over all labelled texts of either class;
their ratio of smoothed shares scales the feature, and a logistic regression is
trained on the scaled features of a bounded, documented sample of labelled
texts. Scoring walks over whole texts in Arrow batches, without a shuffle.

Defined results: a null text is empty. Labels that are null count as absent, a
document labelled twice is toxic if any label says so. Texts without known
features get the model's base score. Without labels of both classes all scores
are the share of toxic labels, 0 if there are none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm import grams
from findling.llm.common import (
    LOWER,
    broadcast_if_small,
    flat_texts,
    held_out,
    pieces,
    schema_with,
)

ORDERS = (3, 4, 5, 6)
BITS = 18
FEATURES = 2048
SAMPLE = 8_000  # labelled texts the linear classifier is fitted on, at most half of each class
THRESHOLD = 0.7
PIECE_BYTES = 256 << 10
SMALL_LABELS = 2_000_000
SMOOTHING = 1.0
PENALTY = 1.0  # on the squared weights, against the summed loss

#: Lower case for ASCII and for the letters of Latin-1, white space to blanks.
FOLD = LOWER.copy()
FOLD[9:14] = 32
FOLD[0xC0:0xDF] += 32


@dataclass
class Model:
    """``weights`` by bucket; features not chosen weigh 0."""

    weights: np.ndarray
    bias: float


def characters(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One folded byte per character up to U+07FF, two or three for others, and the new offsets.

    Letters of Latin-1 keep codes of their own; the rest may share codes, as features
    are hashed anyway.
    """
    lead = flat >= 0xC0
    at = np.nonzero(lead[:-1])[0]
    codes = flat.copy()
    codes[at + 1] = 0x80 | (flat[at] & 3) << 6 | (flat[at + 1] & 0x3F)
    before = np.concatenate([[0], np.cumsum(~lead)])
    return FOLD[codes[~lead]], before[offsets]


def wanted_buckets(flat: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
    """Distinct ``(text number, bucket)`` among the ``wanted`` buckets, ordered."""
    out, starts = grams.framed(*characters(flat, offsets))
    keys = []
    for n, bucket in grams.gram_buckets(out, starts, ORDERS, BITS):
        place = np.flatnonzero(wanted[bucket])
        of = np.searchsorted(starts, place, side="right") - 1
        inside = place + n - 1 <= starts[of + 1]
        keys.append(of[inside] << BITS | bucket[place[inside]].astype(np.int64))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys >> BITS, keys & ((1 << BITS) - 1)


def count_present(flat: np.ndarray, offsets: np.ndarray, kind: np.ndarray, totals: np.ndarray):
    """Add to ``totals[kind of the text]`` one for each bucket that a text holds."""
    out, starts = grams.framed(*characters(flat, offsets))
    by_order = []
    for n, bucket in grams.gram_buckets(out, starts, ORDERS, BITS):
        bucket = bucket.astype(np.int32)
        bucket[grams.leaving(starts, n, len(bucket))] = 1 << BITS  # counted nowhere
        by_order.append(bucket)
    held = np.zeros((1 << BITS) + 1, bool)
    for k in range(len(starts) - 1):
        for bucket in by_order:
            held[bucket[starts[k] : starts[k + 1]]] = True
        present = np.flatnonzero(held[:-1])
        totals[kind[k], present] += 1
        held[present], held[-1] = False, False


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training texts ``doc_id, text, toxic``, without the held-out fold."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    return docs.select("doc_id", "text").join(broadcast_if_small(known, SMALL_LABELS), "doc_id")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``bucket, n_toxic, n_clean``: texts of each class that hold a bucket.

    Row ``bucket = -1`` counts the texts themselves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            totals[0, -1] += (~toxic).sum()
            totals[1, -1] += toxic.sum()
            for first, last in pieces(offsets, PIECE_BYTES):
                part = offsets[first : last + 1]
                kind = toxic[first:last].astype(np.int64)
                count_present(flat[part[0] : part[-1]], part - part[0], kind, totals)
        seen = np.nonzero(totals.sum(0))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(seen == 1 << BITS, -1, seen)), pa.array(totals[1, seen]),
             pa.array(totals[0, seen])],
            ["bucket", "n_toxic", "n_clean"],
        )

    return (
        labelled.select("text", "toxic")
        .mapInArrow(count, "bucket bigint, n_toxic bigint, n_clean bigint")
        .groupBy("bucket")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    )


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """Ratio per bucket from an array of ``(n_toxic, n_clean)`` rows."""
    smooth = counts + SMOOTHING
    share = smooth / smooth.sum(0)
    return np.log(share[:, 0] / share[:, 1])


def informative(counts: np.ndarray, n_toxic: int, n_clean: int, most: int) -> np.ndarray:
    """Buckets whose presence depends on the class the most, by chi-square; ties by bucket."""
    present = counts.sum(1)
    total = n_toxic + n_clean
    expected = present * (n_toxic / total)
    spread = expected * (n_clean / total) * (1 - present / total)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(spread > 0, (counts[:, 0] - expected) ** 2 / spread, 0.0)
    chosen = np.lexsort((np.arange(len(score)), -score))[:most]
    return np.sort(chosen[score[chosen] > 0])


def _sample(labelled: DataFrame, wanted: np.ndarray, share: dict[int, float]):
    """Feature rows of a hash sample of the labelled texts: ``toxic, features``."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            for first, last in pieces(offsets, PIECE_BYTES):
                part = offsets[first : last + 1]
                of, bucket = wanted_buckets(flat[part[0] : part[-1]], part - part[0], wanted)
                ends = np.searchsorted(of, np.arange(last - first + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(bucket, pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(first, last - first), lists],
                    ["toxic", "features"],
                )

    coin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    keep = F.when(F.col("toxic") > 0, F.lit(share[1])).otherwise(F.lit(share[0]))
    return (
        labelled.filter(coin < keep)
        .select("text", "toxic")
        .mapInArrow(features, "toxic int, features array<int>")
    )


def _regression(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression, by Newton steps.

    Each step is solved by conjugate gradients, so that no square matrix is built.
    """
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 0.0

    def loss(w):
        m = x @ w
        return (weigh * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (penalty * w * w).sum()

    w = np.zeros(x.shape[1])
    w[-1] = np.log((weigh * y).sum() / (weigh * (1 - y)).sum())
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weigh * (p - y)) + penalty * w
        curve = weigh * p * (1 - p) + 1e-9
        step, rest = np.zeros_like(w), -slope
        way, size = rest.copy(), rest @ rest
        for _ in range(50):
            bent = x.T @ (curve * (x @ way)) + penalty * way
            far = size / max(way @ bent, 1e-30)
            step += far * way
            rest -= far * bent
            size, before = rest @ rest, size
            if size < 1e-6 * (slope @ slope):
                break
            way = rest + (size / before) * way
        now, part = loss(w), 1.0
        while loss(w + part * step) > now and part > 1e-3:
            part /= 2
        w += part * step
        if now - loss(w) < 1e-6 * abs(now):
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all labelled training texts, then the classifier on a sample of them."""
    labelled = _labelled(docs, labels)
    counted = gram_counts(labelled).toPandas().to_numpy(np.int64).reshape(-1, 3)
    total = counted[counted[:, 0] < 0]
    n_toxic, n_clean = (int(total[0, 1]), int(total[0, 2])) if len(total) else (0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n_toxic or not n_clean:
        base = n_toxic / max(1, n_toxic + n_clean)
        return Model(weights, float("inf") if base else float("-inf"))
    counts = np.zeros((1 << BITS, 2), np.int64)
    known = counted[counted[:, 0] >= 0]
    counts[known[:, 0]] = known[:, 1:]
    wanted = np.zeros(1 << BITS, bool)
    wanted[informative(counts, n_toxic, n_clean, FEATURES)] = True
    share = {c: min(1.0, SAMPLE / 2 / n) for c, n in ((0, n_clean), (1, n_toxic))}
    sample = _sample(labelled, wanted, share).toPandas()
    classes = (sample["toxic"].to_numpy() > 0).astype(np.int64)
    if len(set(classes)) < 2:
        return Model(weights, float(np.log(n_toxic / n_clean)))
    weigh = np.where(classes == 1, 1 / share[1], 1 / share[0])
    used = np.nonzero(wanted)[0]
    scale = log_count_ratios(counts)[used]
    x = np.zeros((len(sample), len(used)), np.float32)
    for row, held in zip(x, sample["features"]):
        row[np.searchsorted(used, held)] = 1
    values, bias = _regression(x * scale.astype(np.float32), classes, weigh)
    weights[used] = values * scale
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every document."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # 2**BITS floats, whatever the data

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value.weights, held.value.bias
        wanted = weights != 0
        for batch in batches:
            flat, offsets = flat_texts(batch.column("text"))
            margin = np.full(batch.num_rows, bias)
            for first, last in pieces(offsets, PIECE_BYTES):
                part = offsets[first : last + 1]
                of, bucket = wanted_buckets(flat[part[0] : part[-1]], part - part[0], wanted)
                margin[first:last] += np.bincount(
                    of, weights=weights[bucket], minlength=last - first
                )
            value = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))],
                [*keep, "score", "predicted"],
            )

    chosen = docs.select(*dict.fromkeys([*keep, "text"]))
    return chosen.mapInArrow(scored, schema_with(chosen, keep, "score double, predicted int"))
