"""Summaries by centrality: the sentences that are most like the rest of their text.

The sentences of a text are a graph, an edge weighing the cosine of two sentences'
words. A walk over it follows an edge by its weight with chance ``DAMPING`` and starts
anew anywhere otherwise; sentences are ranked by how often it visits them. Each step of
the power iteration brings any start nearer to the one limit by the factor ``DAMPING``
in the sum of absolute differences, so ``steps_for`` steps leave at most the tolerance.

Of a few sentences, ``SQUARED`` at most, the steps are taken in doubles, by squaring what one
step does. Otherwise the graph is never written down: similarities are products of the
sentences' vectors, so a step multiplies by those and costs time and memory by the length of
the text, which stays in its row; steps end once they can no longer lead further than the
tolerance. A sentence that shares no word with another has no edge; from there the
walk goes anywhere. What is said twice is one sentence, at its first place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.operators.segmentation import SentenceModel, hashed_words, sentences

DAMPING, TOLERANCE, SENTENCES = 0.85, 1e-9, 3
SQUARED = 64  # sentences whose steps are squared


def steps_for(tolerance: float, damping: float = DAMPING) -> int:
    """Steps after which any start is within ``tolerance`` of the limit; two is the most apart."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping))


def centrality(rows: np.ndarray, damping: float = DAMPING, tolerance: float = TOLERANCE) -> np.ndarray:
    """The share of visits to each sentence, from a row of not negative numbers for each."""
    n = len(rows)
    size = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    unit = np.divide(rows, size, out=np.zeros(rows.shape), where=size > 0)
    weight = unit @ unit.sum(axis=0) - unit.any(axis=1)  # of all edges to other sentences
    alone = weight < 1e-9
    weight[alone] = 0.0
    if n <= SQUARED:
        return _squared(unit, weight, damping, steps_for(tolerance, damping))
    share = np.full(n, 1.0 / n)
    near = tolerance * (1 - damping) / damping  # of a step: what is left of the way then is less than the tolerance
    for _ in range(steps_for(tolerance, damping)):
        leaving = np.divide(share, weight, out=np.zeros(n), where=weight > 0)
        lost = share[alone].sum() / n  # from sentences without edges the walk goes anywhere
        last, share = share, (1 - damping) / n + damping * (unit @ (unit.T @ leaving) - leaving + lost)
        if np.abs(share - last).sum() <= near:
            break
    return share


def _squared(unit: np.ndarray, weight: np.ndarray, damping: float, steps: int) -> np.ndarray:
    """The walk after at least ``steps`` steps: ``step`` and ``start`` do as many as were taken, then twice."""
    n = len(unit)
    edges = unit @ unit.T
    np.fill_diagonal(edges, edges.diagonal() - unit.any(axis=1))
    step = damping * np.divide(edges, weight, out=np.full((n, n), 1.0 / n), where=weight > 0)
    start = np.full(n, (1 - damping) / n)
    for _ in range(math.ceil(math.log2(steps))):
        start = step @ start + start
        step = step @ step
    return step.sum(axis=1) / n + start


def central_sentences(
    text: str, lang: str, most: int, model: SentenceModel
) -> list[tuple[int, float, str]]:
    """Place, share and words of the ``most`` central sentences, in the order of the text.

    Shares count in millionths for the ranking; equal ones go by place.
    """
    first: dict[str, tuple[int, str]] = {}
    for place, tokens in enumerate(sentences(text)):
        first.setdefault(" ".join(tokens).lower(), (place, " ".join(tokens)))
    if not first:
        return []
    places, whole = zip(*first.values())
    share = np.round(centrality(model(list(whole), lang)), 6)
    best = np.lexsort((np.arange(len(whole)), -share))[:most]
    return [(places[i], float(share[i]), whole[i]) for i in sorted(best.tolist())]


def extractive_summary(
    texts: DataFrame,
    *keys: str,
    most: int = SENTENCES,
    text: str = "text",
    lang: str = "lang",
    model: SentenceModel | None = None,
) -> DataFrame:
    """``keys, sentence_no, share, text`` of each row's most central sentences.

    A null text has none.
    """
    model = model or hashed_words()
    chosen = texts.select(F.col(text).alias("__text"), F.col(lang).alias("__lang"), *keys)
    found = "array<struct<sentence_no:int,share:double,text:string>>"
    schema = T.StructType([*(chosen.schema[k] for k in keys), *T.StructType.fromDDL(f"__found {found}")])
    kind = pa.list_(pa.struct([("sentence_no", pa.int32()), ("share", pa.float64()), ("text", pa.string())]))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"sentence_no": p, "share": s, "text": t} for p, s, t in
                 central_sentences(body.as_py() or "", code.as_py() or "", most, model)]
                for body, code in zip(batch.column(0), batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(rows, kind)], schema.names)

    return chosen.mapInArrow(ranked, schema).select(*keys, F.inline("__found"))
