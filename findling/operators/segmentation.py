"""Chunks that are coherent in meaning: cut where neighbouring sentences differ most.

A document falls into sentences. At every gap between two of them the words on
either side are compared, and dynamic programming chooses the set of cuts with the
least sum of similarities, each taken against the document's own level, so that a
cut into one topic costs and one between two topics pays. A chunk holds ``least``
tokens or more (the last one may hold fewer) and no more than ``most``.

All of it happens inside the row of a document, without a shuffle; a document's
similarities are computed a bounded number of sentences at a time, and the choice
looks back no further than ``most`` tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from findling.functions.text import LANGUAGES, stop_words
from findling.operators.ingest import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    LINES_PER_PAGE,
    PIECE,
    chunk_at,
)

LEAST = 100  # tokens of a chunk that is not the last
WIDTH = 256  # buckets that the words of a sentence are hashed into
BESIDE = 6  # sentences compared on either side of a gap
AT_ONCE = 2048  # sentences whose vectors are held at once

_BLANKS = re.compile(r"[ \t\x0b\f\r]+")  # as the tokens of all chunks are cut
_WORDS = re.compile(r"[^\W_]+")

SentenceModel = Callable[[list[str], str], np.ndarray]


def sentences(text: str, piece: int = PIECE) -> list[list[str]]:
    """The tokens of each sentence: up to a closing mark, a line's end, or ``piece`` tokens."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        own: list[str] = []
        for token in filter(None, _BLANKS.split(line)):
            own.append(token)
            if token[-1] in ".!?" or len(own) == piece:
                out.append(own)
                own = []
        if own:
            out.append(own)
    return out


def hashed_words() -> SentenceModel:
    """A row per sentence: how often words that are no stop words fall into each bucket.

    Made on the driver, where the lists of stop words are; tasks get the lists.
    """
    dropped = {lang: frozenset(stop_words(lang)) for lang in LANGUAGES}

    def counts(some: list[str], lang: str) -> np.ndarray:
        none = dropped.get(lang, frozenset())
        out = np.zeros((len(some), WIDTH), np.float32)
        cells = [
            row * WIDTH + crc32(word.encode()) % WIDTH
            for row, sentence in enumerate(some)
            for word in _WORDS.findall(sentence.lower())
            if word not in none
        ]
        places, n = np.unique(np.array(cells, np.int64), return_counts=True)
        out.ravel()[places] = n
        return out

    return counts


def gap_similarities(
    tokens: list[list[str]], lang: str, model: SentenceModel, beside: int = BESIDE
) -> np.ndarray:
    """Cosine of what stands before and after each gap; 0 where a side has no words."""
    n = len(tokens)
    out = np.zeros(max(n - 1, 0))
    for first in range(0, n - 1, AT_ONCE):
        last = min(first + AT_ONCE, n - 1)  # gaps first..last-1; gap g lies before sentence g + 1
        low, high = max(first + 1 - beside, 0), min(last + beside, n)
        rows = model([" ".join(t) for t in tokens[low:high]], lang).astype(np.float64)
        sums = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
        at = np.arange(first, last) + 1 - low
        left = sums[at] - sums[np.maximum(at - beside, 0)]
        right = sums[np.minimum(at + beside, len(rows))] - sums[at]
        size = np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))
        both = (left * right).sum(axis=1)
        out[first:last] = np.divide(both, size, out=np.zeros_like(both), where=size > 0)
    return out


def cut_costs(similar: np.ndarray) -> np.ndarray:
    """Similarities against the document's level: half a deviation below the mean costs nothing."""
    if not len(similar):
        return similar
    return np.round(similar - (similar.mean() - similar.std() / 2), 9)


def best_cuts(sizes: np.ndarray, costs: np.ndarray, least: int, most: int) -> list[int]:
    """The sentences at which chunks begin, the first included, at the least total cost.

    ``sizes`` are tokens per sentence, ``costs`` those of the gaps. Of equal choices the
    one whose last chunk begins first is taken, and so on back to the beginning.
    """
    n = len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = np.full(n + 1, np.inf)  # of the best way to cut what stands before a sentence
    total[0] = 0.0
    begun = np.zeros(n + 1, np.int64)
    paid = np.concatenate([[0.0], costs, [0.0]])  # for a cut before a sentence
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    low = np.searchsorted(ends, ends - most, side="left")
    high = np.searchsorted(ends, ends - least, side="right")
    for end in range(1, n + 1):
        to = high[end] if end < n else end
        if low[end] < to:
            some = best[low[end] : to]
            at = int(some.argmin())
            total[end], begun[end] = some[at], low[end] + at
            best[end] = total[end] + paid[end]
    cuts, at = [], n
    while at > 0:
        at = int(begun[at])
        cuts.append(at)
    return cuts[::-1]


def document_cuts(
    text: str, lang: str, least: int, most: int, model: SentenceModel, piece: int = PIECE
) -> list[int]:
    """The tokens of a text at which its chunks begin."""
    tokens = sentences(text, min(piece, most - least + 1))
    if not tokens:
        return []
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cuts = best_cuts(sizes, cut_costs(gap_similarities(tokens, lang, model)), least, most)
    return starts[cuts].tolist()


def chunk_coherent(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: float = CHUNK_OVERLAP,
    least: int = LEAST,
    lines_per_page: int = LINES_PER_PAGE,
    piece: int = PIECE,
    model: SentenceModel | None = None,
) -> DataFrame:
    """Chunks of whole sentences, each led by the last tokens of the chunk before.

    ``model`` turns sentences of one language into vectors; their default is hashed
    words. A text without tokens, or none at all, gives no chunk.
    """
    shared = int(size * overlap)
    most = size - shared
    if not 0 < least < most:
        raise ValueError(f"least must be between 1 and {most - 1}, not {least}")
    model = model or hashed_words()
    kept = [c for c in ("tenant_id", "doc_id", "lang", "uploaded_at", "text") if c in docs.columns]
    chosen = docs.select(*kept)
    schema = T.StructType([*chosen.schema, T.StructField("marks", T.ArrayType(T.IntegerType(), False))])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(kept.index("text")), batch.column(kept.index("lang"))
            marks = [
                document_cuts(text.as_py() or "", lang.as_py() or "", least, most, model, piece)
                for text, lang in zip(texts, langs)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(marks, pa.list_(pa.int32()))], schema.names
            )

    return chunk_at(chosen.mapInArrow(marked, schema), "marks", shared, lines_per_page)
