"""Language identification by the nearest of several centroids per language.

Texts become hashed character n-gram vectors, weighed by term and inverse
document frequency and normalised. Document frequencies come from all training
texts; the centroids of each language are clustered (spherical k-means) on a
bounded, documented sample of them. A text gets the language of the centroid
with the largest cosine, and is accepted unless it lies further away than
nearly all training texts of a like length do from theirs.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is not accepted. Without training texts everything is ``und``, and whatever
has a letter is accepted, as there is nothing to be far from. Ties go to the
language that is first by name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findling.llm import grams
from findling.llm.common import LOWER, flat_texts, held_out, pieces, schema_with

ORDERS = (1, 2, 3)
BITS = 12
SIZE = 1 << BITS
CENTROIDS = 3
SAMPLE = 2400  # training texts the centroids are clustered on, shared by the languages, 20 each at least
LENGTH_BINS = 24  # powers of two of a text's number of n-grams
REJECT_SHARE = 0.001  # of training texts of a length lie below the floor before the slack
REJECT_SLACK = 0.5
UNKNOWN = "und"
PIECE_BYTES = 512 << 10
ROWS = 256

#: Bytes that are no part of a letter become blanks: digits, punctuation, control characters.
FOLD = LOWER.copy()
for _b in range(128):
    if not chr(_b).isalpha():
        FOLD[_b] = 32


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid, of length 1
    of: np.ndarray  # the language of each centroid
    floors: np.ndarray  # the least cosine accepted, by length bin


def _counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x buckets: how often each n-gram bucket occurs."""
    n_texts = len(offsets) - 1
    out, starts = grams.framed(FOLD[flat], offsets)
    row = np.repeat(np.arange(n_texts, dtype=np.int64) * SIZE, np.diff(starts))
    total = np.zeros(n_texts * SIZE, np.int64)
    for n, bucket in grams.gram_buckets(out, starts, ORDERS, BITS):
        cells = row[: len(bucket)] + bucket
        total += np.bincount(cells, minlength=len(total))
        left = grams.leaving(starts, n, len(bucket))
        np.subtract.at(total, cells[left], 1)
    return total.reshape(n_texts, SIZE)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first, last, counts`` of the texts of a batch, a bounded number at a time."""
    flat, offsets = flat_texts(column)
    for first, last in pieces(offsets, PIECE_BYTES):
        for at in range(first, last, ROWS):
            end = min(at + ROWS, last)
            part = offsets[at : end + 1]
            yield at, end, _counts(flat[part[0] : part[-1]], part - part[0])


def _bins(counts: np.ndarray) -> np.ndarray:
    lengths = np.maximum(counts.sum(1), 1)
    return np.minimum(np.log2(lengths).astype(np.int64), LENGTH_BINS - 1)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts, dtype=np.float32) * idf
    norm = np.sqrt((values * values).sum(1, keepdims=True))
    return values / np.maximum(norm, 1e-12)


def has_letter(column: pa.Array) -> np.ndarray:
    found = pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}")
    return found.fill_null(False).to_numpy(zero_copy_only=False)


def training_texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "lang", "text"
    )


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts that hold each bucket, and in the last place all texts; SIZE + 1 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for _, _, counts in _blocks(batch.column("text")):
                total[:-1] += (counts > 0).sum(0)
                total[-1] += len(counts)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[seen])], ["bucket", "n"]
        )

    summed = (
        texts.select("text")
        .mapInArrow(count, "bucket bigint, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(SIZE + 1, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def _sample(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and n-gram counts of a hash sample, about as many texts of each language.

    Only the number of texts of each language reaches the driver before.
    """
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, SIZE), np.int32)
    share = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max(20, SAMPLE / len(sizes)) / n))]
    )
    coin = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, counts in _blocks(batch.column("text")):
                packed = [row.astype(np.int32).tobytes() for row in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(first, last - first), pa.array(packed)],
                    ["lang", "counts"],
                )

    chosen = texts.filter(coin < share[F.col("lang")])
    rows = chosen.select("lang", "text").mapInArrow(count, "lang string, counts binary").toPandas()
    rows = rows.sort_values(["lang", "counts"], kind="stable")
    matrix = np.frombuffer(b"".join(rows["counts"]), np.int32).reshape(-1, SIZE)
    return rows["lang"].tolist(), matrix


def _cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts with the vector next to the mean, then the farthest ones."""
    first = int(np.argmax(vectors @ vectors.mean(0)))
    chosen = [first]
    nearest = vectors @ vectors[first]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(12):
        mine = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[mine == c].sum(0) for c in range(len(centroids))])
        norm = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def fit(docs: DataFrame) -> Model:
    """A model from the texts with a language outside the held-out fold."""
    texts = training_texts(docs)
    seen = document_frequencies(texts)
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    labels, counts = _sample(texts)
    languages = sorted(set(labels))
    if not languages:
        return Model([], idf, np.zeros((0, SIZE), np.float32), np.zeros(0, int), np.zeros(LENGTH_BINS))
    known = np.array([languages.index(x) for x in labels])
    vectors = _vectors(counts, idf)
    parts = [_cluster(vectors[known == i], CENTROIDS) for i in range(len(languages))]
    centroids = np.concatenate(parts).astype(np.float32)
    of = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    own = np.where(of[None, :] == known[:, None], vectors @ centroids.T, -1).max(1)
    bins, floors = _bins(counts), np.zeros(LENGTH_BINS)
    for b in range(LENGTH_BINS):
        near = own[(bins >= b - 1) & (bins <= b + 1)]
        floors[b] = REJECT_SLACK * np.quantile(near, REJECT_SHARE) if len(near) else 0.0
    return Model(languages, idf, centroids, of, floors)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` that a model fitted on them accepts as text of one of its languages."""
    columns = docs.columns
    marked = identify(docs, fit(docs), *columns, prefix="__lang_")
    return marked.filter("__lang_accepted").select(*columns)


def identify(docs: DataFrame, model: Model, *keep: str, prefix: str = "") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (the cosine) and ``accepted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as there are languages

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text = batch.column("text")
            best = np.full(batch.num_rows, len(model.languages))
            cosine = np.zeros(batch.num_rows)
            accepted = np.zeros(batch.num_rows, bool)
            if model.languages:
                for first, last, counts in _blocks(text):
                    near = _vectors(counts, model.idf) @ model.centroids.T
                    top = np.argmax(near, axis=1)
                    best[first:last] = model.of[top]
                    cosine[first:last] = np.clip(near[np.arange(len(top)), top], 0, 1)
                    accepted[first:last] = cosine[first:last] >= model.floors[_bins(counts)]
            lettered = has_letter(text)
            best[~lettered], cosine[~lettered] = len(model.languages), 0.0
            accepted = accepted & lettered if model.languages else lettered
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(names[best], pa.string()), pa.array(cosine), pa.array(accepted)],
                [*keep, *(prefix + name for name in ("lang_pred", "score", "accepted"))],
            )

    chosen = docs.select(*dict.fromkeys([*keep, "text"]))
    made = "lang_pred string, score double, accepted boolean"
    return chosen.mapInArrow(assigned, schema_with(chosen, keep, made, prefix))
