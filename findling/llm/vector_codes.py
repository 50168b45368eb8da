"""Product codes of vectors, with exact nearest entries by sliced bitmasks.

A vector's components become integers, ``floor(1024 * x)``, and are cut into
equal parts; every part position has a codebook, improved over some rounds by
replacing each entry by the floored mean of the parts nearest to it.

The nearest entry is found by slices: per dimension the entries' coordinates are
sorted, and for every prefix of that order a mask of 64-bit words says which
entries it holds. A part and a radius pick a range of each dimension; the masks
of its two ends differ in the entries inside, and the masks of all dimensions
ANDed leave the entries of the box around the part. Those are compared exactly.
The box holds all entries within the radius, so a best one no further than that
is the nearest; where none is, the radius grows, to that entry's distance at most.

Tasks read Arrow batches; a round sends one row per entry and task to the shuffle,
and codebooks, ``PARTS * ENTRIES`` entries at most, are all that reaches the driver.

Defined results: vectors that are null or empty, or hold null or non-finite
components, are left out. Ties go to the lower entry. A null id counts as the
largest; rows that share an id are ordered by their components and coded each by
itself. Fewer rows than entries make shorter codebooks; no rows an empty table and
the digest of an empty text. Null labels are one label. Vectors of several widths,
of a width that ``PARTS`` does not divide, or with components beyond 65,536 (their
squared distances would leave 64 bits) raise ``ValueError``. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.llm.common import broadcast_if_small
from findling.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 26  # of a component as an integer
AT_ONCE = 1 << 14  # parts that a task compares at once
SALTS = 16
SMALL_LABELS = 1 << 20


class Slices:
    """Sorted coordinates of a codebook and the masks of their prefixes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entry by dimension, int64
        n, width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        words = -(-n // 64)
        self.prefix = np.zeros((width, n + 1, words), np.uint64)
        for d in range(width):
            one = np.zeros((n, words), np.uint64)
            at = self.order[:, d]
            one[np.arange(n), at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
            self.prefix[d, 1:] = np.bitwise_or.accumulate(one, axis=0)
        # A first radius: how far the entries lie from their nearest neighbour, as a rule.
        if n > 1:
            gaps = [np.partition(((entries - e) ** 2).sum(axis=1), 1)[1] for e in entries]
            self.radius = max(1, int(np.sqrt(np.median(gaps))))
        else:
            self.radius = 1

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(part, entry)`` of every entry inside the box of ``radius`` around a part."""
        masks = None
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + radius, side="right")
            inside = self.prefix[d, high] ^ self.prefix[d, low]
            masks = inside if masks is None else masks & inside
        bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits[:, : len(self.entries)])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the lowest of equals, and its squared distance."""
        best = np.zeros(len(parts), np.int64)
        least = np.full(len(parts), np.iinfo(np.int64).max)
        if not parts.shape[1]:
            return best, np.zeros(len(parts), np.int64)
        open_, radius = np.arange(len(parts)), np.full(len(parts), self.radius, np.int64)
        while len(open_):
            row, entry = self.candidates(parts[open_], radius)
            if len(row):
                square = ((parts[open_[row]] - self.entries[entry]) ** 2).sum(axis=1)
                starts = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
                smallest = np.minimum.reduceat(square, starts)
                first = np.nonzero(square == np.repeat(smallest, np.diff(np.append(starts, len(row)))))[0]
                rows, at = np.unique(row[first], return_index=True)
                best[open_[rows]] = entry[first[at]]
                least[open_[rows]] = smallest
            found = least[open_]
            sure = found <= radius * radius
            reach = np.ceil(np.sqrt(np.minimum(found, 1 << 62).astype(np.float64))).astype(np.int64) + 1
            radius = np.minimum(radius * 2, reach)[~sure]
            open_ = open_[~sure]
        return best, least


def kept_vectors(batch: pa.RecordBatch, column: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count, and their integer components."""
    lists = batch.column(column)
    lists = pa.concat_arrays([lists.cast(pa.large_list(lists.type.value_type))])
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset :][: len(lists) + 1]
    values = lists.values
    whole = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    good = np.concatenate([[0], np.cumsum(whole & np.isfinite(numbers))])
    sizes = np.diff(offsets)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    rows = np.nonzero(valid & (sizes > 0) & (good[offsets[1:]] - good[offsets[:-1]] == sizes))[0]
    if (sizes[rows] != width).any():
        raise ValueError("the vectors are not all of one width")
    scaled = np.floor(numbers[offsets[rows, None] + np.arange(width)] * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} are not supported")
    return rows, scaled.astype(np.int64)


def _assigned(parts: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part of the vectors, by vector and position."""
    size = parts.shape[1] // PARTS
    best = np.zeros((len(parts), PARTS), np.int64)
    least = np.zeros((len(parts), PARTS), np.int64)
    for first in range(0, len(parts), AT_ONCE):
        some = slice(first, first + AT_ONCE)
        for p, sliced in enumerate(slices):
            best[some, p], least[some, p] = sliced.nearest(parts[some, p * size : (p + 1) * size])
    return best, least


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector counts."""
    finite = f"""size({column}) > 0 AND forall({column},
        x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"""
    return vectors.filter(F.col(column).isNotNull()).filter(F.expr(finite))


def first_codebooks(vectors: DataFrame, vec_id: str, column: str) -> np.ndarray:
    """The parts of the vectors with the smallest ids: position, entry, dimension."""
    order = [F.asc_nulls_last(vec_id), F.asc(column)]
    rows = _usable(vectors, column).orderBy(*order).limit(ENTRIES).select(column).toArrow()
    batch = rows.combine_chunks().to_batches()
    if not batch:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = len(batch[0].column(0)[0])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components do not fall into {PARTS} equal parts")
    _, parts = kept_vectors(batch[0], 0, width)
    return parts.reshape(len(parts), PARTS, -1).transpose(1, 0, 2)


def _sums(vectors: DataFrame, column: str, books: np.ndarray) -> DataFrame:
    """``part, entry, n, s0, s1, ...``: components summed over the parts nearest to each entry."""
    context = vectors.sparkSession.sparkContext
    held, (_, n_entries, size) = context.broadcast(books), books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in held.value]
        counts = np.zeros(PARTS * n_entries, np.int64)
        sums = np.zeros((PARTS * n_entries, size), np.int64)
        for batch in batches:
            _, parts = kept_vectors(batch, 0, PARTS * size)
            best, _ = _assigned(parts, slices)
            for p in range(PARTS):
                counts += np.bincount(best[:, p] + p * n_entries, minlength=len(counts))
                np.add.at(sums, best[:, p] + p * n_entries, parts[:, p * size : (p + 1) * size])
        used = np.nonzero(counts)[0]
        if len(used):
            arrays = [used // n_entries, used % n_entries, counts[used], *sums[used].T.copy()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names)

    names = ["part", "entry", "n", *(f"s{d}" for d in range(size))]
    tasks = vectors.select(column).mapInArrow(summed, ", ".join(f"{n} bigint" for n in names))
    return tasks.groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in names[2:]))


def fit(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The codebooks after all rounds: position, entry, dimension."""
    books = first_codebooks(vectors, vec_id, column)
    if not books.shape[1]:
        return books
    for _ in range(ROUNDS):
        rows = np.array(_sums(vectors, column, books).collect(), np.int64)
        books = books.copy()
        books[rows[:, 0], rows[:, 1]] = rows[:, 3:] // rows[:, 2:3]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place within."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame,
    books: np.ndarray,
    keep: tuple[str, ...] = ("vec_id",),
    column: str = "embedding",
) -> DataFrame:
    """``keep``, ``code`` and ``error`` of every vector that counts."""
    held = vectors.sparkSession.sparkContext.broadcast(books)
    size = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in held.value] if held.value.shape[1] else []
        for batch in batches:
            if not slices:
                continue
            rows, parts = kept_vectors(batch, 0, PARTS * size)
            best, least = _assigned(parts, slices)
            hexes = best.astype(np.uint8).tobytes().hex()
            codes = [hexes[i : i + 2 * PARTS] for i in range(0, len(hexes), 2 * PARTS)]
            kept = [batch.column(i + 1).take(pa.array(rows)) for i in range(len(keep))]
            made = [pa.array(codes, pa.string()), pa.array(least.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)

    chosen = vectors.select(F.col(column).alias("__vector"), *keep)
    made = T.StructType.fromDDL("code string, error bigint")
    schema = T.StructType([*(chosen.schema[c] for c in keep), *made])
    return chosen.mapInArrow(coded, schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", column: str = "decoded") -> DataFrame:
    """``codes`` with the vector that each code stands for, in the scale of the input.

    A null code stands for a null vector.
    """
    held = codes.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*codes.schema, T.StructField(column, T.ArrayType(T.DoubleType()))])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(code))
            rows = np.nonzero(texts.is_valid().to_numpy(zero_copy_only=False))[0]
            digits = bytes.fromhex("".join(texts.take(pa.array(rows)).to_pylist()))
            entries = np.frombuffer(digits, np.uint8).reshape(-1, PARTS)
            made = [None] * len(texts)
            if len(rows):
                found = books[np.arange(PARTS), entries].reshape(len(rows), -1) / SCALE
                for row, vector in zip(rows.tolist(), found):
                    made[row] = vector
            columns = [*batch.columns, pa.array(made, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return codes.mapInArrow(decoded, schema)


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that counts."""
    vectors = vectors.select("vec_id", "embedding", "label")
    books = fit(vectors)
    coded = written(encode(vectors, books, ("vec_id", "label")), "vector-codes")
    # A label may hold a third of the rows: they are dealt over salts, to each of
    # which the label's one line is copied, should the join shuffle.
    totals = written(
        coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")),
        "label-errors",
    )
    salted = totals.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt"))
    return (
        coded.withColumn("salt", salt)
        .join(broadcast_if_small(salted, SMALL_LABELS), same)
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )
