"""Nearest neighbours that read a part of the vectors: cells of a k-means partition.

Every vector lies in the cell of its nearest centre and is stored in that cell's
folder, so a search reads the folders of the ``probes`` cells nearest to each
question and no other file. What it finds there is exact; what lies in other cells
is missed, and ``cell_recall`` measures how much that is, and how much was read,
against the exact search, which stays the default (``dense.dense_topk``).

Centres are fitted on ``SAMPLE`` vectors at most, those with the smallest hashes of
their ids; all vectors are indexed. Vectors that are null or have no direction are in
no cell, as no search ranks them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.operators import dense

SAMPLE, ROUNDS, SEED = 20_000, 12, 20240229
CELL, NTH = "cell", "nth"
ASKED = 256  # vectors that ``choose_probes`` asks with


def _unit(matrix: np.ndarray) -> np.ndarray:
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have a direction, and their unit vectors."""
    rows = np.nonzero(column.is_valid().to_numpy(zero_copy_only=False))[0]
    lists = column.take(pa.array(rows))
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if not len(rows) or not len(flat):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    unit = _unit(flat.reshape(len(rows), -1))
    good = np.isfinite(unit).all(axis=1) & unit.any(axis=1)
    return rows[good], unit[good]


def fit_cells(
    vectors: DataFrame,
    n_cells: int,
    key: str,
    column: str = "embedding",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> np.ndarray:
    """Centres of unit length by spherical k-means on a bounded sample."""
    some = vectors.filter(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample)
    batches = some.select(column).toArrow().combine_chunks().to_batches()
    unit = _matrix(batches[0].column(0))[1] if batches else np.zeros((0, 0))
    if not len(unit):
        return np.zeros((0, 0))
    random = np.random.Generator(np.random.PCG64(seed))
    centres = unit[random.permutation(len(unit))[:n_cells]]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        centres = np.where((sums != 0).any(axis=1, keepdims=True), _unit(sums), centres)
    return centres


def nearest_cells(df: DataFrame, centres: np.ndarray, probes: int, column: str = "embedding") -> DataFrame:
    """A row of ``df`` for each of the ``probes`` cells nearest to its vector, the ``nth`` from 0."""
    held = df.sparkSession.sparkContext.broadcast(centres)
    made = [T.StructField(name, T.IntegerType(), False) for name in (CELL, NTH)]
    schema = T.StructType([*df.schema, *made])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in batches:
            rows, unit = _matrix(batch.column(batch.schema.get_field_index(column)))
            if not len(rows) or not len(centres):
                continue
            many = min(probes, len(centres))
            cells = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :many]
            taken = batch.take(pa.array(np.repeat(rows, many)))
            nth = np.tile(np.arange(many, dtype=np.int32), len(rows))
            arrays = [*taken.columns, pa.array(cells.ravel().astype(np.int32)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.mapInArrow(placed, schema)


def store_cells(vectors: DataFrame, centres: np.ndarray, base: str, column: str = "embedding") -> str:
    """Write all vectors to a fresh folder below ``base``, a folder per cell; returns it."""
    folder = f"{base}/cells-{uuid.uuid4().hex}"
    placed = nearest_cells(vectors, centres, 1, column).drop(NTH).hint("rebalance", CELL)
    placed.write.mode("errorifexists").partitionBy(CELL).parquet(folder)
    return folder


def _scope(df: DataFrame) -> Column:
    cell = F.col(CELL).cast("string")
    return F.concat_ws("/", cell, "tenant_id") if "tenant_id" in df.columns else cell


def cell_topk(
    queries: DataFrame,
    stored: DataFrame,
    centres: np.ndarray,
    k: int,
    probes: int,
    query_id: str = "query_id",
    vector_id: str = "chunk_id",
    column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors by cosine distance among those of each question's cells.

    ``stored`` is the table that ``store_cells`` wrote. Within the tenant when both sides
    carry one. With as many probes as cells the result is the exact one.
    """
    asked = nearest_cells(queries, centres, probes, column).drop(NTH)
    cells = [r[0] for r in asked.select(CELL).distinct().collect()]  # at most as many as centres
    read = stored.filter(F.col(CELL).isin(cells))
    both = "tenant_id" in queries.columns and "tenant_id" in stored.columns
    scoped = [
        df.withColumn("tenant_id", _scope(df if both else df.drop("tenant_id"))) for df in (asked, read)
    ]
    return dense.dense_topk(*scoped, k, query_id=query_id, vector_id=vector_id, column=column)


def choose_probes(
    stored: DataFrame,
    centres: np.ndarray,
    k: int,
    recall: float,
    key: str,
    column: str = "embedding",
    asked: int = ASKED,
) -> int:
    """The least number of cells that holds ``recall`` of the ``k`` nearest of a sample.

    The sample asks the whole table exactly, once; it only says how many cells to probe.
    """
    rows = stored.select(F.col(key).alias("query_id"), F.col(key).alias("own"), column)
    some = rows.orderBy(F.xxhash64("own"), "own").limit(asked).drop("own")
    near = dense.dense_topk(some, stored.select(key, column), k, vector_id=key, column=column)
    order = nearest_cells(some, centres, len(centres), column).select("query_id", CELL, NTH)
    nth = (
        near.join(stored.select(key, CELL), key)
        .join(order, ["query_id", CELL])
        .groupBy(NTH).agg(F.count(F.lit(1)).alias("n")).orderBy(NTH).collect()
    )
    held, total = 0, sum(r.n for r in nth)
    for r in nth:
        held += r.n
        if held >= recall * total:
            return r[NTH] + 1
    return max(len(centres), 1)


def cell_recall(
    queries: DataFrame,
    stored: DataFrame,
    centres: np.ndarray,
    k: int,
    probes: int,
    query_id: str = "query_id",
    vector_id: str = "chunk_id",
    column: str = "embedding",
) -> DataFrame:
    """One row: questions, share of the exact ``k`` nearest that the cells give, and the share
    of all vectors that was compared with a question on average."""
    names = {"query_id": query_id, "vector_id": vector_id, "column": column}
    found = cell_topk(queries, stored, centres, k, probes, **names).select(query_id, vector_id)
    exact = dense.dense_topk(queries, stored.drop(CELL), k, **names).select(query_id, vector_id)
    hit = exact.join(found.withColumn("hit", F.lit(1)), [query_id, vector_id], "left")
    sizes = stored.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
    read = nearest_cells(queries.select(query_id, column), centres, probes, column)
    compared = read.join(sizes, CELL).agg(F.sum("n").alias("compared"))
    return (
        hit.agg(F.count_distinct(query_id).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        .join(compared).join(stored.agg(F.count(F.lit(1)).alias("n_vectors")))
        .select("n_queries", "recall",
                (F.col("compared") / (F.col("n_queries") * F.col("n_vectors"))).alias("scanned_share"))
    )
