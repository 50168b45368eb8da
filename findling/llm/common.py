"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_OUT = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == HELD_OUT, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast when a count proves it has at most ``rows`` rows.

    Any other size joins by a shuffle. For narrow rows of numbers only.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text begins and ends.

    A null is a text without bytes. No Python object is made per text.
    """
    column = pa.concat_arrays([column.cast(pa.large_string())])  # drops a slice's offset
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Runs of rows ``(first, last)`` of at most ``most`` bytes; one longer text is a run alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def schema_with(df: DataFrame, keep, made: str, prefix: str = "") -> T.StructType:
    """The fields ``keep`` of ``df``, and those of the DDL text ``made`` with ``prefix``."""
    new = [T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(made)]
    return T.StructType([*(df.schema[c] for c in keep), *new])
