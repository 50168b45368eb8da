"""The stored index: Parquet tables that Spark's own writers commit.

``chunks``: the rows of chunks with the vector beside the text, so that one write
makes both visible or neither, laid out by tenant. ``postings`` and ``stats``:
terms, laid out by a bucket of tenant and term, sorted within, postings in a run a
task and batch of chunks, so that they are not shuffled; a search that names terms
reads the buckets they fall into. Postings hold one line per chunk more,
under the empty term, from which the totals of a tenant are taken.

An index is a base that a batch wrote, and beside it what streams have added since
(``with_deltas``): of a document in both, the newest upload counts, in texts, vectors,
postings and statistics alike. Writing that union anew makes the next base.

Every batch write goes to a folder of its own, so writers never meet; streams
write through the Parquet file sink, whose log Spark keeps and reads. A reader
names the folders it wants. Of a document uploaded again, ``newest_uploads``
shows the last one only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findling.operators.ingest import DEFAULT_DIM, embed_chunks
from findling.operators.lexical import TERM_BUCKET, build_postings, term_bucket
from findling.session import BUCKET_BYTES, stored_options, written


def with_vectors(chunks: DataFrame, dim: int = DEFAULT_DIM, model=None) -> DataFrame:
    """The chunks with ``embedding`` in the same row; one that is there stays."""
    if "embedding" in chunks.columns:
        return chunks
    return embed_chunks(chunks, dim, model, keys=tuple(chunks.columns))


def store_chunks(chunks: DataFrame, base: str, dim: int = DEFAULT_DIM, model=None) -> str:
    """Write chunks and vectors at once, to a fresh folder below ``base``; returns it."""
    folder = f"{base}/chunks-{uuid.uuid4().hex}"
    rows = with_vectors(chunks, dim, model).hint("rebalance", "tenant_id")
    writer = rows.write.mode("errorifexists").options(**stored_options())
    writer.partitionBy("tenant_id").parquet(folder)
    return folder


def read_chunks(spark: SparkSession, *folders: str) -> DataFrame:
    """Stored chunks of one or more folders, each read by its own log or listing.

    Tenants are text, also where the names of their folders look like numbers.
    """

    def one(folder: str) -> DataFrame:
        found = spark.read.parquet(folder).schema
        fields = [T.StructField(f.name, T.StringType()) if f.name == "tenant_id" else f for f in found]
        return spark.read.schema(T.StructType(fields)).parquet(folder)

    return reduce(DataFrame.unionByName, [one(f) for f in folders])


def newest_uploads(chunks: DataFrame) -> DataFrame:
    """The chunks of each document's newest upload; the same upload delivered twice counts once."""
    newest = chunks.groupBy("tenant_id", "doc_id").agg(F.max("uploaded_at").alias("uploaded_at"))
    kept = chunks.join(newest, ["tenant_id", "doc_id", "uploaded_at"], "left_semi")
    return kept.dropDuplicates(["tenant_id", "chunk_id"])


def only_newest(chunks: DataFrame) -> DataFrame:
    """The same as ``newest_uploads`` where few documents came twice: texts of the others
    are not shuffled. The documents that did are found first, by their chunks' names."""
    keys, upload = ["tenant_id", "doc_id"], ["tenant_id", "doc_id", "uploaded_at"]
    per_upload = (
        chunks.groupBy(*upload, "chunk_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*upload).agg(F.max("n").alias("n"))
    )
    doubtful = per_upload.groupBy(*keys).agg(
        F.max("uploaded_at").alias("uploaded_at"), F.count(F.lit(1)).alias("uploads"), F.max("n").alias("n")
    ).filter("uploads > 1 OR n > 1")
    doubtful = written(doubtful, "uploaded-twice")
    clean = chunks.join(doubtful.select(*keys), keys, "left_anti")
    newest = chunks.join(doubtful.select(*upload), upload, "left_semi")
    return clean.unionByName(newest.dropDuplicates(["tenant_id", "chunk_id"]))


def newest_chunked(docs: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The newest uploads' chunks as ``cut`` makes them of documents: the documents that came
    twice are found by their keys, so that the texts of all others are cut just once."""
    keys = ["tenant_id", "doc_id"]
    twice = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    twice = written(twice, "came-twice")
    if twice.isEmpty():
        return cut(docs)
    again = newest_uploads(cut(docs.join(twice, keys, "left_semi")))
    return cut(docs.join(twice, keys, "left_anti")).unionByName(again)


def read_terms(spark: SparkSession, *folders: str) -> DataFrame:
    """Stored postings of one or more folders."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f) for f in folders])


def _live(base: DataFrame, new: DataFrame, newest: DataFrame, twice: DataFrame | None, *row: str) -> DataFrame:
    """Rows of documents that did not come again, and those of newest uploads; only of uploads
    that were delivered ``twice`` are rows compared."""
    keys = ["tenant_id", "doc_id"]
    kept = base.join(newest.select(*keys), keys, "left_anti")
    fresh = new.join(newest, [*keys, "uploaded_at"], "left_semi")
    if twice is None:
        return kept.unionByName(fresh)
    again = fresh.join(twice, keys, "left_semi").dropDuplicates([*row])
    return kept.unionByName(fresh.join(twice, keys, "left_anti")).unionByName(again)


def with_deltas(
    chunks: DataFrame, postings: DataFrame, new_chunks: DataFrame, new_postings: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, postings and statistics of a base together with what streams added.

    A document counts as added once its postings are there. One that came again hides
    what the base has of it, unless the base's upload is the newer one. What is added
    meets short lists of documents, as the base's rows do: only uploads that were delivered
    twice, which their chunks' lines under the empty term tell, are deduplicated.
    Statistics of terms are added up when they are read.
    """
    keys = ["tenant_id", "doc_id"]
    arrived = new_postings.filter("term = ''").groupBy(*keys, "uploaded_at", "chunk_id")
    arrived = written(arrived.agg(F.count(F.lit(1)).alias("n")), "arrived")
    twice = written(arrived.filter("n > 1").select(*keys).distinct(), "delivered-twice")
    twice = None if twice.isEmpty() else twice
    added = arrived.groupBy(*keys).agg(F.max("uploaded_at").alias("uploaded_at"))
    base = (
        postings.filter("term = ''").join(added.select(*keys), keys, "left_semi")
        .groupBy(*keys).agg(F.max("uploaded_at").alias("base_at"))
    )
    newest = added.join(base, keys, "left").filter("base_at IS NULL OR uploaded_at >= base_at")
    newest = written(newest.drop("base_at"), "newest-uploads")
    chunks = _live(chunks, new_chunks, newest, twice, "tenant_id", "chunk_id")
    postings = _live(postings, new_postings, newest, twice, TERM_BUCKET, "tenant_id", "term", "chunk_id")
    totals = postings.filter("term = ''").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_terms").alias("n_terms")
    )
    stats = (
        postings.filter("term != ''").groupBy(TERM_BUCKET, "tenant_id", "term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        .join(written(totals, "tenant-totals"), "tenant_id")
    )
    return chunks, postings, stats


def store_terms(chunks: DataFrame, base: str) -> tuple[str, str]:
    """Write postings and statistics of stored chunks; returns their folders."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    postings, stats = f"{base}/postings-{name}", f"{base}/stats-{name}"

    def write(df: DataFrame, folder: str) -> None:
        writer = df.write.mode("errorifexists").options(**stored_options(BUCKET_BYTES))
        writer.partitionBy(TERM_BUCKET).parquet(folder)

    # Postings come in runs sorted by tenant and term, which the writer's stable sort by bucket keeps.
    write(build_postings(chunks, marked=True).withColumn(TERM_BUCKET, term_bucket()), postings)
    stored = spark.read.parquet(postings)
    totals = stored.filter("term = ''").groupBy("tenant_id").agg(F.sum("chunk_terms").alias("n_terms"))
    # What a chunk without a text counts for is known by the chunks alone; their texts stay unread.
    n_chunks = chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    counted = (
        stored.filter("term != ''").groupBy(TERM_BUCKET, "tenant_id", "term")
        .agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf"))
        .join(written(n_chunks.join(totals, "tenant_id"), "tenant-totals"), "tenant_id")
    )
    columns = ("tenant_id", "term", "df", "cf", "n_chunks", "n_terms", TERM_BUCKET)
    rows = counted.select(*columns).hint("rebalance", TERM_BUCKET)
    write(rows.sortWithinPartitions(TERM_BUCKET, "tenant_id", "term"), stats)
    return postings, stats
