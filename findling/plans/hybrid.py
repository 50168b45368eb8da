"""Hybrid search over a table of questions: the composed retrieval query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from findling.operators import dense, fusion, ingest, lexical
from findling.sources import index_store


@dataclass(frozen=True)
class Index:
    """What retrieval reads. Each part may be a written table or a lazy DataFrame."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame
    stats: DataFrame
    dim: int


def index_chunks(
    chunks: DataFrame, dim: int = ingest.DEFAULT_DIM, queries: DataFrame | None = None
) -> Index:
    """Everything retrieval needs, for all terms or only for those ``queries`` ask for."""
    if queries is None:
        postings = lexical.build_postings(chunks)
        stats = lexical.search_stats(postings, chunks)
    else:
        only = lexical.asked_terms(lexical.parse_websearch(queries))
        postings = lexical.build_postings(chunks, only)
        stats = lexical.asked_stats(chunks, only)
    return Index(chunks, ingest.embed_chunks(chunks, dim), postings, stats, dim)


def build_index(
    chunks: DataFrame, base: str, dim: int = ingest.DEFAULT_DIM, model=None, settled: bool = False
) -> tuple[str, str, str]:
    """Store everything retrieval needs below ``base``; returns the folders for ``open_index``.

    Of a document uploaded more than once the newest upload is stored. ``settled`` chunks
    are of newest uploads alone already, as ``index_store.newest_chunked`` makes them.
    """
    spark = chunks.sparkSession
    if "uploaded_at" in chunks.columns and not settled:
        chunks = index_store.only_newest(chunks)
    stored = index_store.store_chunks(chunks, base, dim, model)
    return (stored, *index_store.store_terms(index_store.read_chunks(spark, stored), base))


def open_index(
    spark: SparkSession,
    folders: tuple[str, str, str],
    dim: int = ingest.DEFAULT_DIM,
    deltas: Sequence[tuple[str, str]] = (),
) -> Index:
    """A stored index. Searching it reads texts for the reranked pool only.

    ``deltas`` name the folders of chunks and postings that streams have added to.
    """
    chunks = index_store.read_chunks(spark, folders[0])
    postings, stats = (spark.read.parquet(f) for f in folders[1:])
    if deltas:
        new = index_store.read_chunks(spark, *(c for c, _ in deltas))
        terms = index_store.read_terms(spark, *(p for _, p in deltas))
        chunks, postings, stats = index_store.with_deltas(chunks, postings, new, terms)
    vectors = chunks.select("tenant_id", "doc_id", "chunk_id", "embedding")
    return Index(chunks, vectors, postings.filter("term != ''"), stats, dim)


def compact(index: Index, base: str) -> tuple[str, str, str]:
    """Write an index and what was added to it as one new base; vectors are kept."""
    spark = index.chunks.sparkSession
    stored = index_store.store_chunks(index.chunks, base, index.dim)
    return (stored, *index_store.store_terms(index_store.read_chunks(spark, stored), base))


def dense_route(queries: DataFrame, index: Index, k: int) -> DataFrame:
    asked = ingest.embed_chunks(queries, index.dim, keys=("query_id", "tenant_id"))
    return dense.dense_topk(asked, index.vectors, k)


def lexical_route(queries: DataFrame, index: Index, k: int, match: str = "any") -> DataFrame:
    parsed = lexical.parse_websearch(queries)
    tables = lexical.only_asked(parsed, index.postings, index.stats)
    return lexical.bm25_topk(parsed, *tables, k, match)


def hybrid_search(queries: DataFrame, index: Index, k: int = 5, pool: int = 20) -> DataFrame:
    """Both routes, fused by reciprocal rank, then reranked to the best ``k`` per question."""
    fused = fusion.rrf_fuse(
        dense_route(queries, index, pool), lexical_route(queries, index, pool), k=pool
    )
    return fusion.rerank(queries, fused, index.chunks, k=k)
