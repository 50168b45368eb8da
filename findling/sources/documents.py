"""Readers of the raw tables, and the report on their health."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling import schemas
from findling.functions.text import likely_language

EPOCH = "2024-01-01 00:00:00"
SERVICE_VERSION = "0.1.0"


def _read(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def with_document_keys(raw: DataFrame) -> DataFrame:
    """Tenant, upload time, size and type, none of which the raw table carries."""
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") * 37 % 720).cast("int"))
    return raw.select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        "lang",
        "source",
        "n_chars",
        (ntz(EPOCH) + hours).alias("uploaded_at"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.when(F.col("doc_id") % 50 == 7, "application/octet-stream")
        .otherwise("text/plain")
        .alias("mime"),
        "text",
    )


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    raw = _read(spark, folder, "documents", schemas.DOCUMENTS)
    return with_document_keys(raw)


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Raw file bytes with path, length and modification time."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length", "content")
    )


def files_digest(spark: SparkSession, folder: str, name: str) -> tuple:
    """Number, bytes, newest time and a sum over the names of a table's files, unread."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .load(f"{folder}/{name}.parquet").select("path", "length", "modificationTime")
    )
    mark = F.pmod(F.xxhash64("path", "length", "modificationTime"), F.lit(1 << 40))
    return tuple(
        files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(mark)).first()
    )


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "pages", schemas.PAGES)


def scan_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "benchmark", schemas.BENCHMARK)


def scan_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "embeddings", schemas.EMBEDDINGS)


def scan_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "conversations", schemas.CONVERSATIONS)


def with_event_keys(raw: DataFrame) -> DataFrame:
    """Tenant, role and requested action of every event."""
    user = F.col("user_id")
    roles = F.array(*[F.lit(r) for r in ("Owner", "Admin", "Member", "Viewer")])
    action = (
        F.when(F.col("event_type") == "purchase", "upload")
        .when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "signup", "manage_keys")
        .otherwise("view")
    )
    return raw.select(
        "*",
        F.concat(F.lit("src"), (user % 20).cast("string")).alias("tenant_id"),
        F.get(roles, ((user + F.floor(user / 20)) % 4).cast("int")).alias("role"),
        action.alias("action"),
    )


def scan_events(spark: SparkSession, folder: str) -> DataFrame:
    return with_event_keys(_read(spark, folder, "events", schemas.EVENTS))


def scan_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as traces of pipeline stages."""
    return _read(spark, folder, "events", schemas.EVENTS).select(
        F.col("event_type").alias("stage"),
        "ts",
        F.col("value").alias("latency"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("props").alias("args"),
    )


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark passage as a question, whole, asked within one tenant."""
    return scan_benchmark(spark, folder).select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tenant_id"),
        likely_language("text").alias("lang"),
        "text",
    )


def dataset_health(
    spark: SparkSession,
    folder: str,
    version: str = SERVICE_VERSION,
    tables: tuple[str, ...] | list[str] = schemas.TABLES,
) -> DataFrame:
    """One row per table; a table that cannot be opened is reported, not raised.

    The counts come from Parquet footers: no column is read.
    """

    def probe(name: str) -> DataFrame:
        try:
            counted = spark.read.parquet(f"{folder}/{name}.parquet").agg(
                F.count(F.lit(1)).alias("n_rows")
            )
        except AnalysisException:
            counted = spark.range(1).select(F.lit(None).cast("bigint").alias("n_rows"))
        status = (
            F.when(F.col("n_rows").isNull(), "unreachable")
            .when(F.col("n_rows") == 0, "empty")
            .otherwise("healthy")
        )
        return counted.select(
            F.lit(name).alias("table_name"),
            status.alias("status"),
            F.lit(version).alias("version"),
            "n_rows",
        )

    return reduce(DataFrame.unionByName, [probe(t) for t in tables])
