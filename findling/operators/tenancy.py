"""Tenant scoping, isolation checks and permissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which role may do what.
PERMISSIONS = {
    "Owner": ("upload", "delete", "view", "manage_keys"),
    "Admin": ("upload", "delete", "view"),
    "Member": ("upload", "view"),
    "Viewer": ("view",),
}


class TenantView:
    """The only way to a table: every one is filtered on the tenant it was opened for.

    ``reader`` maps a table name to a DataFrame. The filter sits directly on the
    scan, so it reaches the files and prunes partitions laid out by tenant.
    """

    def __init__(
        self, spark: SparkSession, tenant_id: str, reader: Callable[[SparkSession, str], DataFrame]
    ) -> None:
        if not tenant_id:
            raise ValueError("a tenant view needs a tenant id")
        self._spark, self._tenant, self._reader = spark, tenant_id, reader

    def table(self, name: str) -> DataFrame:
        df = self._reader(self._spark, name)
        if "tenant_id" not in df.columns:
            raise ValueError(f"table {name} carries no tenant_id")
        return df.filter(F.col("tenant_id") == F.lit(self._tenant))


def metadata_filter(
    df: DataFrame,
    tenant_id: str,
    languages: list[str] | None = None,
    sources: list[str] | None = None,
    chars: tuple[int, int] | None = None,
) -> DataFrame:
    """Tenant and metadata predicates, applied before any retrieval."""
    df = df.filter(F.col("tenant_id") == tenant_id)
    if languages:
        df = df.filter(F.col("lang").isin(*languages))
    if sources:
        df = df.filter(F.col("source").isin(*sources))
    if chars:
        df = df.filter(F.col("n_chars").between(*chars))
    return df


def isolation_audit(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: hits checked, and hits not proven to stay within a tenant (must be 0).

    A hit whose chunk or question is unknown, or has no tenant, is a leak.
    """
    owner = chunks.select("chunk_id", F.col("tenant_id").alias("chunk_tenant"))
    asker = queries.select("query_id", F.col("tenant_id").alias("query_tenant"))
    same = F.coalesce(F.col("chunk_tenant") == F.col("query_tenant"), F.lit(False))
    foreign = (~same).cast("bigint")
    return (
        hits.select("query_id", "chunk_id")
        .join(asker, "query_id", "left")
        .join(owner, "chunk_id", "left")
        .agg(
            F.count(F.lit(1)).alias("n_hits"),
            F.coalesce(F.sum(foreign), F.lit(0).cast("bigint")).alias("n_leaks"),
        )
    )


def permission_table(spark: SparkSession) -> DataFrame:
    """The grants as an inline table, whose size Spark knows: joins with it broadcast."""
    rows = [f"('{role}', '{a}')" for role, actions in PERMISSIONS.items() for a in actions]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS grants(role, action)")


def authorize(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Append ``allowed``: whether the role was granted the action."""
    grants = permissions.distinct().withColumn("granted", F.lit(True))
    return (
        requests.join(grants, ["role", "action"], "left")
        .withColumn("allowed", F.coalesce("granted", F.lit(False)))
        .drop("granted")
    )


def denied_requests(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    return requests.join(permissions, ["role", "action"], "left_anti")
