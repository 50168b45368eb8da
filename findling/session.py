"""Session defaults and the scratch folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "findling", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine:
    on a cluster the executors would each see their own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", ""
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="findling-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, *by: str) -> DataFrame:
    """``df`` written to the scratch folder, parted by the columns ``by``, and read back.

    Used for small results that several branches of a plan need: they are
    computed once, survive lost executors, and carry their real size, by which
    Spark decides between a broadcast and a shuffle.
    """
    target = scratch_folder(df.sparkSession, purpose)
    (df.write.partitionBy(*by) if by else df.write).parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


GROUP_BYTES = 16 << 20  # a row group of stored texts, by which scans are split
BUCKET_BYTES = 4 << 20  # one of a table laid out by bucket, by which scans are pruned


def stored_options(group_bytes: int = GROUP_BYTES) -> dict[str, str]:
    """How the files of stored tables are written."""
    return {"parquet.block.size": str(group_bytes), "compression": "zstd"}
