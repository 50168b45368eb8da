"""Mixing sources to target weights by repeating documents.

Words are summed per source, each source gets a target, and the target over the
size is the rate at which its documents repeat: ``floor(rate)`` times, and once
more if a coin seeded by a hash falls below the fraction.

Defined results: a null text has no words. A null source is a source of its
own, the last in order. A source without words has target and rate 0. Rows that
share id and text share their coin. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.llm.common import broadcast_if_small
from findling.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix"
SMALL_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def coin(doc_id: str, text: str) -> Column:
    """A number in [0, 1) that depends on the row alone."""
    key = F.concat_ws("|", F.lit(SEED), F.col(doc_id).cast("string"), F.md5(F.col(text)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, from 0 by code point, null last, without one task for all.

    Sources are ranked within ranges, to which the counts of the ranges before are added.
    """
    ranged = written(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
            "range", F.spark_partition_id()
        ),
        "sources",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").count().select(
        "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(offsets, "range").select(
        "source", "source_size", (F.col("offset") + F.row_number().over(within) - 1).alias("place")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    All targets are ``share`` of all words. None is above ``MOST_REPEATS`` times
    its source; what stands above is shared by weight among the others, again
    until none is. Only the two sums of each round reach the driver.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("place") % len(weights) + 1).cast("int"),
    )
    weighed = written(
        ordered_sources(sizes).select(
            "source",
            "source_size",
            weight.alias("weight"),
            (F.col("source_size") * float(MOST_REPEATS)).alias("most"),
        ),
        "weights",
    )
    wanted = weighed.agg(F.sum("source_size")).first()[0] or 0
    wanted, rate, full = wanted * share, 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("weight") * F.lit(rate)
        taken, weight_left, n_full = weighed.agg(
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(is_full, 1)),
        ).first()
        if n_full == full or not weight_left:
            break
        rate, full = (wanted - taken) / weight_left, n_full
    target = F.when(is_full, F.col("most")).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "source_size", target.alias("target"))


def with_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``__coin``) with its source's figures and ``copies``."""
    held = broadcast_if_small(
        targets.withColumnRenamed("source", "__source"), SMALL_SOURCES
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(F.col("__coin") < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return (
        rows.join(held, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__rate", F.least(rate, F.lit(float(MOST_REPEATS))))
        .withColumn("copies", F.floor("__rate") + extra)
        .drop("__rate", "__source")
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``."""
    slim = written(
        docs.select(
            "doc_id", "source", n_words("text").alias("size"), coin("doc_id", "text").alias("__coin")
        ),
        "sizes",
    )
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    return with_copies(slim, targets).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, with ``copy_no`` from 1.

    A column of that name that ``docs`` brings along is replaced.
    """
    columns = [c for c in docs.columns if c != "copy_no"]
    sizes = docs.groupBy("source").agg(F.sum(n_words("text")).alias("source_size"))
    rows = docs.withColumn("__coin", coin("doc_id", "text"))
    keep = [F.col(f"__row.{c}").alias(c) for c in columns]
    shaped = rows.select(F.col("source"), "__coin", F.struct(*columns).alias("__row"))
    targets = source_targets(sizes)
    return (
        with_copies(shaped, targets)
        .filter("copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(*keep, "copy_no")
    )
