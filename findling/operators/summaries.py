"""Percentiles from summaries that are stored per group and merged later.

A block of ``n`` values is sorted and cut into runs of ``step = max(1, n div one_in)``;
of each run the largest value is kept, with the number of values it stands for. Summaries
merge by putting their points together, in any order and at any time.

Error, for any set of blocks with ``N`` values in all: a run counts as "at most v" only
once all of it is, so the summed weights fall short of the true count by less than one
run a block, ``N / one_in`` together. A reported percentile ``q`` therefore has a true
rank between ``q * N`` and ``(q + 1 / one_in) * N``. ``compact_summaries`` adds the same
again with its own ``one_in``. Blocks of ``one_in`` values or fewer are exact.

A group larger than ``block_rows`` is cut into blocks by a hash, so no task sorts more
than about that many values of one group. Merging sorts points, about ``one_in`` a block.

Defined results: nulls and NaN are no values; a group without values has no summary;
equal values count each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findling.session import written

ONE_IN = 1000
BLOCK_ROWS = 1_000_000


def _hash_of_row(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def rank_summaries(
    df: DataFrame,
    keys: list[str],
    value: str,
    one_in: int = ONE_IN,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(*keys, value, weight)``: the points of one block or more per group.

    Rows equal in every column are counted first, within each task, and fall into one
    block; what a block sorts are its different values.
    """
    number = F.col(value).cast("double")
    data = df.select(*keys, number.alias("value"), _hash_of_row(df).alias("_h")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    # Equal rows are counted within each task before anything is sorted.
    data = data.groupBy(*keys, "value", "_h").agg(F.count(F.lit(1)).alias("_c"))
    blocks = data.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_blocks"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    dealt = (
        data.alias("d")
        .join(written(blocks, "blocks").alias("b"), same)
        .select("d.*", F.pmod(F.col("_h"), F.col("_blocks")).alias("_block"))
    )
    counted = dealt.groupBy(*keys, "_block", "value").agg(F.sum("_c").alias("_c"))
    block = W.partitionBy(*keys, "_block")
    upto = block.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.select(
        *keys, "_block", "value", "_c", F.sum("_c").over(upto).alias("_to"), F.sum("_c").over(block).alias("_n")
    )
    return _cut(ranked, keys, ["_block"], F.greatest(F.lit(1), F.floor(F.col("_n") / one_in)))


def _cut(ranked: DataFrame, keys: list[str], within: list[str], step: Column) -> DataFrame:
    """The values at which a run of ``step`` ends, each with what came since the one before."""
    ends = ranked.withColumn("_step", step).filter(
        (F.floor(F.col("_to") / F.col("_step")) > F.floor((F.col("_to") - F.col("_c")) / F.col("_step")))
        | (F.col("_to") == F.col("_n"))
    )
    before = F.lag("_to", 1, 0).over(W.partitionBy(*keys, *within).orderBy("value"))
    return ends.select(*keys, "value", (F.col("_to") - before).cast("bigint").alias("weight"))


def _ranked(points: DataFrame, keys: list[str]) -> DataFrame:
    merged = points.groupBy(*keys, "value").agg(F.sum("weight").alias("_c"))
    group = W.partitionBy(*keys)
    upto = group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return merged.select(
        *keys, "value", "_c", F.sum("_c").over(upto).alias("_to"), F.sum("_c").over(group).alias("_n")
    )


def compact_summaries(points: DataFrame, keys: list[str], one_in: int = ONE_IN) -> DataFrame:
    """One summary of about ``one_in`` points per group in place of those of many blocks."""
    return _cut(_ranked(points, keys), keys, [], F.greatest(F.lit(1), F.floor(F.col("_n") / one_in)))


def merged_percentiles(points: DataFrame, keys: list[str], per_mille: dict[str, int]) -> DataFrame:
    """``(*keys, n, <one column per entry>)``: the first kept value whose summed weight reaches
    so many thousandths of the group."""
    reached = lambda share: F.col("_to") * 1000 >= F.col("_n") * share
    return _ranked(points, keys).groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.min(F.when(reached(share), F.col("value"))).alias(name) for name, share in per_mille.items()],
    )


def trailing_percentiles(
    points: DataFrame, keys: list[str], day: str, days: int, per_mille: dict[str, int]
) -> DataFrame:
    """``(*keys, day, n, ...)``: percentiles of the last ``days`` days up to each day that has
    a summary, from the points alone."""
    own = points.select(*keys, day).distinct()
    ahead = F.sequence(F.lit(0), F.lit(days - 1))
    served = points.select(*keys, "value", "weight", day, F.explode(ahead).alias("_ahead"))
    served = served.withColumn(day, F.date_add(day, F.col("_ahead"))).groupBy(*keys, day, "value").agg(
        F.sum("weight").alias("weight")
    )
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, day]]
    kept = served.alias("s").join(written(own, "summary-days").alias("o"), same, "left_semi")
    return merged_percentiles(kept, [*keys, day], per_mille)
