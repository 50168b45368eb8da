"""Whether two rankers differ: seeded resampling of the questions they were judged on.

For every pair of rankers a Poisson bootstrap gives an interval of the mean difference
and a paired permutation test its p-value. Weights and signs come from a digest of seed,
resample and question, so any task draws the same ones, and no question is collected:
questions meet the resamples as rows, which are added up within tasks before a shuffle
of one row per pair and resample. Scores count in millionths, so sums are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions.text import steady

RESAMPLES, SEED, COVERED = 1000, 7, 0.95
UNIT = 1_000_000
#: The chance that a Poisson number of mean one is at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def paired_differences(per_query: DataFrame, metric: str) -> DataFrame:
    """``query_id, a, b, d``: millionths by which ``a`` beats ``b``, of rankers in order of name.

    A question that one of the two was not judged on says nothing about the pair.
    """
    score = F.round(F.col(metric) * UNIT).cast("bigint")
    both = "transform(filter(all, y -> y.method > x.method), y -> struct(x.method AS a, y.method AS b, x.s - y.s AS d))"
    return (
        per_query.filter(F.col(metric).isNotNull())
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("method", score.alias("s"))).alias("all"))
        .select("query_id", F.explode(F.expr(f"flatten(transform(all, x -> {both}))")).alias("p"))
        .select("query_id", "p.*")
    )


def _drawn(seed: int) -> tuple[Column, Column]:
    """Poisson weight and sign of a question in a resample."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("query_id").cast("string")))
    chance = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    weight = sum((chance >= F.lit(p)).cast("bigint") for p in POISSON)
    sign = 1 - 2 * (F.conv(F.substring(digest, 14, 1), 16, 10).cast("bigint") % 2)
    return weight, sign


def compare_pairs(
    per_query: DataFrame,
    metric: str = "ndcg",
    resamples: int = RESAMPLES,
    seed: int = SEED,
    covered: float = COVERED,
) -> DataFrame:
    """``a, b, n_queries, difference, low, high, p_value`` of every pair of rankers.

    ``per_query`` holds ``method, query_id`` and the metric. ``low`` and ``high`` are
    those order statistics of the bootstrap's means; ``p_value`` counts the permutations
    whose sum is as far from zero as the one observed, itself included.
    """
    pairs = paired_differences(per_query, metric)
    observed = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("d").alias("total"))
    weight, sign = _drawn(seed)
    drawn = (
        pairs.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("w", weight)
        .groupBy("a", "b", "r")
        .agg(F.sum(F.col("w") * F.col("d")).alias("wd"), F.sum("w").alias("w"), F.sum(sign * F.col("d")).alias("sd"))
    )
    mean = F.when(F.col("w") > 0, F.col("wd") / F.col("w") / UNIT)
    extreme = F.abs("sd") >= F.abs("total")
    tail = (1 - covered) / 2
    at = lambda q: F.get("means", F.greatest(F.ceil(F.size("means") * F.lit(q)) - 1, F.lit(0)).cast("int"))
    return (
        drawn.join(observed, ["a", "b"])
        .groupBy("a", "b", "n_queries", "total")
        .agg(F.sort_array(F.collect_list(mean)).alias("means"), F.count_if(extreme).alias("n_extreme"))
        .select(
            "a", "b", "n_queries",
            steady(F.col("total") / F.col("n_queries") / UNIT).alias("difference"),
            steady(at(tail)).alias("low"), steady(at(1 - tail)).alias("high"),
            steady((F.col("n_extreme") + 1) / F.lit(float(resamples + 1))).alias("p_value"),
        )
    )
