"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from findling.session import written

ACCURACY = 10_000
# Twenty times the sketch's rank error to either side.
MARGIN = 20 / ACCURACY
# Below this the margin is under four ranks, and a group is sorted whole.
SMALL = int(4 / MARGIN)
# Rows between the two ends of a bracket that one task may sort.
INSIDE = 1_000_000
CELLS = 64
ROUNDS = 12


def _within(name: str) -> Column:
    return F.col("_v").between(F.col(f"_low_{name}"), F.col(f"_high_{name}"))


def _rank(points: dict[str, float], name: str) -> Column:
    """The wanted rank, counted from 0, with its fraction."""
    return F.lit(points[name]) * (F.col("_n") - 1)


def _first_brackets(data: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """``_n`` and a low and a high value around every point, from a mergeable sketch."""
    names = list(points)
    marks = [min(max(points[n] + side, 0.0), 1.0) for n in names for side in (-MARGIN, MARGIN)]
    found = F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), F.lit(ACCURACY))
    edges = data.groupBy(*keys).agg(found.alias("_e"), F.count(F.lit(1)).alias("_n"))
    bounds = []
    for i, name in enumerate(names):
        low, high = F.get("_e", F.lit(2 * i)), F.get("_e", F.lit(2 * i + 1))
        if marks[2 * i] == 0.0:
            low = F.lit(float("-inf"))
        if marks[2 * i + 1] == 1.0:
            high = F.lit(float("inf"))
        whole = F.col("_n") < SMALL
        bounds += [
            F.when(whole, F.lit(float("-inf"))).otherwise(low).alias(f"_low_{name}"),
            F.when(whole, F.lit(float("inf"))).otherwise(high).alias(f"_high_{name}"),
        ]
    return edges.select(*keys, "_n", *bounds)


def _counted_brackets(data: DataFrame, keys: list[str], brackets: DataFrame, names) -> DataFrame:
    """``brackets`` with the rows below and inside each; one short row per group, written so
    that Spark knows it may be broadcast."""
    counts = data.join(brackets, keys).groupBy(*keys).agg(
        *[F.count_if(F.col("_v") < F.col(f"_low_{n}")).alias(f"_below_{n}") for n in names],
        *[F.count_if(_within(n)).alias(f"_inside_{n}") for n in names],
    )
    return written(brackets.join(counts, keys), "brackets")


def _narrowed(data: DataFrame, keys: list[str], brackets: DataFrame, points) -> DataFrame:
    """Brackets moved in to the cells of the inside that surround the wanted rank."""
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    cells = data.join(brackets, keys).groupBy(*keys).agg(
        *[
            F.percentile_approx(F.when(_within(n), F.col("_v")), grid, F.lit(ACCURACY)).alias(f"_g_{n}")
            for n in points
        ]
    )
    ends = []
    for n in points:
        place = (_rank(points, n) - F.col(f"_below_{n}")) / F.col(f"_inside_{n}") * CELLS
        cell = F.floor(place).cast("int")
        low, high = F.col(f"_low_{n}"), F.col(f"_high_{n}")
        ends += [
            F.when(cell >= 2, F.get(f"_g_{n}", cell - 2)).otherwise(low).alias(f"_low_{n}"),
            F.when(cell + 3 <= CELLS, F.get(f"_g_{n}", cell + 3)).otherwise(high).alias(f"_high_{n}"),
        ]
    return brackets.join(cells, keys).select(*keys, "_n", *ends)


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    inside_rows: int = INSIDE,
) -> DataFrame:
    """Interpolated percentiles, one column per entry of ``points``.

    The built-in exact aggregate gathers all distinct values of a group in one
    task. Here a mergeable sketch brackets each wanted value; brackets that still
    hold more than ``inside_rows`` rows of more than one value are narrowed again,
    each time by aggregates alone. Rows below a bracket are only counted, those
    inside are sorted, as counted values. The sketch steers; it never decides: a
    rank outside its bracket is an error. NaN is no value here.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    names = list(points)
    edges = _counted_brackets(data, keys, _first_brackets(data, keys, points), names)
    largest = F.greatest(
        F.lit(0),
        *[
            F.when(F.col(f"_low_{n}") < F.col(f"_high_{n}"), F.col(f"_inside_{n}")).otherwise(F.lit(0))
            for n in names
        ],
    )
    before = None
    for _ in range(ROUNDS):
        most, rows = edges.agg(F.max(largest), F.sum(largest)).first()
        if not most or most <= inside_rows or rows == before:
            break
        before = rows
        edges = _counted_brackets(data, keys, _narrowed(data, keys, edges, points), names)

    bracketed = data.join(edges, keys)
    within = [F.when(_within(n), F.lit(n)) for n in names]
    inside = W.partitionBy(*keys, "_point").orderBy("_v")
    counted = (
        bracketed.select(*keys, "_v", F.explode(F.array_compact(F.array(*within))).alias("_point"))
        .groupBy(*keys, "_point", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(edges, keys)
    )

    def at_rank(name: str, rank: Column) -> Column:
        place = rank - F.col(f"_below_{name}")
        here = (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))
        return F.max(F.when((F.col("_point") == name) & here, F.col("_v")))

    def interpolated(name: str) -> Column:
        at = _rank(points, name)
        low, high = at_rank(name, F.floor(at)), at_rank(name, F.ceil(at))
        share = F.first(at - F.floor(at))
        missed = F.raise_error(F.lit(f"the rank of {name} lies outside its bracket"))
        return F.coalesce(low + share * (high - low), missed.cast("double"))

    return counted.groupBy(*keys).agg(*[interpolated(n).alias(n) for n in names])
