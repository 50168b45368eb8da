"""Stored percentile summaries against sorted lists."""

import datetime
import random
from bisect import bisect_left, bisect_right

import pytest

from findling.operators import summaries as s

POINTS = {"p0": 1, "p50": 500, "p95": 950, "p99": 990, "p100": 1000}
ROW = "stage string, event int, v double"


def within(values: list[float], got, error: float) -> None:
    values = sorted(values)
    n = len(values)
    assert got["n"] == n
    for name, share in POINTS.items():
        v = got[name]
        # The ranks that v has must meet those the bound allows.
        assert bisect_right(values, v) >= share / 1000 * n
        assert bisect_left(values, v) < max(share / 1000 * n + error * n, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    made = [("even", i, rnd.random()) for i in range(6000)]
    made += [("skewed", i, rnd.paretovariate(1.1)) for i in range(5000)]
    made += [("ties", i, float(rnd.randrange(4))) for i in range(4000)]
    made += [("one", 0, 7.0), (None, 0, 1.0), (None, 1, 2.0)]
    made += [("even", -1, None), ("even", -2, float("nan")), ("none", 0, None)]
    return made


def grouped(rows):
    groups = {}
    for stage, _, v in rows:
        if v is not None and v == v:
            groups.setdefault(stage, []).append(v)
    return groups


@pytest.mark.parametrize("block_rows", (s.BLOCK_ROWS, 700))
def test_within_the_proven_error(spark, rows, block_rows):
    points = s.rank_summaries(spark.createDataFrame(rows, ROW), ["stage"], "v", 50, block_rows)
    got = {r.stage: r.asDict() for r in s.merged_percentiles(points, ["stage"], POINTS).collect()}
    want = grouped(rows)
    assert set(got) == set(want)
    for stage, values in want.items():
        within(values, got[stage], 1 / 50)
    assert points.count() < len(rows) / 10


def test_batches_merge_in_any_order(spark, rows):
    batches = [s.rank_summaries(spark.createDataFrame(rows[i::3], ROW), ["stage"], "v", 50) for i in range(3)]
    merged = [
        sorted(map(tuple, s.merged_percentiles(a.unionByName(b).unionByName(c), ["stage"], POINTS).collect()), key=repr)
        for a, b, c in (batches, batches[::-1])
    ]
    assert merged[0] == merged[1]
    for row in merged[0]:
        within(grouped(rows)[row[0]], dict(zip(["n", *POINTS], row[1:])), 1 / 50)


def test_compaction_adds_its_own_error_only(spark, rows):
    points = s.rank_summaries(spark.createDataFrame(rows, ROW), ["stage"], "v", 100, 500)
    small = s.compact_summaries(points, ["stage"], 40)
    assert small.count() <= 5 * 42
    for r in s.merged_percentiles(small, ["stage"], POINTS).collect():
        within(grouped(rows)[r.stage], r.asDict(), 1 / 100 + 1 / 40)


def test_one_value_repeated_is_one_point(spark):
    df = spark.range(50_000).selectExpr("'a' AS stage", "0 AS event", "3.0D AS v")
    points = s.rank_summaries(df, ["stage"], "v", 10, 100).collect()
    assert [tuple(p) for p in points] == [("a", 3.0, 50_000)]


def test_trailing_days(spark):
    rnd = random.Random(6)
    first = datetime.date(2024, 1, 1)
    rows = [("s", first + datetime.timedelta(d), rnd.random()) for d in (0, 1, 2, 5, 9) for _ in range(200)]
    df = spark.createDataFrame(rows, "stage string, day date, v double")
    points = s.rank_summaries(df, ["stage", "day"], "v", 40)
    got = s.trailing_percentiles(points, ["stage"], "day", 4, POINTS).collect()
    assert [r.day for r in sorted(got, key=lambda r: r.day)] == sorted({d for _, d, _ in rows})
    for r in got:
        values = [v for _, d, v in rows if r.day - datetime.timedelta(3) <= d <= r.day]
        within(values, r.asDict(), 1 / 40)


def test_empty(spark):
    none = spark.createDataFrame([], ROW)
    assert s.merged_percentiles(s.rank_summaries(none, ["stage"], "v"), ["stage"], POINTS).count() == 0
