"""Overlap joins of intervals of any length: all pairs, never as a broadcast, few rows an interval."""

import random

import pytest

from spanloom.operators import intervals as iv


def _random(n: int, seed: int) -> list[tuple[int, int, int, int]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(-5_000, 200_000)
        rows.append((i % 3, i, s, s + rng.choice([-1, 0, 1, 10, 11, 40, 160, 640, 2_560, 10_240, 10_241, rng.randrange(100_000)])))
    return rows


@pytest.mark.parametrize(("width", "least"), [(10, 0), (10, -1), (7, 2), (100_000, 0)])
def test_all_pairs(spark, width, least):
    a, b = _random(150, 1), _random(150, 2)
    left, right = spark.createDataFrame(a, "rec long, id long, s long, e long"), spark.createDataFrame(b, "rec long, other long, s long, e long")
    found = sorted((r["rec"], r["id"], r["other"]) for r in iv.overlap_join(left, right, ["rec"], width, least).collect())
    want = sorted((r, i, j) for r, i, s, e in a for r2, j, s2, e2 in b if r == r2 and e >= s and e2 >= s2 and min(e, e2) - max(s, s2) > least)
    assert found == want


def test_no_broadcast_by_an_estimate(spark):
    rows = spark.createDataFrame([(1, 1, 0, 10)], "rec long, id long, s long, e long")
    plan = iv.overlap_join(rows, rows.withColumnRenamed("id", "other"), ["rec"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_an_interval_of_any_length(spark):
    """2,200 million widths; one row a width would be more than an array holds."""
    rows = spark.createDataFrame([(1, 1, 0, 2_200_000_000)], "rec long, id long, s long, e long")
    other = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 0, 2_200_000_000), (2, 3, 5, 6)], "rec long, other long, s long, e long")
    assert sorted(r["other"] for r in iv.overlap_join(rows, other, ["rec"], 1).collect()) == [1, 2]
