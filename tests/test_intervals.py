"""Range joins by cells, held against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from claimloom.operators import intervals


def drawn(seed, n):
    rng = random.Random(seed)
    out = [(k, rng.choice("ab"), s := rng.randint(-2000, 2000), s + rng.choice([0, 1, 3, 63, 64, 65, rng.randint(0, 3000)])) for k in range(n)]
    return out + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, None, 0, 10), (n + 3, "b", 10, 9), (n + 4, "a", 7, 7), (n + 5, "a", 7, 7)]


SCHEMA = "id int, k string, s long, e long"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_points_equal_all_pairs(spark, seed, keys):
    rng = random.Random(100 + seed)
    spans, points = drawn(seed, 120), [(k, rng.choice(["a", "b", None]), rng.choice([None, 7, 10, rng.randint(-2100, 5000)])) for k in range(150)]
    asked = spark.createDataFrame(points, "p int, k string, t long")
    own = spark.createDataFrame(spans, SCHEMA)
    asked, own = (asked, own) if keys else (asked.drop("k"), own.drop("k"))
    met = intervals.points_within(asked, F.col("t"), own, F.col("s"), F.col("e"), keys)
    want = sorted((p, i) for p, pk, t in points for i, k, s, e in spans if None not in (t, s, e) and s <= t <= e and (not keys or (k is not None and k == pk)))
    assert sorted((r.p, r.id) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlaps_equal_all_pairs(spark, seed, keys):
    spans = drawn(seed + 7, 150)
    met = intervals.overlaps(spark.createDataFrame(spans, SCHEMA), "id", F.col("s"), F.col("e"), keys)
    fits = [r for r in spans if None not in r[2:] and r[2] <= r[3]]
    want = sorted((i, j, max(s, u), min(e, v)) for i, k, s, e in fits for j, m, u, v in fits if i < j and s <= v and u <= e and (not keys or (k is not None and k == m)))
    assert sorted((r.a, r.b, r["first"], r["last"]) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_intervals(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert intervals.overlaps(none, "id", F.col("s"), F.col("e")).count() == 0
    assert intervals.points_within(spark.range(3).select(F.col("id").alias("p")), F.col("p"), none, F.col("s"), F.col("e")).count() == 0


@pytest.mark.parametrize("cell_rows", [3, 100_000])
def test_totals_equal_all_pairs(spark, cell_rows):
    rng = random.Random(7)
    spans = drawn(7, 120)
    points = [(rng.choice([None, 7, 7, 10, rng.randint(-2100, 5000)]), rng.choice([None, rng.randint(1, 9)])) for _ in range(200)]
    met = intervals.totals_within(spark.createDataFrame(points, "t long, v long"), F.col("t"), F.col("v"), spark.createDataFrame(spans, SCHEMA), "id", F.col("s"), F.col("e"), cell_rows)
    want = {}
    for i, _, s, e in spans:
        own = [v for t, v in points if None not in (t, s, e) and s <= t <= e]
        if own:
            want[i] = (len(own), sum(v for v in own if v is not None) if any(v is not None for v in own) else None)
    assert {r.id: (r.n, r.total) for r in met.collect()} == want
    empty = spark.createDataFrame([], "t long, v long")
    assert intervals.totals_within(empty, F.col("t"), F.col("v"), spark.createDataFrame([], SCHEMA), "id", F.col("s"), F.col("e")).count() == 0


def test_points_in_failures_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "points_within", None)
    assert queries()["points_in_failures"](spark, "/root/testdata/sf0.001").count() > 0
