"""Machines over blocks of time, held against a plain fold."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import machines, monitoring

START = datetime(2024, 1, 1)
ROWS = "name string, ts timestamp_ntz, failed boolean, point_id long"


def rows_of(seed, n, gap, keys=("a", "b", None)):
    rng, out, now = random.Random(seed), [], {k: START for k in keys}
    for k in range(n):
        key = keys[0] if rng.random() < 0.8 else rng.choice(keys)
        now[key] += timedelta(seconds=rng.choice([0, 0, 1, gap, gap, 3 * gap, 40 * gap if rng.random() < 0.1 else 1]))
        out.append((key, now[key], rng.random() < rng.choice([0.1, 0.9]), k))
    return out


def folded(rows, threshold, seconds):
    out, state = {}, {}
    for name, t, failed, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        seen, state[name] = monitoring.breaker_step(state.get(name, monitoring.CLOSED), t.timestamp(), failed, threshold, seconds)
        out[k] = seen
    return out


def sent(rows, seconds):
    out, last = set(), {}
    for name, t, _, k in sorted(rows, key=lambda r: (str(r[0]), r[1], r[3])):
        if name not in last or (t - last[name]).total_seconds() >= seconds:
            last[name] = t
            out.add(k)
    return out


@pytest.mark.parametrize(("seed", "gap", "block"), [(1, 5, 60), (2, 20, 60), (3, 45, 200), (4, 2, 61), (5, 90, None)])
def test_breakers_equal_a_fold(spark, seed, gap, block):
    rows = rows_of(seed, 700, gap)
    got = monitoring.breaker(spark.createDataFrame(rows, ROWS), threshold=3, timeout_seconds=60, block_seconds=block).collect()
    assert {r.point_id: r.state for r in got} == folded(rows, 3, 60) and len(got) == len(rows)
    assert {r.point_id: r.key for r in got} == {r[3]: r[0] for r in rows}


@pytest.mark.parametrize(("seed", "gap", "block"), [(6, 7, 60), (7, 61, 60), (8, 1, 300), (9, 25, 75), (10, 400, None)])
def test_cooldowns_equal_a_fold(spark, seed, gap, block):
    rows = rows_of(seed, 700, gap)
    got = [r.point_id for r in monitoring.cooldown(spark.createDataFrame(rows, ROWS), 1, block_seconds=block).collect()]
    assert sorted(got) == sorted(sent(rows, 60))


def test_odd_rows(spark):
    rows = [("a", None, True, 1), ("a", START, None, 2), ("a", START, None, 2), (None, START, True, 3)]
    got = monitoring.breaker(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((str(r.key), r.point_id, r.state) for r in got) == [("None", 3, "CLOSED"), ("a", 2, "CLOSED"), ("a", 2, "CLOSED")]
    assert monitoring.cooldown(spark.createDataFrame([], ROWS), 1).count() == 0


def test_one_key_spreads_over_tasks(spark):
    """All rows of one key: no task of the last stage has more than its blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("a", START + timedelta(minutes=k), False, k) for k in range(4000)]
    out = machines.run(spark.createDataFrame(rows, ROWS), machines.cooling(600_000_000), F.col("name"), F.col("ts"), F.col("failed"), F.col("point_id"), width=6_000_000_000)
    sizes = [r["count"] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000
    assert out.where("met >= 0").count() == 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

