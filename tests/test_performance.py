"""Reports of operations and predictors against plain folds over the calls in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from claimloom.operators import performance

START = datetime(2024, 1, 1)
CALLS = "call_id long, ts timestamp_ntz, model_version string, batch_size int, inference_ms double, failed boolean"


def folded(calls, version):
    own = sorted((c for c in calls if c[2] == version), key=lambda c: (c[1], c[0]))
    total = batches = errors = 0
    one = many = 0.0
    done = []
    for _, ts, _, size, ms, failed in own:
        if failed:
            errors += 1
            continue
        total, batches = total + size, batches + (size > 1)
        done.append((ts, size))
        if ms is None:
            continue
        if size == 1:
            one = ms if one == 0 else one * 0.9 + ms * 0.1
        else:
            many = ms / size if many == 0 else many * 0.9 + ms / size * 0.1
    rate = 0.0
    if done:
        last = done[-1][0]
        recent = [(ts, size) for ts, size in done if ts > last - timedelta(minutes=5)]
        rate = sum(s for _, s in recent) / max((last - recent[0][0]).total_seconds(), 1.0)
    return total, batches, pytest.approx(one, abs=2e-6), pytest.approx(many, abs=2e-6), errors, pytest.approx(rate, abs=2e-6), done[-1][0] if done else None


def held(spark, calls):
    out = performance.predictor(spark.createDataFrame(calls, CALLS)).collect()
    return {r.model_version: (r.total_predictions, r.batch_predictions, r.avg_inference_ms, r.avg_batch_inference_ms, r.error_count, r.predictions_per_second, r.last_prediction) for r in out}


def test_a_predictor_folds_its_calls(spark):
    rng = random.Random(4)
    calls = [(k, START + timedelta(seconds=rng.randrange(20_000)), rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 1, 7]), rng.choice([0.0, 3.5, None, rng.random() * 90]), rng.random() < 0.1) for k in range(900)]
    calls += [(k, START, "zeros first", 1, 0.0, False) for k in range(1000, 1003)] + [(1003, START, "zeros first", 1, 8.0, False), (1004, START, "zeros first", 1, 0.0, False)]
    calls += [(2000, START, "only errors", 1, 5.0, True), (2001, START, "not measured", 4, None, False)]
    got = held(spark, calls)
    assert got == {v: folded(calls, v) for v in {c[2] for c in calls}}
    assert got["zeros first"][2] == pytest.approx(7.2) and got["only errors"][:5] == (0, 0, 0.0, 0.0, 1)
    assert held(spark, []) == {}


def test_operations_and_windows(spark):
    schema = "operation string, ts timestamp_ntz, seconds decimal(12,2), items int, failed boolean"
    rows = [("a", START, "2.00", 3, False), ("a", START - timedelta(seconds=59), "1.00", 1, True), ("a", START - timedelta(seconds=60), "9.00", 9, False), ("a", START + timedelta(seconds=1), "9.00", 9, False), ("b", START, None, 2, False), ("c", START - timedelta(days=9), "1.00", 1, False)]
    df = spark.createDataFrame([(o, t, s and float(s), i, f) for o, t, s, i, f in rows], schema.replace("decimal(12,2)", "double")).selectExpr("operation", "ts", "cast(seconds as decimal(12,2)) seconds", "items", "failed")
    stats = {r.operation: (r.total_count, float(r.total_seconds), r.error_count, r.error_rate, r.avg_ms) for r in performance.operations(df).collect()}
    assert stats == {"a": (4, 21.0, 1, 0.25, 5250.0), "b": (1, 0.0, 0, 0.0, 0.0), "c": (1, 1.0, 0, 0.0, 1000.0)}
    got = {(r.operation, r.window): (r["items"], float(r.seconds), r.rate) for r in performance.throughput(df, START, {"minute": 60, "hour": 3600}).collect()}
    assert got == {("a", "minute"): (4, 3.0, 1.333333), ("a", "hour"): (13, 12.0, 1.083333), ("b", "minute"): (2, 0.0, 0.0), ("b", "hour"): (2, 0.0, 0.0), ("c", "minute"): (0, 0.0, 0.0), ("c", "hour"): (0, 0.0, 0.0)}
    assert performance.throughput(df.limit(0), START, {"minute": 60}).count() == performance.operations(df.limit(0)).count() == 0
