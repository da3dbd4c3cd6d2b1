"""Steps that have to grow no faster than their input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import monitoring, scoring
from claimloom.sources.testdata import Tables
from claimloom.streaming import jobs


def test_rates_equal_plain_counts_and_sum_no_frames(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, start + timedelta(seconds=rng.choice([0, 300, 3600, rng.randint(0, 9000)]))])) for k in range(300)]
    points = spark.createDataFrame(rows, "point_id long, name string, ts timestamp_ntz")
    rated = monitoring.trailing_rate(points)
    want = {}
    for k, name, ts in rows:
        own = [t for _, n, t in rows if ts is not None and n == name and t is not None and ts - timedelta(seconds=300) < t <= ts]
        want[k] = len(own) / max((ts - min(own)).total_seconds(), 1.0) if own else None
    assert {r.point_id: r.rate for r in rated.collect()} == pytest.approx(want)
    assert "specifiedwindowframe(RangeFrame" not in rated._jdf.queryExecution().optimizedPlan().toString()


class State:
    exists = hasTimedOut = False

    def update(self, now):
        self.now = now

    def setTimeoutTimestamp(self, at):
        self.at = at

    def getCurrentWatermarkMs(self):
        return 0


def test_a_keys_states_go_back_in_parts(spark, monkeypatch):
    taken = {}

    def take(self, follow, *args):
        taken["follow"] = follow
        raise StopIteration

    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *a: type("G", (), {"applyInPandasWithState": take})())
    with pytest.raises(StopIteration):
        jobs.breaker_stream(Tables(spark, "/root/testdata/sf0.001"))
    rng = random.Random(5)
    calls = [(float(k // 2), rng.random() < 0.6, k) for k in range(500)]
    frames = [pd.DataFrame(calls[i::5], columns=["t", "failed", "point_id"]) for i in range(5)]
    monkeypatch.setattr(jobs, "OUT_ROWS", 64)
    state = State()
    out = list(taken["follow"](("a",), iter(frames), state))
    now, want = monitoring.CLOSED, []
    for t, bad, k in calls:
        seen, now = monitoring.breaker_step(now, t, bad)
        want.append((k, seen))
    assert len(out) == 8 and max(map(len, out)) == 64
    assert [(k, s) for frame in out for k, s in zip(frame["point_id"], frame["state"], strict=True)] == want and state.now == now


def test_the_same_rows_make_the_same_forest(spark, monkeypatch):
    monkeypatch.setattr(scoring, "ROWS_A_TASK", 100, raising=False)
    rows = [(float(k * 37 % 101), k % 90, k % 5, k % 7, str(k * k % 3)) for k in range(600)]
    x = spark.createDataFrame(rows, "f_charge double, f_age int, f_diagnoses int, f_lines int, target string")
    forests = [scoring.train(df, scoring.FEATURES, "target", trees=3, depth=5)[0].stages[-1] for df in (x, x.orderBy(F.desc("f_charge")).repartition(7))]
    assert forests[0].toDebugString.split("\n", 1)[1] == forests[1].toDebugString.split("\n", 1)[1]
    assert forests[0].getCacheNodeIds()
