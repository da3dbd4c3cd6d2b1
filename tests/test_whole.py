"""Queries that take every row of their table."""

from __future__ import annotations

import inspect
import os
import random
from datetime import datetime, timedelta
from unittest.mock import MagicMock

import pytest

from claimloom.operators import monitoring
from claimloom.plans import queries
from claimloom.sources.testdata import Tables

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [f"{n}{end}" for n in ("phi_masking", "upsert_claims", "insert_if_absent", "merge_latest") for end in ("", "_all")])
def test_every_claim_is_processed(spark, name):
    want = sorted(r.claim_id for r in Tables(spark, PATH).claims.select("claim_id").collect())
    assert sorted(r.claim_id for r in queries.QUERIES[name](spark, PATH).select("claim_id").collect()) == want


@pytest.mark.parametrize("weight", [0.1, 0.01])
def test_moving_average_keeps_the_oldest_value(spark, weight):
    start = datetime(2024, 1, 1)
    values = [1000.0] + [None if i % 7 == 3 else float(i % 5) for i in range(1, 600)]
    rows = [(k, n, start + timedelta(minutes=k), v) for n in ("a", "b", None) for k, v in enumerate([None, *values] if n == "b" else values)]
    points = spark.createDataFrame(rows, "point_id long, name string, ts timestamp_ntz, value double")
    got = {(r.name, r.point_id): r.ema for r in monitoring.moving_average(points, weight).collect()}
    assert len(got) == len(rows)
    last, mean = object(), None
    for k, n, _, v in rows:
        mean = None if n != last else mean
        last = n
        mean = mean if v is None else v if mean is None else mean * (1 - weight) + v * weight
        assert got[n, k] == (None if mean is None else pytest.approx(mean, rel=1e-12))


def keyed_points(spark):
    rng = random.Random(5)
    start, rows, n = datetime(2024, 1, 1), [], 0
    for name, many in (("hot", 700), ("cold", 40), (None, 60)):
        at = 0.0
        for _ in range(many):
            at += rng.choice([0, 0, 1, 30, 290, 300, 3600, 90_000]) * rng.choice([0.5, 1])
            rows.append((n, name, start + timedelta(seconds=at), rng.choice([None, *range(20)]), rng.choice([None, False, True, True, True, True])))
            n += 1
    return rows, spark.createDataFrame(rows, "point_id long, name string, ts timestamp_ntz, value int, failed boolean")


def test_running_values_across_blocks_equal_plain_loops(spark):
    rows, points = keyed_points(spark)
    rolled = {r.point_id: r.rolling_avg for r in monitoring.rolling_mean(points, 7, chunk=50).collect()}
    rates = {r.point_id: r.rate for r in monitoring.trailing_rate(points, 300).collect()}
    runs = {r.point_id: r.streak for r in monitoring.streaks(points).collect()}
    assert len(rolled) == len(rates) == len(runs) == len(rows)
    for name in ("hot", "cold", None):
        own = [r for r in rows if r[1] == name]
        streak = 0
        for k, (n, _, ts, _, failed) in enumerate(own):
            known = [r[3] for r in own[max(0, k - 6) : k + 1] if r[3] is not None]
            assert rolled[n] == (pytest.approx(sum(known) / len(known)) if known else None)
            last = [r[2] for r in own if timedelta(0) <= ts - r[2] < timedelta(seconds=300)]
            assert rates[n] == pytest.approx(len(last) / max(1.0, (ts - min(last)).total_seconds()))
            streak = streak + 1 if failed else 0
            assert runs[n] == streak


def test_running_values_of_points_without_time_and_of_none(spark):
    points = spark.createDataFrame([(1, "a", None, 1, True), (2, "a", None, 3, True), (3, "a", datetime(2024, 1, 1), None, None)], "point_id long, name string, ts timestamp_ntz, value int, failed boolean")
    assert {r.point_id: r.rolling_avg for r in monitoring.rolling_mean(points).collect()} == {1: 1.0, 2: 2.0, 3: 2.0}
    assert {r.point_id: r.rate for r in monitoring.trailing_rate(points).collect()} == {1: None, 2: None, 3: 1.0}
    assert {r.point_id: r.streak for r in monitoring.streaks(points).collect()} == {1: 1, 2: 2, 3: 0}
    for run in (monitoring.rolling_mean, monitoring.trailing_rate, monitoring.streaks):
        assert run(points.limit(0)).count() == 0


def test_the_registered_forest_is_the_default_one(monkeypatch):
    seen = {}

    def train(*args, **kwargs):
        seen.update(inspect.signature(scoring_train).bind(*args, **kwargs).arguments)
        raise StopIteration

    scoring_train = queries.scoring.train
    monkeypatch.setattr(queries.scoring, "train", train)
    monkeypatch.setattr(queries.scoring, "features", lambda *tables: MagicMock())
    monkeypatch.setattr(queries.scoring, "formula_predictions", lambda x: MagicMock())
    monkeypatch.setattr(queries.F, "col", MagicMock())
    with pytest.raises(StopIteration):
        queries.rf_train_eval(MagicMock())
    assert "trees" not in seen and "depth" not in seen
