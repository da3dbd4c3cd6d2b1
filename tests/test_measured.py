"""Runs that measure themselves, and quantiles without one task for all rows."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import measured, monitoring, scoring


def test_a_run_is_counted_and_timed(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    for number in range(2):
        recorder = measured.Recorder(spark, str(tmp_path / "m"), datetime(2024, 1, 1 + number), job="x")
        points = measured.measured(recorder, "load", rows, lambda df, n=number: df.write.parquet(str(tmp_path / f"out{n}")), odd=F.count_if("odd"))
    assert points.where("name = 'load_seconds' and type = 'timer' and value >= 0").count() == 2
    held = {r.metric: (r.kind, int(r.value), r.n) for r in monitoring.metric_state(points.where("type <> 'timer'")).collect()}
    assert held == {"load_rows{job=x}": ("counter", 200, 2), "load_odd{job=x}": ("counter", 100, 2)}
    with pytest.raises(ZeroDivisionError), recorder.timed("bad"):
        1 / 0
    assert recorder.save().where("name = 'bad_failed' and value = 1").count() == 1


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    for values in ([1.0], [3.0, 1.0], [rng.gauss(0, 1e6) for _ in range(501)], [rng.choice([0.1, 0.2, 7e9]) for _ in range(400)], [float(k) for k in range(1000)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        for share in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert np.isclose(scoring.exact_quantile(df, "v", share, buckets=8), np.quantile(values, share), rtol=1e-12)
    none = spark.createDataFrame([], "v double, c string")
    assert scoring.exact_quantile(none, "v", 0.5) is None and scoring.most_frequent(none, "c") is None
    assert scoring.most_frequent(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string"), "c") == "a"
