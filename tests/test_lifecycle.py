"""Rules as text, alerts, error classes, models, sinks and streams beyond what SQL compares."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import alerts, monitoring, registry, rules, scoring, taxonomy
from claimloom.plans import views
from claimloom.sources import generators, sinks

START = datetime(2024, 1, 1)


def test_one_rule_by_hand(spark):
    claims = spark.createDataFrame([("1", "A", 10), ("2", "B", 10), ("3", None, 60), ("4", "", None)], "claim_id string, facility_id string, total_charge int").withColumns({"facility_active": F.col("facility_id") == "A", "facility_known": F.lit(True)})
    got = {(r.claim_id, r.rule_id) for r in rules.apply(claims, rules.TEXTS).collect()}
    assert got == {("2", "FACILITY_INACTIVE"), ("1", "CHARGE_TOO_LOW"), ("2", "CHARGE_TOO_LOW")}
    assert rules.apply(claims, []).count() == 0
    own = "validation_error(C, 'R', 'f', 'm') <= claim(C), claim_attribute(C, 'facility_id', F), F == 'A', master_facility_exists(F)"
    assert [r.claim_id for r in rules.apply(claims, [own]).collect()] == ["1"]


@pytest.mark.parametrize("text", ["", "x(C) <= y(C)", "validation_error(C, 'R', 'f', 'm') <= A < 5", "validation_error(C, 'R', 'f', 'm') <= claim_attribute(C, 'facility_id', F), drop(F)", "validation_error(C, 'R', 'f', 'm') <= claim_attribute(C, 'facility_id', F); A < 5"])
def test_what_is_no_rule(text):
    with pytest.raises((ValueError, KeyError)):
        rules.condition(text)


def test_alerts_cool_down_and_resolve(spark):
    def row(minute, fired, auto=True):
        return ("r", "WARNING", "c", 10, auto, fired, f"m{minute}", START + timedelta(minutes=minute))

    kind = "rule string, severity string, component string, cooldown int, auto_resolve boolean, fired boolean, message string, checked_at timestamp_ntz"
    rows = [row(m, f) for m, f in [(0, True), (5, False), (9, True), (10, True), (21, False), (25, True)]]
    got = {(r.message, r.resolved_at, r.status) for r in alerts.lifecycle(spark.createDataFrame(rows, kind)).collect()}
    done = START + timedelta(minutes=21)
    assert got == {("m0", done, "RESOLVED"), ("m10", done, "RESOLVED"), ("m25", None, "ACTIVE")}
    kept = alerts.lifecycle(spark.createDataFrame([row(0, True, False), row(30, False, False)], kind))
    assert [r.status for r in kept.collect()] == ["ACTIVE"]
    quiet = alerts.suppress(kept, kept, START, 60).collect()
    assert [(r.status, r.suppressed_until) for r in quiet] == [("SUPPRESSED", START + timedelta(minutes=60))]
    assert alerts.lifecycle(spark.createDataFrame([], kind)).count() == 0


def test_unknown_codes_are_general_errors(spark):
    got = {r.code: (r["class"], r.auto_retry) for r in taxonomy.classified(spark.createDataFrame([("CACHE_ERROR",), ("x",), (None,)], "code string"), taxonomy.taxonomy(spark)).collect()}
    assert got == {"CACHE_ERROR": ("CacheError", True), "x": ("AppException", False), None: ("AppException", False)}


def test_models_by_version(spark, tmp_path):
    rows = [(float(k), k % 90, k % 5, k % 7, str(k % 2)) for k in range(200)]
    x = spark.createDataFrame(rows, "f_charge double, f_age int, f_diagnoses int, f_lines int, target string")
    model, rest = scoring.train(x, scoring.FEATURES, "target", trees=3, depth=3)
    assert {r.target for r in rest.collect()} == {"0", "1"} and 20 <= rest.count() <= 60
    for version, day in (("a", 5), ("b", None)):
        registry.save(model, spark, f"file://{tmp_path}", version, day and datetime(2024, 1, day), scoring.FEATURES, {})
    again, row = registry.load(spark, f"file://{tmp_path}")
    assert row["version"] == "a" and registry.load(spark, f"file://{tmp_path}", "b")[1]["training_date"] is None
    with pytest.raises(ValueError):
        registry.load(spark, f"file://{tmp_path}", "c")
    broken = spark.createDataFrame([(None, 3, 1, 1), (5.0, 3, 1, 1)], "f_charge double, f_age int, f_diagnoses int, f_lines int")
    got = [(r.predicted_filter, r.prediction, r.confidence) for r in scoring.predict_filters(again, broken).orderBy("f_charge").collect()]
    assert got[0] == ("ERROR_PREDICTION", None, 0.0) and got[1][0] == f"ML_FILTER_{got[1][1]}" and 0 < got[1][2] <= 1


def test_batches_are_numbered(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert [sinks.create_batch(spark, path, n, 5, START) for n in ("a", "b", "c")] == [1, 2, 3]


def test_lines_are_appended(spark, tmp_path):
    for _ in range(2):
        sinks.append_lines(spark.createDataFrame([(1, None)], "a int, b string"), f"file://{tmp_path}/x")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/x").collect()] == ['{"a":1,"b":null}'] * 2


def test_generated_rows_do_not_depend_on_partitions(spark):
    one, two = generators.claims(spark, 500).coalesce(1), generators.claims(spark, 500).repartition(7)
    assert sorted(one.collect()) == sorted(two.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_percentiles_by_counts(spark, n):
    rows = [(k % 2 or None, (k * 37) % 11 / 4 if k % 5 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, v double")
    groups = df.groupBy("g").agg(F.count("*").alias("n"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("a"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("b"))
    got = views.with_percentiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "v", a=0.5, b=0.95)
    assert sorted(map(str, got.select("g", "n", "a", "b").collect())) == sorted(map(str, groups.collect()))


def test_breaker_steps():
    state, met = monitoring.CLOSED, []
    for t, failed in [(0, True)] * 5 + [(1, False), (60, False), (61, False), (62, False), (63, True)]:
        seen, state = monitoring.breaker_step(state, t, failed)
        met.append(seen)
    assert met == ["CLOSED"] * 5 + ["OPEN", "HALF_OPEN", "HALF_OPEN", "HALF_OPEN", "CLOSED"] and state[:2] == ("CLOSED", 1)
