"""Small golden cases."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.functions import columns as fn
from claimloom.operators import dml, failed, monitoring, pricing, scoring
from claimloom.params import resolve
from claimloom.sources import readers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first().x


def test_pricing_guards(spark):
    lines = spark.createDataFrame([("a", 1, "99213", 1), ("a", 2, "XXXXX", 1), ("a", 3, "99213", 0), ("a", 4, "", 1), ("a", 5, None, 1), ("a", 6, "G0008", None)], "claim_id string, line_number int, cpt_code string, units int")
    rvu = spark.createDataFrame([("99213", Decimal("1.30")), ("G0008", Decimal("0.50"))], "cpt_code string, rvu_value decimal(10,2)")
    priced = pricing.price_lines(lines, rvu)
    got = {r.line_number: (r.pricing_status, r.amount) for r in priced.collect()}
    zero = Decimal("0.00")
    assert got == {1: ("CALCULATED_OK", Decimal("46.85")), 2: ("RVU_NOT_FOUND", zero), 3: ("INVALID_UNITS", zero), 4: ("CPT_CODE_MISSING", zero), 5: ("CPT_CODE_MISSING", zero), 6: ("CALCULATED_OK", Decimal("18.02"))}
    claims = spark.createDataFrame([("a",), ("b",)], "claim_id string")
    assert {r.claim_id: r.reimbursement for r in pricing.price_claims(claims, priced).collect()} == {"a": Decimal("64.87"), "b": zero}


def test_amounts_by_line(spark):
    lines = spark.createDataFrame([(1,), (2,), (3,)], "line_number int")
    assert [r.amount for r in pricing.merge_amounts(lines, {1: "150.25", 2: "190.75"}).orderBy("line_number").collect()] == [Decimal("150.25"), Decimal("190.75"), None]


@pytest.mark.parametrize(("kind", "value", "want"), [
    ("ssn", "123456789", "***-**-6789"), ("ssn", "1234", "****"), ("dob_year", "1980-05-06", "1980-XX-XX"), ("dob_year", "x", "XXXX-XX-XX"), ("name", "Ada", "A***a"), ("name", "A", "A****"),
    ("account_number", "ACC0001", "********0001"), ("account_number", "1234", "****"), ("generic", "abc", "abc"), ("generic", "abcd", "****"), ("name", "", ""), ("name", None, None),
])
def test_masks(spark, kind, value, want):
    assert one(spark, fn.mask("c", kind), value) == want


@pytest.mark.parametrize("text", ["plain", "", None, "(x)", "encrypted(", "ünï"])
def test_wrapping_round_trip(spark, text):
    assert one(spark, fn.unwrapped(fn.wrapped("c")), text) == text


def test_boundaries_count_crossings(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:59' a, TIMESTAMP_NTZ'2024-01-01 00:01:00' b").select(fn.boundaries("MINUTE", F.col("a"), F.col("b")).alias("x"))
    assert row.first().x == 1


def test_settings_expand():
    assert resolve({"a": ["${X:-1}", "${Y}"], "b": 2}, {"Y": "z"}) == {"a": ["1", "z"], "b": 2}


def test_repairs(spark):
    rows = spark.createDataFrame([(1, "a", "F1", "VAL_FAC_001", "x"), (2, "b", None, "Z", "Patient Account Number is missing."), (3, "c", "F", "Z", "x")], "failed_id long, original_claim_id string, facility_id string, error_codes string, error_messages string")
    got = {(r.failed_id, r.field_to_correct, r.confidence) for r in failed.suggest_repairs(rows).collect()}
    assert got == {(1, "facility_id", 0.7), (2, "patient_account_number", 0.9)}
    options = {r.field_to_correct: r.suggested_value_options for r in failed.suggest_repairs(rows).collect()}
    assert options == {"facility_id": ["FAC001_VALID", "FAC002_VALID"], "patient_account_number": None}


def test_pages_reject_bad_arguments(spark):
    rows = spark.createDataFrame([(1, "New")], "failed_id long, status string")
    with pytest.raises(ValueError):
        failed.failed_page(rows, sort_by="missing")
    with pytest.raises(ValueError):
        failed.failed_page(rows, sort_by="status", limit=501)


def points(spark, values):
    rows = [(k, "n", datetime(2024, 1, 1, 0, k // 60, k % 60), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "point_id long, name string, ts timestamp_ntz, failed boolean")


def test_breaker_opens_and_closes(spark):
    calls = [True] * 5 + [False] * 70
    got = [r.state for r in monitoring.breaker(points(spark, calls), threshold=5, timeout_seconds=60).orderBy("point_id").collect()]
    assert got[:5] == ["CLOSED"] * 5 and got[5:64] == ["OPEN"] * 59 and got[64:67] == ["HALF_OPEN"] * 3 and set(got[67:]) == {"CLOSED"}


def test_streaks(spark):
    assert [r.streak for r in monitoring.streaks(points(spark, [True, True, False, True])).orderBy("point_id").collect()] == [1, 2, 0, 1]


def test_cooldown(spark):
    got = [r.point_id for r in monitoring.cooldown(points(spark, [True] * 130), 1).orderBy("point_id").collect()]
    assert got == [0, 60, 120]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (10.0, "b")], "x double, y string")
    got = [tuple(r) for r in scoring.impute(df, ["x", "z"], ["y", "w"]).collect()]
    assert got == [(1.0, "a", 0.0, "UNKNOWN"), (3.0, "b", 0.0, "UNKNOWN"), (3.0, "b", 0.0, "UNKNOWN"), (10.0, "b", 0.0, "UNKNOWN")]


def test_empty_tables_give_empty_results(spark):
    empty = spark.createDataFrame([], "claim_id string, status string, created_date timestamp_ntz, claim_key long, facility_id string")
    assert readers.pending(empty, 5).count() == 0
    assert dml.insert_absent(empty, empty, ["claim_id"]).count() == 0


def test_rvu_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("cpt_code,description,rvu_value\n1,x,1.5\n2,y,\n3,z,NaN\n")
    assert [tuple(r) for r in readers.read_rvu_csv(spark, str(tmp_path / "r.csv")).collect()] == [("1", "x", Decimal("1.50"))]
