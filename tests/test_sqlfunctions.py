"""Table functions called from SQL: arguments become filters of the plan, a missing one leaves none."""

from __future__ import annotations

import pytest

from claimloom.operators import dml
from claimloom.plans import sqlfunctions
from claimloom.sources.testdata import Tables

PATH = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_argument_is_a_filter_of_the_plan(spark):
    sqlfunctions.register(Tables(spark, PATH))
    one = spark.sql("SELECT * FROM fn_facility_summary('FAC007')")
    every = spark.sql("SELECT * FROM fn_facility_summary()")
    assert [r.asDict() for r in every.where("facility_id = 'FAC007'").collect()] == [r.asDict() for r in one.collect()]
    assert every.count() == Tables(spark, PATH).facilities.count() and one.count() == 1
    assert "FAC007" in plan(one) and "FAC007" not in plan(every)
    aggregated = plan(one).split("Aggregate [facility_id")
    assert "FAC007" in aggregated[1]  # below the aggregate, so other facilities' claims aren't counted first
    month = spark.sql("SELECT * FROM fn_claims_of_month(year => 1996, month => 2)")
    assert "make_date" not in plan(month)  # folded to constants
    assert {r.last_date.isoformat() for r in month.collect()} == {"1996-02-29"}


def test_functions_can_be_joined_and_registered_again(spark):
    for _ in range(2):
        sqlfunctions.register(Tables(spark, PATH))
    both = spark.sql("SELECT s.facility_id, count(p.claim_id) AS n FROM fn_facility_summary() s LEFT JOIN fn_pending_claims(TIMESTAMP_NTZ'2001-08-02', days => 3000) p ON p.facility_id = s.facility_id GROUP BY 1")
    assert both.count() == 25
    assert spark.sql("SELECT * FROM fn_pending_claims(TIMESTAMP_NTZ'2001-08-02', 'nowhere')").count() == 0


@pytest.mark.parametrize("rows, want", [
    ([], (0, 0, 0)),
    ([("a",), ("a",), ("b",), (None,)], (1, 2, 1)),
    ([("b",), ("b",), ("c",)], (1, 2, 0)),
])
def test_a_batch_says_what_it_did(spark, rows, want):
    target = spark.createDataFrame([("b",), ("x",), (None,)], "id string")
    batch = spark.createDataFrame(rows, "id string")
    assert tuple(dml.outcome_counts(target, batch, "id").first()) == want
    assert dml.outcomes(target, batch, "id").count() == len({r[0] for r in rows})
