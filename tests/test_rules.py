"""Rules over facts, and the texts of validation errors."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from claimloom.operators import datalog, rules, validation
from claimloom.params import Params
from claimloom.plans.rulesets import DERIVED, OVER_LINES, RECURSIVE
from claimloom.sources.testdata import Tables

PATH = "/root/testdata/sf0.001"
CLAIM = "claim_id string, facility_id string, financial_class_id string, account string, service_date date, end_date date, total_charge int, earlier array<string>"
# What each check says, word by word.
SAID = {
    "a": ["CORE_FAC_01|facility_id|Facility ID is missing.", "CORE_PAT_01|patient_account_number|Patient Account Number is missing or empty.", "CORE_DATE_01|service_date|Claim service_date is missing.", "CORE_FC_01|financial_class_id|Financial Class ID is missing."],
    "b": ["CORE_FAC_02|facility_id|Facility ID 'FAC003' not found or is inactive.", "CORE_DATE_02|service_date|Claim service_date cannot be in the future.", "FACILITY_INACTIVE|facility_id|Facility ID on claim does not exist or is inactive", "CHARGE_TOO_HIGH|total_charge_amount|Total charge amount is over 20000"],
    "c": ["CORE_FC_03|financial_class_id|Financial Class 'FC1_002' not valid for facility 'FAC001'.", "CHARGE_TOO_LOW|total_charge_amount|Total charge amount is less than 50"],
    "d": [],
    "e": ["CORE_FAC_01|facility_id|Facility ID is missing.", "OLD|x|kept in front", "CORE_FC_01|financial_class_id|Financial Class ID is missing."],
}


def test_messages(spark):
    day = date(2001, 5, 1)
    rows = [
        ("a", "", None, "  ", None, None, 100, None), ("b", "FAC003", "FC1_003", "x", date(2002, 1, 1), None, 20001, []), ("c", "FAC001", "FC1_002", "x", day, day, 49, None),
        ("d", "FAC001", "FC1_001", "x", day, date(2001, 4, 1), 50, None), ("e", None, "", "x", day, None, 60, ["CORE_FAC_01|facility_id|Facility ID is missing.", "OLD|x|kept in front"]),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    t = Tables(spark, PATH)
    done = {r.claim_id: r for r in validation.validate(t, claims, Params(), existing="earlier").collect()}
    assert {k: r.errors for k, r in done.items()} == SAID
    assert {k for k, r in done.items() if r.is_valid} == {"d"} and done["d"].warnings == ["CORE_DATE_03|end_date|End date is before the service date."]
    assert {k: (r.facility_validated, r.financial_class_validated) for k, r in done.items()} == {"a": (False, False), "b": (False, False), "c": (True, False), "d": (True, True), "e": (False, False)}


def test_rules_are_split(spark):
    plain, joined = rules.split(rules.TEXTS + OVER_LINES + DERIVED + RECURSIVE)
    assert plain == rules.TEXTS and joined == OVER_LINES + DERIVED + RECURSIVE


def closure(edges):
    found = set(edges)
    while True:
        more = {(a, d) for a, b in found for c, d in edges if b == c} - found
        if not more:
            return found
        found |= more


def test_recursion_equals_a_plain_closure(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(22)}
    facts = {"edge": spark.createDataFrame(sorted(edges), "a string, b string"), "node": spark.createDataFrame([(f"n{k}",) for k in range(15)], "a string")}
    linear = ["path(X, Y) <= edge(X, Y)", "path(X, Z) <= path(X, Y), edge(Y, Z)"]
    double = ["path(X, Y) <= edge(X, Y)", "path(X, Z) <= path(X, Y), path(Y, Z)"]
    want = closure(edges)
    for texts in (linear, double):
        assert {tuple(r) for r in datalog.evaluate(texts, facts, "path").collect()} == want
    apart = [*linear, "apart(X, Y) <= link(X, Y), ~path(X, Y)", "link(X, Y) <= path(X, Z), path(Y, Z)"]
    assert {tuple(r) for r in datalog.evaluate(apart, facts, "apart").collect()} == {(a, c) for a, b in want for c, d in want if b == d} - want
    loop = ["on(X) <= path(X, X)", *linear]
    assert {r[0] for r in datalog.evaluate(loop, facts, "on").collect()} == {a for a, b in want if a == b}
    mutual = ["odd(X, Y) <= edge(X, Y)", "even(X, Z) <= odd(X, Y), edge(Y, Z)", "odd(X, Z) <= even(X, Y), edge(Y, Z)", "even(X, X) <= node(X)"]
    got = {tuple(r) for r in datalog.evaluate(mutual, facts, "even").collect()}
    even, odd = {(f"n{k}", f"n{k}") for k in range(15)}, set()
    for _ in range(60):
        odd |= {(a, d) for a, b in even for c, d in edges if b == c}
        even |= {(a, d) for a, b in odd for c, d in edges if b == c}
    assert got == even


def test_constants_numbers_and_empty_relations(spark):
    facts = {"p": spark.createDataFrame([("a", 1, "7"), ("a", 2, "x"), ("b", 2, None), ("it's", 3, "8.5")], "k string, n int, v string"), "q": spark.createDataFrame([], "k string")}
    rows = lambda text, want="h": sorted(map(tuple, datalog.evaluate([text], facts, want).collect()), key=str)
    assert rows("h(X, 'lit', 5) <= p(X, 2, _)") == [("a", "lit", 5), ("b", "lit", 5)]
    assert rows("h(X, V) <= p(X, _, V), V > 7") == [("it's", "8.5")]  # what isn't a number compares as unknown
    assert rows("h(X, N) <= p(X, N, _), ~q(X), N >= 2") == [("it's", 3), ("a", 2), ("b", 2)]
    assert rows("h(X) <= p(X, N, _), q(X)") == []
    assert datalog.evaluate([], facts, datalog.ERRORS, 4).count() == 0


@pytest.mark.parametrize("texts", [
    ["h(X) <= ~p(X, _, _)"], ["h(Y) <= p(X, _, _)"], ["h(X) <= p(X, _, _), q(Y)"], ["h(X) <= r(X)"], ["h(X) <= p(X, N, _), M < 3"], ["h(X) <= q(X), ~h(X)"], ["h(X <= q(X)"], ["h(X) <= q(X) q(X)"], ["h(X) <= h(X)"], ["h(X) <= p(X)"], ["h(_) <= q(X)"], ["h(X) <= q(X), ??"],
])
def test_what_is_no_rule_is_refused(spark, texts):
    facts = {"p": spark.range(1).selectExpr("'a' AS k", "1 AS n", "'v' AS v"), "q": spark.range(1).selectExpr("'a' AS k")}
    with pytest.raises(ValueError):
        datalog.evaluate(texts, facts, "h")


def test_conditions_of_claims_need_no_join(spark):
    t = Tables(spark, PATH)
    plan = validation.validate(t, t.claims, Params()).select("claim_id", "errors")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == validation.facts(t, t.claims, Params()).select("claim_id", F.col("facility_active"), F.col("fc_active"))._jdf.queryExecution().optimizedPlan().toString().count("Join")
