"""Queries of rules over several facts of a claim, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datalog, rules, validation
from ..sources.testdata import Tables
from .oracle import sql
from .queries import P, query

OVER_LINES = [
    "validation_error(C, 'DUPLICATE_LINE', 'line_items', 'Two lines bill the same service') <= claim_line(C, N, S, _, _, _), claim_line(C, M, S, _, _, _), N < M",
]
DERIVED = [
    "dear_line(C, N) <= claim_line(C, N, _, U, A, _), U > 0, A > 50000",
    "coded_twice(C) <= claim_diagnosis(C, S, _), S > 1",
    "validation_error(C, 'DEAR_LINE_ONE_DIAGNOSIS', 'diagnoses', 'A line over 50000 has a single diagnosis') <= dear_line(C, _), ~coded_twice(C)",
]
RECURSIVE = [
    "within(F, P) <= facility_parent(F, P)",
    "within(F, G) <= within(F, P), facility_parent(P, G)",
    "shut_above(F) <= within(F, P), ~master_facility_active(P)",
    "validation_error(C, 'PARENT_INACTIVE', 'facility_id', 'A parent of the facility is inactive') <= claim_attribute(C, 'facility_id', F), shut_above(F)",
]

_DUPLICATES = "duplicates AS (SELECT DISTINCT claim_id FROM lines a JOIN lines b USING (claim_id, cpt_code) WHERE a.line_number < b.line_number)"
_DEAR = "dear AS (SELECT DISTINCT claim_id FROM lines WHERE units > 0 AND line_charge > 50000 AND claim_id NOT IN (SELECT claim_id FROM diagnoses WHERE sequence > 1))"
_WITHIN = """parents AS (SELECT 'FAC' || lpad(n_nationkey::VARCHAR, 3, '0') AS facility_id, 'FAC' || lpad((n_nationkey // 2)::VARCHAR, 3, '0') AS parent_id FROM nation WHERE n_nationkey > 0),
within AS (SELECT facility_id, parent_id FROM parents UNION SELECT w.facility_id, p.parent_id FROM within w JOIN parents p ON p.facility_id = w.parent_id),
shut AS (SELECT DISTINCT facility_id FROM within WHERE parent_id NOT IN (SELECT facility_id FROM facilities WHERE active))"""


def recursive(body: str, ctes: str) -> str:
    return sql(body, ctes).replace("WITH", "WITH RECURSIVE", 1)


def errors(t: Tables, texts: list[str]) -> DataFrame:
    return datalog.evaluate(texts, validation.claim_relations(t, t.claims), datalog.ERRORS, 4).toDF("claim_id", "rule_id", "field", "message")


query("rules_over_lines", sql("SELECT claim_id, 'DUPLICATE_LINE' AS rule_id, 'line_items' AS field, 'Two lines bill the same service' AS message FROM duplicates", _DUPLICATES))(lambda t: errors(t, OVER_LINES))
query("rules_derived", sql("SELECT claim_id, 'DEAR_LINE_ONE_DIAGNOSIS' AS rule_id, 'diagnoses' AS field, 'A line over 50000 has a single diagnosis' AS message FROM dear", _DEAR))(lambda t: errors(t, DERIVED))
query("rules_recursive", recursive("SELECT claim_id, 'PARENT_INACTIVE' AS rule_id, 'facility_id' AS field, 'A parent of the facility is inactive' AS message FROM claims WHERE facility_id IN (SELECT facility_id FROM shut)", _WITHIN))(
    lambda t: errors(t, RECURSIVE))
query("facility_within", recursive("SELECT facility_id, parent_id FROM within", _WITHIN))(
    lambda t: datalog.evaluate(RECURSIVE, validation.claim_relations(t, t.claims), "within").toDF("facility_id", "parent_id"))


@query("validated_all_rules", recursive("""SELECT claim_id, core_valid, is_valid AND more IS NULL AS is_valid, array_to_string(list_concat(errors, coalesce(more, [])), ';') AS errors FROM validated LEFT JOIN (
  SELECT claim_id, list(e ORDER BY e) AS more FROM (
    SELECT claim_id, 'DUPLICATE_LINE|line_items|Two lines bill the same service' AS e FROM duplicates UNION ALL SELECT claim_id, 'DEAR_LINE_ONE_DIAGNOSIS|diagnoses|A line over 50000 has a single diagnosis' FROM dear
    UNION ALL SELECT claim_id, 'PARENT_INACTIVE|facility_id|A parent of the facility is inactive' FROM claims WHERE facility_id IN (SELECT facility_id FROM shut)) GROUP BY claim_id) USING (claim_id)""", f"{_DUPLICATES}, {_DEAR}, {_WITHIN}"))
def validated_all_rules(t: Tables) -> DataFrame:
    """The shipped rules with those over several facts, in one validation."""
    done = validation.validate(t, t.claims, P, rules.TEXTS + OVER_LINES + DERIVED + RECURSIVE)
    return done.select("claim_id", "core_valid", "is_valid", F.array_join("errors", ";").alias("errors"))
