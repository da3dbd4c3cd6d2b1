"""Claim validation: direct checks, compiled rules, assignment checks, data quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank
from ..params import Params
from ..sources.testdata import Tables
from . import datalog, rules

# The direct checks, in their order: (rule, field, message, source); {name} stands for the claim's value.
DIRECT = [
    ("CORE_FAC_01", "facility_id", "Facility ID is missing.", "CORE"),
    ("CORE_FAC_02", "facility_id", "Facility ID '{facility_id}' not found or is inactive.", "CORE"),
    ("CORE_PAT_01", "patient_account_number", "Patient Account Number is missing or empty.", "CORE"),
    ("CORE_DATE_01", "service_date", "Claim service_date is missing.", "CORE"),
    ("CORE_DATE_02", "service_date", "Claim service_date cannot be in the future.", "CORE"),
    ("CORE_FC_01", "financial_class_id", "Financial Class ID is missing.", "CORE"),
    ("CORE_FC_03", "financial_class_id", "Financial Class '{financial_class_id}' not valid for facility '{facility_id}'.", "CORE"),
    ("CORE_DATE_03", "end_date", "End date is before the service date.", "SPEC"),
]


def facts(tables: Tables, claims: DataFrame, params: Params) -> DataFrame:
    """Claims with what the dimensions say: facility_known, facility_active, fc_active."""
    f = tables.facilities.select("facility_id", F.col("active").alias("_facility"))
    fc = tables.financial_classes.where("active").select("financial_class_id", F.col("facility_id").alias("_fc_facility"), F.lit(True).alias("_fc"))
    joined = claims.join(f, "facility_id", "left").join(fc, "financial_class_id", "left")
    own = F.col("_fc_facility") == F.col("facility_id")
    fits = own | F.col("_fc_facility").isNull() if params.allow_global_fc else own
    return joined.select(
        *claims.columns, F.col("_facility").isNotNull().alias("facility_known"), F.coalesce("_facility", F.lit(False)).alias("facility_active"),
        (F.coalesce("_fc", F.lit(False)) & F.coalesce(fits, F.lit(False))).alias("fc_active"),
    )


def direct_failures(params: Params) -> dict[str, Column]:
    """Each direct check as the condition under which it fails."""
    today = F.lit(params.as_of_claims.date())
    no_facility, no_class = F.coalesce(F.col("facility_id") == "", F.lit(True)), F.coalesce(F.col("financial_class_id") == "", F.lit(True))
    return {
        "CORE_FAC_01": no_facility,
        "CORE_FAC_02": ~no_facility & ~F.col("facility_active"),
        "CORE_PAT_01": blank("account"),
        "CORE_DATE_01": F.col("service_date").isNull(),
        "CORE_DATE_02": F.coalesce(F.col("service_date") > today, F.lit(False)),
        "CORE_FC_01": no_class,
        "CORE_FC_03": ~no_class & ~no_facility & F.col("facility_active") & ~F.col("fc_active"),
        "CORE_DATE_03": F.coalesce(F.col("end_date") < F.col("service_date"), F.lit(False)),
    }


def _entry(rule: str, field: str, message: str) -> Column:
    """rule|field|message with the claim's values in the message."""
    parts = re.split(r"\{(\w+)\}", message)
    texts = [F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(parts)]
    return F.concat(F.lit(f"{rule}|{field}|"), *texts)


def validate(tables: Tables, claims: DataFrame, params: Params = Params(), texts: list[str] | None = None, existing: str | None = None) -> DataFrame:
    """Claims with errors (array of rule|field|message), the two flags and the outcome.

    texts: rules as the rule table keeps them, the shipped ones by default.
    Rules on a claim's own attributes become conditions, all checked in one pass
    with the direct checks; rules that look at more than one fact of a claim are
    joined over the facts (operators.datalog). existing: a column of errors that
    claims have already; they stay in front. Errors are distinct by rule and
    field; those of source SPEC warn without making a claim invalid.
    """
    plain, joined = rules.split(rules.TEXTS if texts is None else texts)
    known = facts(tables, claims, params)
    failed = direct_failures(params)
    core = F.array(*[F.when(failed[r], _entry(r, f, m)) for r, f, m, s in DIRECT if s == "CORE"])
    spec = F.array(*[F.when(failed[r], _entry(r, f, m)) for r, f, m, s in DIRECT if s == "SPEC"])
    ruled = F.array(*[F.when(holds, F.lit(f"{r}|{f}|{m}")) for r, f, m, holds in map(rules.condition, plain)]).cast("array<string>")
    more = F.array().cast("array<string>")
    if joined:
        found = datalog.evaluate(joined, claim_relations(tables, claims), datalog.ERRORS, 4).toDF("_claim", "r", "f", "m")
        found = found.groupBy("_claim").agg(F.array_sort(F.collect_set(F.concat_ws("|", "r", "f", "m"))).alias("_more"))
        known, more = known.join(found, F.col("claim_id") == F.col("_claim"), "left"), F.coalesce("_more", more)
    lists = known.withColumns({"core_errors": F.array_compact(core), "rule_errors": F.concat(F.array_compact(ruled), more), "warnings": F.array_compact(spec)})
    ok, by_rules = F.size("core_errors") == 0, F.size("rule_errors") == 0
    before = F.coalesce(F.col(existing), F.array().cast("array<string>")) if existing else F.array().cast("array<string>")
    every = F.concat(before, "core_errors", "rule_errors")
    named = F.transform(every, lambda e: F.substring_index(e, "|", 2))
    first = F.filter(every, lambda e, k: F.array_position(named, F.element_at(named, k + 1)) == k + 1)
    return lists.withColumns({
        "errors": first, "core_valid": ok, "rules_valid": by_rules, "is_valid": ok & by_rules,
        "validation_outcome": F.when(ok & by_rules, "VALIDATION_PASSED").otherwise("VALIDATION_FAILED_RULES"), "facility_validated": F.col("facility_active"),
        "financial_class_validated": F.col("facility_active") & F.col("fc_active"),
    }).drop("_claim", "_more")


def error_rows(validated: DataFrame) -> DataFrame:
    """One row for each error: claim_id, rule_id, field, message."""
    each = validated.select("claim_id", F.explode("errors").alias("e")).withColumn("p", F.split("e", "[|]", 3))
    return each.select("claim_id", F.col("p")[0].alias("rule_id"), F.col("p")[1].alias("field"), F.col("p")[2].alias("message"))


def claim_facts(claims: DataFrame) -> DataFrame:
    """Attribute rows (claim_id, attribute, value) as rules see them; unset attributes are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(c).cast("string").alias("value")) for n, c in (("facility_id", "facility_id"), ("financial_class_id", "financial_class_id"), ("total_charge_amount", "total_charge"))])
    each = claims.select("claim_id", F.inline(pairs))
    return each.where("value is not null and value <> ''")


def claim_relations(tables: Tables, claims: DataFrame) -> dict[str, DataFrame]:
    """The facts that rules see: claims and their attributes, lines and diagnoses, and the facilities' state and parents."""
    f = tables.facilities
    return {
        "claim": claims.select("claim_id"),
        "claim_attribute": claim_facts(claims),
        "claim_line": tables.lines.select("claim_id", "line_number", "cpt_code", "units", "line_charge", "line_date"),
        "claim_diagnosis": tables.diagnoses.select("claim_id", "sequence", "icd_code"),
        "master_facility_exists": f.select("facility_id"),
        "master_facility_active": f.where("active").select("facility_id"),
        "facility_parent": tables.facility_parents,
    }


def late_lines(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines outside their claim's window: a join on the claim with a band residual."""
    outside = (F.col("line_date") < F.col("service_date")) | (F.col("line_date") > F.col("end_date"))
    return lines.select("claim_id", "line_number", "line_date").join(claims.select("claim_id", "service_date", "end_date"), "claim_id").where(outside)


def validate_assignments(tables: Tables, claims: DataFrame) -> DataFrame:
    """Facility, department and class of each claim checked in turn; errors and warnings joined by ';', and the facts as JSON."""
    f = tables.facilities.select("facility_id", "facility_name", F.col("active").alias("f_on"))
    d = tables.departments.select("department_id", "department_name", F.col("active").alias("d_on"), F.col("facility_id").alias("d_facility"))
    c = tables.financial_classes.select("financial_class_id", F.col("description").alias("fc_name"), F.col("active").alias("c_on"), F.col("facility_id").alias("c_facility"))
    x = claims.join(f, "facility_id", "left").join(d, "department_id", "left").join(c, "financial_class_id", "left")
    has_d, has_c = F.col("department_id").isNotNull(), F.col("financial_class_id").isNotNull()
    facility_error = F.when(F.col("facility_id").isNull(), "Claim is not assigned to any facility").when(F.col("facility_name").isNull(), "Assigned facility does not exist")
    department_error = F.when(has_d & F.col("department_name").isNull(), "Assigned department does not exist").when(has_d & F.col("d_on") & (F.col("d_facility") != F.col("facility_id")), "Department belongs to a different facility")
    class_error = F.when(has_c & F.col("fc_name").isNull(), "Assigned financial class does not exist").when(has_c & F.col("c_on") & (F.col("c_facility") != F.col("facility_id")), "Financial class belongs to a different facility")
    errors = F.concat_ws(";", facility_error, department_error, class_error)
    warnings = F.concat_ws(";", F.when(~F.col("f_on"), "Assigned facility is inactive"), F.when(has_d & ~F.col("d_on"), "Assigned department is inactive"), F.when(has_c & ~F.col("c_on"), "Assigned financial class is inactive"))
    info = F.to_json(F.struct("facility_id", "facility_name", "department_name", F.col("fc_name").alias("financial_class")))
    return x.select("claim_id", (errors == "").alias("is_valid"), F.nullif(errors, F.lit("")).alias("errors"), F.nullif(warnings, F.lit("")).alias("warnings"), info.alias("info"))


def quality_violations(tables: Tables) -> DataFrame:
    """Counts of broken constraints: (constraint, violations)."""
    f, c, lines = tables.facilities, tables.claims, tables.lines
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint"), "violations")
    parts = [
        count(f.where(~F.col("facility_type").isin("Teaching", "Non-Teaching")), "facility_type_check"),
        count(f.where(~F.col("critical_access").isin("Y", "N")), "critical_access_check"),
        count(c.groupBy("claim_id").count().where("count > 1"), "claim_id_unique"),
        count(c.where("facility_id is not null").join(f.select("facility_id"), "facility_id", "left_anti"), "claim_facility_exists"),
        count(c.where("financial_class_id is not null").join(tables.financial_classes.select("financial_class_id"), "financial_class_id", "left_anti"), "claim_class_exists"),
        count(lines.where("line_number not between 1 and 99"), "line_number_range"),
        count(lines.where("units <= 0"), "line_units_positive"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
