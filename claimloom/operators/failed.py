"""Disposition, failed claims, repair suggestions, audit trail and the failed-claims API."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, joined, mask, wrapped
from ..params import Params
from .pricing import price_lines


def dispose(validated: DataFrame, gated: DataFrame) -> DataFrame:
    """Validated claims with their filter, disposition_reason (the branch taken) and final_status."""
    x = validated.join(gated.select("claim_id", "assigned_filter", "confidence", "fallback"), "claim_id", "left")
    reason = F.when(~F.col("is_valid"), "VALIDATION_FAILED_RULES").when(F.col("assigned_filter") == "FILTER_ML_ERROR", "ML_PREDICTION_ERROR").when(F.col("fallback"), "ML_LOW_CONFIDENCE_FALLBACK").otherwise("VALIDATED_RULES_PASSED")
    return x.withColumn("disposition_reason", reason).withColumn("final_status", F.when(F.col("is_valid"), "COMPLETED_EXPORTED_TO_PROD").otherwise("VALIDATION_FAILED_RULES"))


def failed_records(disposed: DataFrame, as_of: datetime) -> DataFrame:
    """What is kept of each invalid claim, its snapshot wrapped and its account masked."""
    parts = F.transform("errors", lambda e: F.split(e, "[|]", 3))
    messages = F.transform(parts, lambda p: F.concat(F.lit("Comp: RULES, Field: "), p[1], F.lit(" - "), p[2]))
    snapshot = F.to_json(F.struct("claim_id", "facility_id", mask("account", "account_number").alias("account"), F.col("service_date").cast("string").alias("service_date"), F.col("total_charge").cast("string").alias("total_charge"), F.col("final_status").alias("final_status")))
    return disposed.where("not is_valid").select(
        F.col("claim_id").alias("original_claim_id"), "facility_id", mask("account", "account_number").alias("account"), "service_date", F.col("final_status").alias("stage"),
        joined(F.transform(parts, lambda p: p[0])).alias("error_codes"), joined(messages, "\n", "No specific error messages captured.").alias("error_messages"),
        wrapped(snapshot).alias("snapshot"), F.lit("New").alias("status"), at(as_of).alias("failed_at"),
    )


def snapshots(disposed: DataFrame, lines: DataFrame, diagnoses: DataFrame, payers: DataFrame, as_of: datetime) -> DataFrame:
    """Each failed claim's snapshot: twelve keys as wrapped JSON, with its first three diagnosis and procedure codes.

    payers has financial_class_id and payer_name. Only failed claims' children are aggregated.
    """
    own = disposed.where("not is_valid")
    keys = own.select("claim_id")

    def first(rows: DataFrame, order: str, code: str) -> DataFrame:
        found = rows.select("claim_id", order, code).where(F.col(order) <= 3).join(keys, "claim_id", "left_semi")
        return found.groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(order, code)))[code], 1, 3).alias(code))

    x = own.join(payers, "financial_class_id", "left").join(first(diagnoses, "sequence", "icd_code"), "claim_id", "left").join(first(lines, "line_number", "cpt_code"), "claim_id", "left")
    none = F.array().cast("array<string>")
    text = lambda c: F.col(c).cast("string")
    body = F.to_json(F.struct(
        "claim_id", "facility_id", mask("account", "account_number").alias("patient_account_number"), text("service_date").alias("service_date"), text("total_charge").alias("total_charge"), "payer_name",
        F.coalesce("icd_code", none).alias("diagnoses_codes"), F.coalesce("cpt_code", none).alias("procedure_codes"), F.col("status").alias("original_staging_status"), F.col("final_status").alias("final_pipeline_status"),
        F.col("assigned_filter").alias("ml_filters_attempted"), F.round("confidence", 3).cast("decimal(4,3)").cast("string").alias("ml_confidence"),
    ), {"ignoreNullFields": "false"})
    return x.select(F.col("claim_id").alias("original_claim_id"), wrapped(body).alias("snapshot"), at(as_of).alias("failed_at"))


def production_wide(disposed: DataFrame, lines: DataFrame, rvu: DataFrame, payers: DataFrame, params: Params) -> DataFrame:
    """Valid claims with all that production keeps of them and the test tables have, personal data masked, priced from their own lines only."""
    own = disposed.where("is_valid")
    priced = price_lines(lines.join(own.select("claim_id"), "claim_id", "left_semi"), rvu, params)
    paid = priced.groupBy("claim_id").agg(F.sum("amount").alias("_paid"), F.count("*").alias("_lines"))
    x = own.join(payers, "financial_class_id", "left").join(paid, "claim_id", "left")
    return x.select(
        "claim_id", "facility_id", mask(F.col("patient_id").cast("string"), "generic_id").alias("patient_id"), "patient_age", mask("account", "account_number").alias("patient_account_number"), "service_date", "end_date",
        F.col("total_charge").alias("total_charge_amount"), "department_id", "financial_class_id", "payer_name", F.col("final_status").alias("processing_status"), at(params.as_of_claims).alias("processed_date"),
        F.lit("VALIDATED_RULES_PASSED").alias("validation_status"), "assigned_filter", "confidence", F.coalesce("_paid", F.lit(0)).cast("decimal(18,2)").alias("reimbursement"), F.coalesce("_lines", F.lit(0)).alias("priced_lines"), "created_date", F.lit("system").alias("created_by"),
    )


def production_rows(disposed: DataFrame) -> DataFrame:
    """Valid claims as production has them."""
    return disposed.where("is_valid").select("claim_id", "facility_id", "department_id", "financial_class_id", "patient_id", "patient_age", "service_date", "total_charge", F.lit("COMPLETED").alias("status"), F.lit("VALIDATED").alias("validation_status"), F.array("assigned_filter").alias("assigned_filters"))


# What a suggestion says.
REPAIRS = {
    "facility_id": ("Verify facility ID against master list. Check for typos.", ["FAC001_VALID", "FAC002_VALID"], 0.70, "Error code VAL_FAC_001 indicates facility ID was not found or inactive."),
    "patient_account_number": ("Ensure patient account number is provided and correct.", None, 0.90, "Patient account number is a required field for billing."),
}


def suggest_repairs(failed: DataFrame) -> DataFrame:
    """Up to two suggestions for each failed claim; suggested_value_options is null where any value may be right."""
    facility = F.col("error_codes").rlike("VAL_FAC_001|CORE_FAC_0[12]")
    account = F.col("error_messages").contains("Patient Account Number is missing")

    def one(field: str, value: Column) -> Column:
        action, options, sure, reason = REPAIRS[field]
        listed = F.lit(None).cast("array<string>") if options is None else F.array(*map(F.lit, options))
        return F.struct(
            F.lit(field).alias("field_to_correct"), value.alias("current_value"), F.lit(action).alias("suggested_action"), listed.alias("suggested_value_options"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reasoning"),
        )

    found = F.array_compact(F.array(
        F.when(facility, one("facility_id", F.coalesce("facility_id", F.lit("N/A")))),
        F.when(account, one("patient_account_number", F.lit(""))),
    ))
    return failed.select("failed_id", "original_claim_id", F.inline(found))


def audit_trail(disposed: DataFrame) -> DataFrame:
    """One row for each step of each claim."""
    step = lambda action, outcome: F.struct(F.lit(action).alias("action"), outcome.alias("outcome"))
    steps = F.array(step("VALIDATE", F.when(F.col("is_valid"), "PASS").otherwise("FAIL")), step("PREDICT", F.when(~F.col("is_valid"), "SKIPPED").otherwise(F.col("assigned_filter"))), step("EXPORT", F.col("final_status")))
    return disposed.select(F.col("claim_id").alias("resource_id"), F.inline(steps))


def failed_page(failed: DataFrame, status: str | None = None, start: datetime | None = None, end: datetime | None = None, code_like: str | None = None, facility_id: str | None = None, sort_by: str = "failed_at", ascending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of failed claims by optional filters, in a total order; limit lies in 1..500."""
    if sort_by not in failed.columns or not 1 <= limit <= 500 or offset < 0:
        raise ValueError("no such column, or a limit outside 1..500, or a negative offset")
    tests: list[Column] = []
    tests += [F.col("status") == status] if status is not None else []
    tests += [F.col("failed_at") >= at(start)] if start is not None else []
    tests += [F.col("failed_at") < at(end)] if end is not None else []
    tests += [F.col("error_codes").ilike(f"%{code_like}%")] if code_like is not None else []
    tests += [F.col("facility_id") == facility_id] if facility_id is not None else []
    for t in tests:
        failed = failed.where(t)
    return failed.orderBy(F.asc(sort_by) if ascending else F.desc(sort_by), "failed_id").offset(offset).limit(limit)


def counts_by(failed: DataFrame, attribute: str, limit: int = 20) -> DataFrame:
    if attribute not in failed.columns:
        raise ValueError(f"no column {attribute}")
    counts = failed.groupBy(F.col(attribute).alias("attribute_value")).agg(F.count("*").alias("failure_count"))
    return counts.orderBy(F.desc("failure_count"), "attribute_value").limit(limit)


def latest_failures(failed: DataFrame) -> DataFrame:
    order = Window.partitionBy("original_claim_id").orderBy(F.desc("failed_at"), F.desc("failed_id"))
    return failed.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def resolve(failed: DataFrame, updates: DataFrame, as_of: datetime) -> DataFrame:
    """Applies (failed_id, new_status, notes, resolved_by); a status that begins with 'resolved' sets the time."""
    x = failed.join(updates, "failed_id", "left")
    changed = F.col("new_status").isNotNull()
    done = changed & F.lower("new_status").startswith("resolved")
    return x.select(*[c for c in failed.columns if c not in ("status", "resolved_at")], F.coalesce("new_status", "status").alias("status"), F.when(done, at(as_of)).otherwise(F.col("resolved_at")).alias("resolved_at"), F.when(changed, F.col("notes")).alias("resolution_notes"), F.when(changed & (F.col("resolved_by") != ""), F.col("resolved_by")).alias("resolved_by"))


def failure_patterns(failed: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Counts and shares of error codes in a period."""
    own = failed.where((F.col("failed_at") >= at(start)) & (F.col("failed_at") < at(end)))
    counts = own.groupBy("error_codes").agg(F.count("*").alias("n"))
    return counts.select(F.col("error_codes").alias("pattern"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def sync_status(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if((F.col("status") == "COMPLETED") & ~F.col("exported")).alias("pending_export"), F.count_if("exported").alias("exported"), F.max("processed_date").alias("last_processed"))
