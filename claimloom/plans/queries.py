"""Every query of the claims engine by name, with the SQL that its rows must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import dml, failed, monitoring, pricing, scoring, validation
from ..params import Params
from ..sources import readers
from ..sources.testdata import Tables
from ..streaming import jobs
from . import views
from .oracle import mean, money, rate, sql

Query = Callable[[SparkSession, str], DataFrame]
P = Params()
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, path: f(Tables(spark, path))
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return register


def view(name: str, f: Callable[[Tables, Params], DataFrame], oracle: str) -> None:
    query(name, oracle)(lambda t: f(t, P))


def disposed(t: Tables, claims: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """The given claims, or all, validated, gated and disposed; features, where they are known already, of these claims at least."""
    claims = t.claims if claims is None else claims
    valid = validation.validate(t, claims, P)
    gated = scoring.gate(scoring.formula_predictions(scoring.features(claims, t.lines, t.diagnoses) if features is None else features), P)
    return failed.dispose(valid, gated)


# -- pipeline -------------------------------------------------------------------------------

@query("facility_summary", sql("SELECT facility_id, count(*) AS claims, count(*) FILTER (is_valid) AS valid_claims, count(*) FILTER (NOT is_valid) AS failed_claims, sum(CASE WHEN is_valid THEN reimbursement ELSE 0 END)::DECIMAL(18,2) AS reimbursement FROM validated JOIN paid USING (claim_id) GROUP BY facility_id"))
def facility_summary(t: Tables) -> DataFrame:
    """Flagship: validate, price and dispose all claims, summed by facility."""
    priced = pricing.price_claims(validation.validate(t, t.claims, P), pricing.price_lines(t.lines, t.rvu, P))
    amount = F.sum(F.when(F.col("is_valid"), F.col("reimbursement")).otherwise(F.lit("0.00").cast("decimal(18,2)"))).cast("decimal(18,2)")
    return priced.groupBy("facility_id").agg(F.count("*").alias("claims"), F.count_if("is_valid").alias("valid_claims"), F.count_if(~F.col("is_valid")).alias("failed_claims"), amount.alias("reimbursement"))


query("claims_validated", sql("SELECT claim_id, core_valid, rules_valid, is_valid, array_to_string(errors, ';') AS errors FROM validated"))(
    lambda t: validation.validate(t, t.claims, P).select("claim_id", "core_valid", "rules_valid", "is_valid", F.array_join("errors", ";").alias("errors")))
query("error_rows", sql("SELECT claim_id, split_part(e, '|', 1) AS rule_id, split_part(e, '|', 2) AS field, split_part(e, '|', 3) AS message FROM (SELECT claim_id, unnest(errors) AS e FROM validated)"))(lambda t: validation.error_rows(validation.validate(t, t.claims, P)))
query("rule_violations", sql("SELECT split_part(e, '|', 1) AS rule_id, count(*) AS n FROM (SELECT unnest(rule_errors) AS e FROM validated) GROUP BY 1"))(
    lambda t: validation.validate(t, t.claims, P).select(F.explode("rule_errors").alias("e")).groupBy(F.split("e", "[|]")[0].alias("rule_id")).agg(F.count("*").alias("n")))
query("claim_facts", sql("SELECT claim_id, attribute, value FROM (SELECT claim_id, unnest(['facility_id', 'financial_class_id', 'total_charge_amount']) AS attribute, unnest([facility_id, financial_class_id, total_charge::VARCHAR]) AS value FROM claims) WHERE value IS NOT NULL AND value <> ''"))(lambda t: validation.claim_facts(t.claims))
query("claims_spec_rules", sql("SELECT l.claim_id, line_number, line_date, service_date, end_date FROM lines l JOIN claims c USING (claim_id) WHERE line_date < service_date OR line_date > end_date"))(lambda t: validation.late_lines(t.claims, t.lines))
query("assignment_validation", sql("""SELECT claim_id, errors = '' AS is_valid, nullif(errors, '') AS errors, nullif(warnings, '') AS warnings FROM (SELECT c.claim_id, concat_ws(';',
  CASE WHEN c.facility_id IS NULL THEN 'Claim is not assigned to any facility' WHEN f.facility_name IS NULL THEN 'Assigned facility does not exist' END,
  CASE WHEN c.department_id IS NOT NULL AND d.department_name IS NULL THEN 'Assigned department does not exist' WHEN d.active AND d.facility_id <> c.facility_id THEN 'Department belongs to a different facility' END,
  CASE WHEN c.financial_class_id IS NOT NULL AND k.description IS NULL THEN 'Assigned financial class does not exist' WHEN k.active AND k.facility_id <> c.facility_id THEN 'Financial class belongs to a different facility' END) AS errors,
  concat_ws(';', CASE WHEN NOT f.active THEN 'Assigned facility is inactive' END, CASE WHEN NOT d.active THEN 'Assigned department is inactive' END, CASE WHEN NOT k.active THEN 'Assigned financial class is inactive' END) AS warnings
  FROM claims c LEFT JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN departments d ON d.department_id = c.department_id LEFT JOIN financial_classes k ON k.financial_class_id = c.financial_class_id)"""))(lambda t: validation.validate_assignments(t, t.claims).drop("info"))
query("line_reimbursement", sql("SELECT claim_id, line_number, cpt_code, units, pricing_status, amount FROM priced"))(lambda t: pricing.price_lines(t.lines, t.rvu, P).select("claim_id", "line_number", "cpt_code", "units", "pricing_status", "amount"))
query("claim_reimbursement", sql("SELECT claim_id, reimbursement, priced_lines FROM paid"))(lambda t: pricing.price_claims(t.claims, pricing.price_lines(t.lines, t.rvu, P)).select("claim_id", "reimbursement", "priced_lines"))
query("ml_features", sql("SELECT * FROM feats"))(lambda t: scoring.features(t.claims, t.lines, t.diagnoses))
query("ml_gate", sql("SELECT claim_id, prediction, confidence, assigned_filter, fallback FROM gated"))(lambda t: scoring.gate(scoring.formula_predictions(scoring.features(t.claims, t.lines, t.diagnoses)), P).select("claim_id", "prediction", "confidence", "assigned_filter", "fallback"))
query("disposition_summary", sql("SELECT disposition_reason, final_status, count(*) AS n, sum(total_charge)::DECIMAL(18,2) AS charges FROM disposed GROUP BY 1, 2"))(lambda t: disposed(t).groupBy("disposition_reason", "final_status").agg(F.count("*").alias("n"), fn.total("total_charge").alias("charges")))
query("failed_claim_records", sql("""SELECT claim_id AS original_claim_id, facility_id, CASE WHEN length(account) > 4 THEN '********' || right(account, 4) ELSE account END AS account, service_date, final_status AS stage,
  array_to_string(list_transform(errors, lambda e: split_part(e, '|', 1)), ', ') AS error_codes, array_to_string(list_transform(errors, lambda e: 'Comp: RULES, Field: ' || split_part(e, '|', 2) || ' - ' || split_part(e, '|', 3)), chr(10)) AS error_messages, 'New' AS status
  FROM disposed WHERE NOT is_valid""".replace("ELSE account END", "ELSE CASE WHEN length(account) > 3 THEN repeat('*', length(account)) ELSE account END END")))(lambda t: failed.failed_records(disposed(t), P.as_of_claims).drop("snapshot", "failed_at"))
query("production_rows", sql("SELECT claim_id, facility_id, department_id, financial_class_id, patient_id, patient_age, service_date, total_charge, 'COMPLETED' AS status, 'VALIDATED' AS validation_status, assigned_filter AS filters FROM disposed WHERE is_valid"))(lambda t: failed.production_rows(disposed(t)).withColumn("filters", F.array_join("assigned_filters", ",")).drop("assigned_filters"))
_REPAIRS = """SELECT failed_id, original_claim_id, 'facility_id' AS field_to_correct, coalesce(facility_id, 'N/A') AS current_value, 'Verify facility ID against master list. Check for typos.' AS suggested_action, 'FAC001_VALID,FAC002_VALID' AS suggested_value_options, 0.7::DOUBLE AS confidence,
    'Error code VAL_FAC_001 indicates facility ID was not found or inactive.' AS reasoning FROM failing WHERE error_codes IN ('CORE_FAC_01', 'CORE_FAC_02')
  UNION ALL SELECT failed_id, original_claim_id, 'patient_account_number', '', 'Ensure patient account number is provided and correct.', NULL, 0.9::DOUBLE, 'Patient account number is a required field for billing.' FROM failing WHERE contains(error_messages, 'Patient Account Number is missing')"""


def _repairs(rows: DataFrame) -> DataFrame:
    return failed.suggest_repairs(rows).withColumn("suggested_value_options", F.array_join("suggested_value_options", ","))


query("repair_suggestions", sql(_REPAIRS, " failing AS (SELECT * FROM failed_claims)"))(lambda t: _repairs(t.failed_claims))
query("claim_repairs", sql(_REPAIRS, " failing AS (SELECT * FROM failed_claims QUALIFY row_number() OVER (PARTITION BY original_claim_id ORDER BY failed_at DESC, failed_id DESC) = 1)"))(lambda t: _repairs(failed.latest_failures(t.failed_claims)))
query("audit_trail", sql("SELECT claim_id AS resource_id, unnest(['VALIDATE', 'PREDICT', 'EXPORT']) AS action, unnest([CASE WHEN is_valid THEN 'PASS' ELSE 'FAIL' END, CASE WHEN is_valid THEN assigned_filter ELSE 'SKIPPED' END, final_status]) AS outcome FROM disposed"))(lambda t: failed.audit_trail(disposed(t)))
query("optimal_batch_size", sql("SELECT facility_id, greatest(least(512 * 1024, 30 * 100, greatest(n // 100, 100), 10000), 100)::BIGINT AS batch_size FROM (SELECT facility_id, count(*) * 1000 AS n FROM claims GROUP BY 1)"))(lambda t: t.claims.groupBy("facility_id").agg((F.count("*") * 1000).alias("n")).select("facility_id", fn.batch_size(F.col("n"), F.lit(512), F.lit(30)).alias("batch_size")))
query("phi_masking_all", sql("SELECT claim_id, CASE WHEN length(account) > 4 THEN '********' || right(account, 4) WHEN length(account) > 3 THEN repeat('*', length(account)) ELSE account END AS account_masked, CASE WHEN length(account) > 1 THEN left(account, 1) || '***' || right(account, 1) WHEN length(account) = 1 THEN account || '****' ELSE account END AS name_masked, CASE WHEN length(account) >= 9 THEN '***-**-' || right(account, 4) WHEN length(account) > 3 THEN repeat('*', length(account)) ELSE account END AS ssn_masked, strftime(service_date, '%Y') || '-XX-XX' AS dob_masked FROM claims"))(
    lambda t: t.claims.select("claim_id", fn.mask("account", "account_number").alias("account_masked"), fn.mask("account", "name").alias("name_masked"), fn.mask("account", "ssn").alias("ssn_masked"), fn.mask(F.col("service_date").cast("string"), "dob_year").alias("dob_masked")))
query("phi_hash", sql("SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256('pepper' || text) END AS text_hash FROM documents"))(lambda t: t.read("documents").select("doc_id", fn.salted_hash("text", P.salt).alias("text_hash")))
query("encrypt_roundtrip", sql("SELECT claim_id, 'encrypted(' || reverse(account) || ')' AS wrapped, account AS unwrapped FROM claims"))(lambda t: t.claims.select("claim_id", fn.wrapped("account").alias("wrapped"), fn.unwrapped(fn.wrapped("account")).alias("unwrapped")))
query("feature_key", sql("SELECT claim_id, left(md5(concat_ws('_', f_age::VARCHAR, f_diagnoses::VARCHAR, f_lines::VARCHAR)), 8) AS cache_key FROM feats"))(lambda t: scoring.features(t.claims, t.lines, t.diagnoses).select("claim_id", fn.feature_key("f_age", "f_diagnoses", "f_lines").alias("cache_key")))
query("search_tokens", sql("SELECT part_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', a, b)), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'and', 'of', 'or', 'the', 'to')))), ' ') AS tokens FROM (SELECT p_partkey AS part_id, p_name AS a, p_type AS b FROM part)"))(lambda t: t.read("part").select(F.col("p_partkey").alias("part_id"), F.array_join(fn.search_tokens(["p_name", "p_type"]), " ").alias("tokens")))

# -- views ------------------------------------------------------------------------------------

view("mv_processing_summary", views.processing_summary, sql(f"SELECT date_trunc('hour', created_date) AS processing_hour, status, facility_active AS facility_validated, department_id IS NOT NULL AS department_validated, fc_active AS financial_class_validated, count(*) AS claim_count, {money('total_charge')} AS total_charges, {mean('total_charge')} AS avg_charge, count(*) FILTER (exported) AS exported_count, min(service_date) AS earliest, max(service_date) AS latest FROM facts WHERE created_date >= {{C}} - INTERVAL 7 DAY GROUP BY 1, 2, 3, 4, 5"))
view("mv_facility_performance", views.facility_performance_daily, sql(f"SELECT f.facility_id, f.facility_name, f.facility_type, c.service_date AS service_day, count(c.claim_id) AS total_claims, count(*) FILTER (status = 'COMPLETED') AS completed_claims, count(*) FILTER (facility_active) AS validated_claims, count(*) FILTER (exported) AS exported_claims, {money('total_charge')} AS total_charges, {mean('total_charge')} AS avg_charge, count(DISTINCT patient_id) AS unique_patients, count(DISTINCT cpt_code) AS unique_procedures FROM facts c JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN lines l ON l.claim_id = c.claim_id WHERE c.service_date >= {{C}} - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4"))
view("mv_validation_failure_patterns", views.validation_failure_patterns, sql(f"SELECT e.validation_type, e.model_version, e.validation_day, count(*) AS failure_count, {mean('v.processing_ms')} AS avg_processing_ms, {mean('v.inference_ms')} AS avg_inference_ms, array_to_string(list_sort(list_distinct(list(e.error_type || '=' || e.error_count))), ',') AS error_type_counts FROM counts e JOIN own v ON v.validation_type = e.validation_type AND v.model_version = e.model_version AND v.created_date::DATE = e.validation_day GROUP BY 1, 2, 3", " own AS (SELECT * FROM validation_results WHERE validation_status = 'FAILED' AND created_date >= {E} - INTERVAL 7 DAY), counts AS (SELECT validation_type, model_version, created_date::DATE AS validation_day, coalesce(error_type, 'unknown') AS error_type, count(*) AS error_count FROM own GROUP BY 1, 2, 3, 4)"))
view("mv_financial_metrics", views.financial_metrics, sql(f"SELECT c.service_date AS service_day, k.description AS fc_description, y.payer_category, f.facility_type, count(c.claim_id) AS claim_count, {money('c.total_charge')} AS total_charges, {money('p.amount')} AS total_reimbursement, {mean('c.total_charge')} AS avg_charge, {mean('p.amount')} AS avg_reimbursement, CASE WHEN sum(c.total_charge) > 0 THEN round(sum(p.amount)::DOUBLE / sum(c.total_charge)::DOUBLE, 6) END AS reimbursement_ratio FROM claims c JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN financial_classes k ON k.financial_class_id = c.financial_class_id LEFT JOIN payers y ON y.payer_id = k.payer_id LEFT JOIN priced p ON p.claim_id = c.claim_id WHERE c.service_date >= {{C}} - INTERVAL 90 DAY AND exported GROUP BY 1, 2, 3, 4"))
view("mv_ml_model_performance", views.ml_model_performance, sql(f"SELECT model_version, date_trunc('hour', created_date) AS prediction_hour, count(*) AS total_predictions, {mean('inference_ms')} AS avg_inference, round(quantile_cont(inference_ms::DOUBLE, 0.5), 6) AS median_inference, round(quantile_cont(inference_ms::DOUBLE, 0.95), 6) AS p95_inference, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence > 0.8) AS high_confidence FROM validation_results WHERE validation_type = 'ML_FILTER' AND created_date >= {{E}} - INTERVAL 90 DAY AND inference_ms IS NOT NULL GROUP BY 1, 2"))
view("v_claims_for_validation", views.claims_for_validation, sql("""SELECT c.claim_id, c.facility_id, c.department_id, c.financial_class_id, c.patient_id, c.patient_age, c.account AS patient_account_number, c.service_date, c.total_charge AS total_charge_amount, y.payer_name, c.status AS processing_status, c.created_date, coalesce(f.facility_name, 'N/A') AS facility_name, coalesce(d.department_name, 'N/A') AS department_name, coalesce(k.description, 'N/A') AS fc_description,
  coalesce(array_to_string(list_sort(list(DISTINCT g.icd_code) FILTER (g.icd_code IS NOT NULL)), ','), '') AS diagnosis_codes, coalesce(array_to_string(list_sort(list(DISTINCT l.cpt_code) FILTER (l.cpt_code IS NOT NULL)), ','), '') AS procedure_codes, count(DISTINCT g.sequence) AS diagnosis_count, count(DISTINCT l.line_number) AS line_count, sum(l.amount)::DECIMAL(18,2) AS total_reimbursement
  FROM claims c LEFT JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN departments d ON d.department_id = c.department_id LEFT JOIN financial_classes k ON k.financial_class_id = c.financial_class_id LEFT JOIN payers y ON y.payer_id = k.payer_id
  LEFT JOIN diagnoses g ON g.claim_id = c.claim_id AND c.service_date IS NOT NULL LEFT JOIN priced l ON l.claim_id = c.claim_id AND c.service_date IS NOT NULL WHERE c.status = 'PENDING' AND NOT c.exported GROUP BY ALL"""))
view("v_high_volume_stats", views.high_volume_stats, sql(f"SELECT date_trunc('hour', created_date) AS processing_hour, status, count(*) AS claim_count, count(*) FILTER (facility_active) AS validated_count, count(*) FILTER (exported) AS exported_count, {money('total_charge')} AS total_charges, {mean('total_charge')} AS avg_charge, round(quantile_cont(total_charge::DOUBLE, 0.5), 6) AS median_charge, count(DISTINCT facility_id) AS unique_facilities, count(DISTINCT substring(account, 1, 3)) AS account_prefixes FROM facts WHERE created_date >= {{C}} - INTERVAL 90 DAY GROUP BY 1, 2"))
view("mv_validation_summary", views.validation_summary, sql(f"SELECT date_trunc('hour', created_date) AS hour, validation_type, validation_status, count(*) AS n, {mean('processing_ms')} AS avg_ms, round(quantile_cont(processing_ms::DOUBLE, 0.95), 6) AS p95_ms, count(*) FILTER (validation_status = 'FAILED') AS failed_count FROM validation_results WHERE created_date >= {{E}} - INTERVAL 7 DAY GROUP BY 1, 2, 3"))
view("mv_facility_metrics", views.facility_metrics, sql(f"SELECT facility_id, service_date AS service_day, status, count(*) AS claim_count, {money('total_charge')} AS total_charges, {mean('total_charge')} AS avg_charge, count(*) FILTER (facility_validated) AS validated_claims, count(*) FILTER (len(errors) > 0) AS error_claims FROM validated WHERE service_date >= {{C}} - INTERVAL 30 DAY GROUP BY 1, 2, 3"))

MINUTES, SECONDS = "date_diff('minute', created_date, processed_date)", "date_diff('second', created_date, processed_date)"
_OK = "count(*) FILTER (validation_status = 'VALIDATED')"
view("vw_processing_performance", views.processing_performance, sql(f"SELECT count(*) AS total_claims, count(*) FILTER (status = 'PENDING') AS pending_claims, count(*) FILTER (status = 'PROCESSING') AS processing_claims, count(*) FILTER (status = 'COMPLETED') AS completed_claims, count(*) FILTER (status = 'ERROR') AS error_claims, {mean(MINUTES)} AS avg_minutes, count(*) FILTER (created_date >= {{C}} - INTERVAL 1 HOUR) AS claims_last_hour, count(*) FILTER (created_date >= {{C}} - INTERVAL 1 DAY) AS claims_last_day, count(*) FILTER (processed_date >= {{C}} - INTERVAL 1 HOUR) AS processed_last_hour, {money('total_charge')} AS total_charges, {mean('total_charge')} AS avg_charge, {_OK} AS validated_claims, {rate(_OK, 'count(*)')} AS validation_rate FROM claims WHERE created_date >= {{C}} - INTERVAL 30 DAY"))
view("vw_system_health", views.system_health, sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, max({c}) AS newest, min({c}) AS oldest, count(*) FILTER ({c} >= {m} - INTERVAL 24 HOUR) AS last_day FROM {n}" for n, c, m in (("claims", "created_date", "{C}"), ("failed_claims", "failed_at", "{E}"), ("validation_results", "created_date", "{E}"), ("metric_points", "ts", "{E}")))))
_DONE = "count(*) FILTER (status = 'Resolved')"
_HOURS = "date_diff('hour', failed_at, resolved_at)"
view("vw_failed_claims_analytics", views.failed_claims_analytics, sql(f"SELECT stage, status, count(*) AS failures, count(*) FILTER (failed_at >= {{E}} - INTERVAL 1 DAY) AS last_day, count(*) FILTER (failed_at >= {{E}} - INTERVAL 7 DAY) AS last_week, {mean(_HOURS)} AS avg_resolution_hours, {_DONE} AS resolved, {rate(_DONE, 'count(*)')} AS resolution_rate FROM failed_claims WHERE failed_at >= {{E}} - INTERVAL 30 DAY GROUP BY 1, 2"))
_OKC = "count(*) FILTER (c.validation_status = 'VALIDATED')"
view("vw_facility_performance", views.facility_performance, sql(f"SELECT f.facility_id, f.facility_name, f.facility_type, f.critical_access, count(c.claim_id) AS total_claims, count(*) FILTER (c.created_date >= {{C}} - INTERVAL 1 DAY) AS claims_last_day, count(*) FILTER (c.created_date >= {{C}} - INTERVAL 7 DAY) AS claims_last_week, {mean(MINUTES)} AS avg_minutes, count(*) FILTER (c.status = 'COMPLETED') AS completed_claims, {money('c.total_charge')} AS total_charges, {mean('c.total_charge')} AS avg_charge, {_OKC} AS validated_claims, {rate(_OKC, 'count(c.claim_id)')} AS validation_rate, (SELECT count(*) FROM failed_claims x WHERE x.facility_id = f.facility_id AND x.failed_at >= {{E}} - INTERVAL 30 DAY) AS failed_last_30_days FROM facilities f LEFT JOIN claims c ON c.facility_id = f.facility_id WHERE f.active GROUP BY 1, 2, 3, 4"))
view("vw_facility_performance_30d", views.facility_performance_30d, sql(f"SELECT f.facility_id, f.facility_name, f.facility_type, count(c.claim_id) AS total_claims, {_OKC} AS validated_claims, count(x.original_claim_id) AS failed_claims, coalesce({rate('count(x.original_claim_id)', 'count(c.claim_id)')}, 0) AS failure_rate, {money('c.total_charge')} AS total_charges, max(c.created_date) AS last_claim FROM facilities f LEFT JOIN claims c ON c.facility_id = f.facility_id AND c.created_date >= {{C}} - INTERVAL 30 DAY LEFT JOIN failed_claims x ON x.original_claim_id = c.claim_id GROUP BY 1, 2, 3"))
_TREE = "facilities f LEFT JOIN organizations o USING (organization_id) LEFT JOIN regions r USING (region_id)"
view("vw_facility_details", views.facility_details, sql(f"SELECT facility_id, facility_name, facility_type, organization_name, region_name, active, (SELECT count(*) FROM departments d WHERE d.facility_id = f.facility_id AND d.active) AS active_departments, (SELECT count(*) FROM financial_classes k WHERE k.facility_id = f.facility_id AND k.active) AS active_classes FROM {_TREE}"))
_BY_FACILITY = f"SELECT f.facility_id, f.facility_name, o.organization_name, r.region_name, count(c.claim_id) AS total_claims, count(*) FILTER (status = 'PENDING') AS pending_claims, count(*) FILTER (status = 'COMPLETED') AS completed_claims, count(*) FILTER (status = 'ERROR') AS error_claims, count(*) FILTER (validation_status = 'VALIDATED') AS validated_claims, coalesce(sum(total_charge), 0)::DECIMAL(18,2) AS total_charges, coalesce({mean('total_charge')}, 0) AS avg_charge, min(service_date) AS earliest, max(service_date) AS latest, count(DISTINCT department_id) AS departments, count(DISTINCT financial_class_id) AS financial_classes FROM {_TREE} LEFT JOIN claims c ON c.facility_id = f.facility_id"
view("vw_claims_by_facility", views.claims_by_facility, sql(f"{_BY_FACILITY} GROUP BY 1, 2, 3, 4"))
query("fn_facility_summary", sql(f"{_BY_FACILITY} WHERE f.facility_id = 'FAC007' GROUP BY 1, 2, 3, 4"))(lambda t: views.claims_by_facility(t, P, "FAC007"))
view("vw_financial_class_summary", views.financial_class_summary, sql("SELECT k.financial_class_id, k.description, k.facility_id, f.facility_name, y.payer_name, y.payer_category, k.active, (SELECT count(*) FROM claims c WHERE c.financial_class_id = k.financial_class_id AND c.facility_id = k.facility_id) AS total_claims FROM financial_classes k LEFT JOIN facilities f ON f.facility_id = k.facility_id LEFT JOIN payers y ON y.payer_id = k.payer_id"))
view("vw_department_utilization", views.department_utilization, sql(f"SELECT d.department_id, d.department_name, d.facility_id, f.facility_name, count(c.claim_id) AS total_claims, coalesce(sum(total_charge), 0)::DECIMAL(18,2) AS total_charges, coalesce({mean('total_charge')}, 0) AS avg_charge, count(*) FILTER (c.service_date >= {{C}} - INTERVAL 30 DAY) AS last_30_days, count(*) FILTER (c.service_date >= {{C}} - INTERVAL 90 DAY) AS last_90_days, min(c.service_date) AS first_claim, max(c.service_date) AS last_claim FROM departments d LEFT JOIN facilities f ON f.facility_id = d.facility_id LEFT JOIN claims c ON c.department_id = d.department_id AND c.facility_id = d.facility_id WHERE d.active GROUP BY 1, 2, 3, 4"))
view("vw_realtime_dashboard", views.realtime_dashboard, sql(f"SELECT count(*) FILTER (created_date >= {{C}}) AS claims_today, count(*) FILTER (created_date >= {{C}} - INTERVAL 1 HOUR) AS claims_last_hour, count(*) FILTER (status = 'PENDING') AS pending_claims, count(*) FILTER (status = 'PROCESSING') AS processing_claims, (SELECT {mean(SECONDS)} FROM claims WHERE processed_date >= {{C}} - INTERVAL 1 HOUR) AS avg_seconds_last_hour, (sum(total_charge) FILTER (created_date >= {{C}}))::DECIMAL(18,2) AS charges_today, count(*) AS total_claims, count(DISTINCT facility_id) FILTER (created_date >= {{C}}) AS facilities_today, (SELECT count(*) FROM failed_claims WHERE failed_at >= {{E}}) AS failures_today, (SELECT count(*) FROM failed_claims WHERE failed_at >= {{E}} - INTERVAL 1 HOUR) AS failures_last_hour, {{C}} AS last_updated FROM claims"))
view("vw_system_alerts", views.system_alerts, sql(f"""SELECT * FROM (SELECT 'ERROR_RATE' AS alert_type, 'HIGH' AS severity, (SELECT count(*) FROM failed_claims WHERE failed_at >= {{E}} - INTERVAL 30 DAY)::DOUBLE / nullif((SELECT count(*) FROM claims WHERE created_date >= {{C}} - INTERVAL 30 DAY), 0) * 100 AS alert_value, 10.0::DOUBLE AS threshold
  UNION ALL SELECT 'SLOW_PROCESSING', 'MEDIUM', (SELECT {mean(SECONDS)} FROM claims WHERE processed_date >= {{C}} - INTERVAL 30 DAY), 300.0::DOUBLE UNION ALL SELECT 'HIGH_PENDING_VOLUME', 'MEDIUM', (SELECT count(*) FROM claims WHERE status = 'PENDING')::DOUBLE, 1000.0::DOUBLE) WHERE alert_value > threshold"""))
view("vw_processing_metrics", views.processing_metrics, sql(f"SELECT 0::INTEGER AS current_hour, count(*) AS total_claims, count(*) FILTER (status = 'PENDING') AS pending_claims, count(*) FILTER (status = 'PROCESSING') AS processing_claims, count(*) FILTER (status = 'COMPLETED') AS completed_claims, count(*) FILTER (created_date >= {{C}} - INTERVAL 15 MINUTE) AS last_15_minutes, count(*) FILTER (created_date >= {{C}} - INTERVAL 15 MINUTE) / 15.0::DOUBLE AS claims_per_minute, (sum({SECONDS})::BIGINT // nullif(count({SECONDS}), 0))::BIGINT AS avg_seconds FROM claims WHERE created_date >= {{C}} - INTERVAL 24 HOUR"))
view("collect_performance_metrics", views.performance_metrics, sql("SELECT 'Current Processing Status' AS category, status AS name, count(*) AS n, (sum(date_diff('minute', created_date, {C}))::BIGINT // count(*))::DOUBLE AS value FROM claims WHERE created_date >= {C} - INTERVAL 1 DAY GROUP BY status UNION ALL SELECT 'Throughput Last Hour', 'Claims Processed', count(*), count(*) / 60.0::DOUBLE FROM claims WHERE processed_date >= {C} - INTERVAL 1 HOUR UNION ALL SELECT 'Failed Claims', stage, count(*), (sum(date_diff('minute', failed_at, {E}))::BIGINT // count(*))::DOUBLE FROM failed_claims WHERE failed_at >= {E} - INTERVAL 1 DAY GROUP BY stage"))
view("vw_realtime_throughput", views.realtime_throughput, sql("SELECT *, last_5_minutes / 5.0::DOUBLE AS per_minute_5, last_15_minutes / 15.0::DOUBLE AS per_minute_15, last_60_minutes / 60.0::DOUBLE AS per_minute_60, CASE WHEN last_15_minutes / 15.0 >= 111.11 THEN 'MEETING_TARGET' WHEN last_15_minutes / 15.0 >= 50 THEN 'BELOW_TARGET' ELSE 'CRITICAL' END AS performance_status FROM (SELECT count(*) FILTER (created_date >= {C} - INTERVAL 5 MINUTE) AS last_5_minutes, count(*) FILTER (created_date >= {C} - INTERVAL 15 MINUTE) AS last_15_minutes, count(*) FILTER (created_date >= {C} - INTERVAL 1 HOUR) AS last_60_minutes FROM claims WHERE created_date >= {C} - INTERVAL 24 HOUR)"))
view("facility_hierarchy", views.facility_hierarchy, sql(f"SELECT facility_id, facility_name, organization_id, organization_name, region_id, region_name FROM {_TREE}"))

# -- failed claims and sources ----------------------------------------------------------------

query("failed_counts_by_attribute", sql("SELECT stage AS attribute_value, count(*) AS failure_count FROM failed_claims GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))(lambda t: failed.counts_by(t.failed_claims, "stage"))
query("failed_claims_page", sql("SELECT failed_id, status, facility_id, failed_at, error_codes FROM failed_claims WHERE status = 'Resolved' AND error_codes ILIKE '%fac%' ORDER BY failed_at DESC, failed_id LIMIT 50 OFFSET 10"))(lambda t: failed.failed_page(t.failed_claims, status="Resolved", code_like="fac", offset=10, limit=50).select("failed_id", "status", "facility_id", "failed_at", "error_codes"))
query("latest_failure", sql("SELECT original_claim_id, failed_id, failed_at, status FROM failed_claims QUALIFY row_number() OVER (PARTITION BY original_claim_id ORDER BY failed_at DESC, failed_id DESC) = 1"))(lambda t: failed.latest_failures(t.failed_claims).select("original_claim_id", "failed_id", "failed_at", "status"))
query("failure_patterns", sql("SELECT error_codes AS pattern, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM failed_claims WHERE failed_at >= TIMESTAMP '2024-01-01' AND failed_at < {E} GROUP BY 1"))(lambda t: failed.failure_patterns(t.failed_claims, P.as_of_events.replace(day=1), P.as_of_events))
query("sync_status", sql("SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'COMPLETED' AND NOT exported) AS pending_export, count(*) FILTER (exported) AS exported, max(processed_date) AS last_processed FROM claims"))(lambda t: failed.sync_status(t.claims))
query("dequeue_pending", sql("SELECT claim_id, created_date, 'PROCESSING' AS status FROM claims WHERE status = 'PENDING' ORDER BY created_date, claim_key LIMIT 2000"))(lambda t: readers.pending(t.claims, 2000).select("claim_id", "created_date", F.lit("PROCESSING").alias("status")))
query("claim_with_children", sql("SELECT c.claim_id, (SELECT string_agg(line_number || ':' || cpt_code || ':' || units, ',' ORDER BY line_number) FROM lines l WHERE l.claim_id = c.claim_id) AS lines, (SELECT string_agg(icd_code, ',' ORDER BY sequence) FROM diagnoses d WHERE d.claim_id = c.claim_id) AS diagnoses FROM claims c"))(
    lambda t: readers.with_children(t.claims.select("claim_id"), t.lines, t.diagnoses).select("claim_id", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["cpt_code"], x["units"].cast("string"))), ",").alias("lines"), F.array_join("diagnoses.icd_code", ",").alias("diagnoses")))
query("json_recordset", sql("SELECT claim_id, status, patient_age FROM claims"))(lambda t: readers.json_records(t.claims.groupBy(F.floor(F.col("claim_key") / 1000)).agg(F.to_json(F.collect_list(F.struct("claim_id", "status", "patient_age"))).alias("j")), "j", "claim_id string, status string, patient_age bigint"))
query("split_ids", sql("SELECT claim_id FROM claims"))(lambda t: readers.split_ids(t.claims.groupBy(F.floor(F.col("claim_key") / 1000)).agg(F.array_join(F.collect_list("claim_id"), ", ").alias("ids")), "ids"))
query("month_series_gap", sql("SELECT m::DATE AS month FROM generate_series(TIMESTAMP '1994-06-01', TIMESTAMP '2002-03-01', INTERVAL 1 MONTH) g(m) WHERE m::DATE NOT IN (SELECT date_trunc('month', service_date)::DATE FROM claims WHERE service_date IS NOT NULL)"))(lambda t: readers.missing_months(t.spark, t.claims.where("service_date is not null"), "service_date", date(1994, 6, 1), date(2002, 3, 1)))
query("partition_lag", sql("SELECT boundary, n AS rows, lag(boundary) OVER (ORDER BY boundary) AS lower_boundary FROM (SELECT date_trunc('month', service_date)::DATE AS boundary, count(*) AS n FROM claims WHERE service_date IS NOT NULL GROUP BY 1)"))(lambda t: readers.partition_lag(t.claims))
query("latest_claims", sql("SELECT claim_id, created_date FROM claims ORDER BY created_date DESC, claim_key LIMIT 10"))(lambda t: t.claims.orderBy(F.desc("created_date"), "claim_key").limit(10).select("claim_id", "created_date"))
query("claim_by_id", sql("SELECT claim_id, facility_id, status, total_charge FROM claims WHERE claim_id = '42'"))(lambda t: readers.by_key(t.claims, "claim_id", "42").select("claim_id", "facility_id", "status", "total_charge"))
query("dq_violations", sql("""SELECT 'facility_type_check' AS "constraint", count(*) FILTER (facility_type NOT IN ('Teaching', 'Non-Teaching')) AS violations FROM facilities UNION ALL SELECT 'critical_access_check', count(*) FILTER (critical_access NOT IN ('Y', 'N')) FROM facilities
  UNION ALL SELECT 'claim_id_unique', count(*) FROM (SELECT claim_id FROM claims GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'claim_facility_exists', count(*) FROM claims WHERE facility_id IS NOT NULL AND facility_id NOT IN (SELECT facility_id FROM facilities)
  UNION ALL SELECT 'claim_class_exists', count(*) FROM claims WHERE financial_class_id IS NOT NULL AND financial_class_id NOT IN (SELECT financial_class_id FROM financial_classes) UNION ALL SELECT 'line_number_range', count(*) FROM lines WHERE line_number NOT BETWEEN 1 AND 99 UNION ALL SELECT 'line_units_positive', count(*) FROM lines WHERE units <= 0"""))(validation.quality_violations)

# -- changes ------------------------------------------------------------------------------------


def _existing(t: Tables) -> DataFrame:
    return t.claims.where("claim_key % 2 = 0").select("claim_id", "status", "created_date", F.col("created_date").alias("updated_date"))


def _incoming_all(t: Tables) -> DataFrame:
    """All keys that _existing lacks, and every third claim, so that both sides together cover the claims."""
    return t.claims.where("claim_key % 2 <> 0 OR claim_key % 3 = 0").select("claim_id", F.lit("PENDING").alias("status"), "created_date", F.lit(None).cast("timestamp_ntz").alias("updated_date"))


_TWO_ALL = " old AS (SELECT claim_id, claim_key, status, created_date, created_date AS updated_date FROM claims WHERE claim_key % 2 = 0), fresh AS (SELECT claim_id, claim_key, 'PENDING' AS status, created_date FROM claims WHERE claim_key % 2 <> 0 OR claim_key % 3 = 0)"
query("upsert_claims_all", sql("SELECT claim_id, status, CASE WHEN claim_key % 3 = 0 THEN {C} ELSE updated_date END AS updated_date, CASE WHEN claim_key % 3 = 0 THEN 'updated' ELSE 'kept' END AS change FROM old UNION ALL SELECT claim_id, status, {C}, 'inserted' FROM fresh WHERE claim_key % 2 <> 0", _TWO_ALL))(lambda t: dml.upsert(_existing(t), _incoming_all(t), "claim_id", P.as_of_claims).select("claim_id", "status", "updated_date", "change"))
query("insert_if_absent_all", sql("SELECT claim_id, status FROM old UNION ALL SELECT claim_id, status FROM fresh WHERE claim_key % 2 <> 0", _TWO_ALL))(lambda t: dml.insert_absent(_existing(t), _incoming_all(t), ["claim_id"]).select("claim_id", "status"))
query("merge_latest_all", sql("SELECT claim_id, CASE WHEN claim_key % 3 = 0 THEN 'PENDING' ELSE status END AS status FROM old UNION ALL SELECT claim_id, status FROM fresh WHERE claim_key % 2 <> 0", _TWO_ALL))(lambda t: dml.merge_latest(_existing(t), _incoming_all(t), ["claim_id"], "created_date").select("claim_id", "status"))
for _name in ("phi_masking", "upsert_claims", "insert_if_absent", "merge_latest"):  # earlier names, over all claims too
    QUERIES[_name], ORACLE[_name] = QUERIES[f"{_name}_all"], ORACLE[f"{_name}_all"]
query("bulk_status_update", sql("SELECT claim_id, claim_key % 7 = 0 AS changed, CASE WHEN claim_key % 7 = 0 THEN 'COMPLETED_EXPORTED_TO_PROD' ELSE status END AS status, exported OR claim_key % 7 = 0 AS exported FROM claims"))(lambda t: dml.set_status(t.claims, t.claims.where("claim_key % 7 = 0"), "claim_id", "COMPLETED_EXPORTED_TO_PROD", P.as_of_claims).select("claim_id", "changed", "status", "exported"))
query("bulk_assign_facility", sql("SELECT claim_id, CASE WHEN claim_key % 11 = 0 AND service_date IS NOT NULL THEN 'FAC001' ELSE facility_id END AS facility_id, coalesce(claim_key % 11 = 0 AND service_date IS NOT NULL, false) AS assigned FROM claims"))(lambda t: dml.assign_facility(t.claims, t.claims.where("claim_key % 11 = 0"), t.facilities, "FAC001").select("claim_id", "facility_id", "assigned"))
query("resolve_failed", sql("SELECT failed_id, CASE WHEN failed_id % 2 = 0 THEN 'Resolved - Manual' ELSE status END AS status, CASE WHEN failed_id % 2 = 0 THEN {E} ELSE resolved_at END AS resolved_at, CASE WHEN failed_id % 2 = 0 THEN 'checked' END AS resolution_notes, CASE WHEN failed_id % 2 = 0 THEN 'ops' END AS resolved_by FROM failed_claims"))(
    lambda t: failed.resolve(t.failed_claims, t.failed_claims.where("failed_id % 2 = 0").select("failed_id", F.lit("Resolved - Manual").alias("new_status"), F.lit("checked").alias("notes"), F.lit("ops").alias("resolved_by")), P.as_of_events).select("failed_id", "status", "resolved_at", "resolution_notes", "resolved_by"))
query("archive_split", sql("SELECT claim_id, coalesce(status = 'COMPLETED' AND processed_date < TIMESTAMP '1999-01-01', false) AS archived FROM claims"))(lambda t: (lambda pair: pair[0].select("claim_id", F.lit(True).alias("archived")).unionByName(pair[1].select("claim_id", F.lit(False).alias("archived"))))(dml.archive(t.claims, P.as_of_claims.replace(year=1999, month=1, day=1))))
query("retention_orphans", sql("SELECT result_id, claim_id FROM validation_results WHERE claim_id NOT IN (SELECT claim_id FROM claims WHERE NOT coalesce(exported AND processed_date < {C} - INTERVAL 90 DAY, false))"))(lambda t: dml.orphans(t.validation_results, dml.retain(t.claims, t.validation_results, P.as_of_claims, 90)[0]).select("result_id", "claim_id"))
query("purge_resolved", sql("SELECT failed_id FROM failed_claims WHERE NOT (status = 'Resolved' AND coalesce(resolved_at < {E} - INTERVAL 10 DAY, false))"))(lambda t: dml.purge_resolved(t.failed_claims, P.as_of_events, 10).select("failed_id"))
query("touch_on_change", sql("SELECT claim_id, claim_key % 5 = 0 AND facility_id IS NOT NULL AS changed, CASE WHEN claim_key % 5 = 0 AND facility_id IS NOT NULL THEN {C} ELSE created_date END AS updated_date FROM claims"))(
    lambda t: dml.touch(t.claims.withColumn("updated_date", F.col("created_date")), t.claims.withColumn("facility_id", F.when(F.col("claim_key") % 5 != 0, F.col("facility_id"))).withColumn("updated_date", F.col("created_date")), "claim_id", ["facility_id", "status"], P.as_of_claims).select("claim_id", "changed", "updated_date"))

# -- metrics, errors, alerts ----------------------------------------------------------------------

query("metric_windows", sql("""SELECT metric, type, w AS window, count(*) AS n, (CASE WHEN type IN ('counter', 'gauge') THEN arg_max(value, (ts, point_id)) ELSE sum(value) END)::DECIMAL(18,2) AS sum_value, (CASE WHEN type IN ('counter', 'gauge') THEN arg_max(value, (ts, point_id)) ELSE min(value) END)::DECIMAL(18,2) AS min_value,
  (CASE WHEN type IN ('counter', 'gauge') THEN arg_max(value, (ts, point_id)) ELSE max(value) END)::DECIMAL(18,2) AS max_value, CASE WHEN type IN ('counter', 'gauge') THEN arg_max(value, (ts, point_id))::DOUBLE ELSE sum(value)::DOUBLE / count(value) END AS avg_value
  FROM (SELECT *, name || '{bucket=' || bucket || '}' AS metric FROM metric_points) JOIN (VALUES ('1h', 60), ('6h', 360), ('24h', 1440), ('7d', 10080)) v(w, m) ON ts >= {E} - to_minutes(m) GROUP BY 1, 2, 3"""))(lambda t: monitoring.metric_windows(t.metric_points, P.as_of_events))
query("histogram_nearest_rank", sql("SELECT name, type, len(v)::BIGINT AS n, v[1] AS min_value, v[len(v)] AS max_value, m AS avg_value, " + ", ".join(f"v[least(floor(len(v) * {p / 100}::DOUBLE)::BIGINT, len(v) - 1) + 1] AS p{p}" for p in (50, 90, 95, 99)) + f", CASE WHEN type = 'timer' THEN m * 1000 END AS avg_ms FROM (SELECT name, type, list_sort(list(value::DOUBLE)) AS v, {mean('value')} AS m FROM metric_points WHERE type IN ('histogram', 'timer') GROUP BY 1, 2)"))(lambda t: monitoring.nearest_rank(t.metric_points))
query("business_health_score", sql(f"SELECT *, greatest(100 - (CASE WHEN error_rate > 10 THEN 30 WHEN error_rate > 5 THEN 15 ELSE 0 END) - (CASE WHEN per_second < 1000 THEN 20 ELSE 0 END) - (CASE WHEN avg_value > 10 THEN 15 ELSE 0 END), 0)::INTEGER AS health_score FROM (SELECT *, round(errors * 100.0::DOUBLE / n, 6) AS error_rate, n / 86400.0::DOUBLE AS per_second FROM (SELECT count(*) AS n, count(*) FILTER (name = 'error') AS errors, {mean('value')} AS avg_value FROM metric_points WHERE ts >= {{E}} - INTERVAL 48 HOUR)) ".replace("86400.0", "172800.0")))(lambda t: monitoring.health_score(t.metric_points, P.as_of_events, 48))
query("error_distributions", sql("SELECT dimension, value, count(*) AS n FROM (SELECT unnest(['code', 'category', 'component', 'severity', 'impact', 'hour']) AS dimension, unnest([code, category, component, severity, impact, strftime(ts, '%Y-%m-%d-%H')]) AS value FROM error_metrics) GROUP BY 1, 2"))(lambda t: monitoring.error_distributions(t.error_metrics))
query("error_rate", sql("SELECT category, count(*) / 10080.0::DOUBLE AS per_minute FROM error_metrics WHERE ts >= {E} - INTERVAL 7 DAY GROUP BY 1"))(lambda t: monitoring.error_rate(t.error_metrics, P.as_of_events, 10080))
query("error_clusters", sql("SELECT category || '_' || component AS cluster, count(*) AS n, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, min(ts) AS first_seen, max(ts) AS last_seen FROM error_metrics GROUP BY 1"))(lambda t: monitoring.error_clusters(t.error_metrics))
query("error_temporal", sql("SELECT kind, slot, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, slot) = 1 AS is_peak FROM (SELECT kind, slot, count(*) AS n FROM (SELECT unnest(['hour', 'weekday']) AS kind, unnest([strftime(ts, '%H'), dayname(ts)]) AS slot FROM error_metrics) GROUP BY 1, 2)"))(lambda t: monitoring.error_temporal(t.error_metrics))
query("error_cooccurrence", sql("SELECT a.code AS code_a, b.code AS code_b, count(*) AS buckets FROM c a JOIN c b ON a.bucket = b.bucket AND a.code < b.code GROUP BY 1, 2 HAVING count(*) >= 2", " c AS (SELECT DISTINCT time_bucket(INTERVAL 30 MINUTE, ts) AS bucket, code FROM error_metrics)"))(lambda t: monitoring.error_cooccurrence(t.error_metrics))
query("recovery_effectiveness", sql("SELECT coalesce(category || '_' || code, 'overall') AS key, count(*) AS attempts, count(*) FILTER (recovered) AS successes, round(count(*) FILTER (recovered) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM error_metrics WHERE attempted GROUP BY ROLLUP (category || '_' || code)"))(lambda t: monitoring.recovery_effectiveness(t.error_metrics))
query("operation_stats", sql(f"SELECT name, bucket, count(*) AS n, {money('value')} AS sum_value, min(value)::DECIMAL(18,2) AS min_value, max(value)::DECIMAL(18,2) AS max_value, {mean('value')} AS avg_value, {rate('count(*) FILTER (value < 100)', 'count(*)')} AS success_rate FROM (SELECT * FROM metric_points QUALIFY row_number() OVER (PARTITION BY name, bucket ORDER BY ts DESC, point_id DESC) <= 1000) GROUP BY 1, 2"))(lambda t: monitoring.operation_stats(t.metric_points))
query("keep_last_n", sql("SELECT name, point_id, row_number() OVER (PARTITION BY name ORDER BY ts DESC, point_id DESC)::INTEGER AS place FROM metric_points QUALIFY place <= 100"))(lambda t: monitoring.keep_last(t.metric_points, 100).select("name", "point_id", "place"))
query("rolling_avg_100", sql("SELECT point_id, (sum(value) OVER w)::DOUBLE / count(value) OVER w AS rolling_avg FROM metric_points WINDOW w AS (PARTITION BY name ORDER BY ts, point_id ROWS 99 PRECEDING)"))(lambda t: monitoring.rolling_mean(t.metric_points).select("point_id", "rolling_avg"))
query("ema_latency", sql("SELECT point_id, round(list_reduce(v, lambda acc, x: acc * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS ema FROM (SELECT point_id, list(value::DOUBLE) OVER (PARTITION BY name ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS v FROM metric_points)"))(lambda t: monitoring.moving_average(t.metric_points).select("point_id", F.round("ema", 6).alias("ema")))
query("ema_latency_exact", sql("SELECT point_id, round(list_reduce(v, lambda acc, x: acc * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS ema FROM (SELECT point_id, list(value::DOUBLE) OVER (PARTITION BY name ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS v FROM metric_points)"))(lambda t: monitoring.moving_average(t.metric_points).select("point_id", F.round("ema", 6).alias("ema")))
query("trailing_5m_rate", sql("SELECT point_id, round(n / greatest(epoch_us(ts) - first, 1000000)::DOUBLE * 1000000, 6) AS rate FROM (SELECT point_id, ts, count(*) OVER w AS n, min(epoch_us(ts)) OVER w AS first FROM metric_points WINDOW w AS (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))"))(lambda t: monitoring.trailing_rate(t.metric_points, 3600).select("point_id", F.round("rate", 6).alias("rate")))
query("failure_streaks", sql("SELECT point_id, (sum(failed::INTEGER) OVER (PARTITION BY name, run ORDER BY ts, point_id))::BIGINT AS streak FROM (SELECT *, sum((NOT failed)::INTEGER) OVER (PARTITION BY name ORDER BY ts, point_id) AS run FROM (SELECT *, value > 12 AS failed FROM metric_points))"))(lambda t: monitoring.streaks(t.metric_points.withColumn("failed", F.col("value") > 12)).select("point_id", "streak"))
query("alert_statistics", sql("SELECT stage, count(*) AS total, count(*) FILTER (status = 'Resolved') AS resolved, count(*) FILTER (status <> 'Resolved') AS active, sum(date_sub('second', failed_at, resolved_at))::DOUBLE / count(resolved_at) AS avg_seconds, max(date_sub('second', failed_at, resolved_at)) AS max_seconds FROM failed_claims GROUP BY 1"))(lambda t: monitoring.alert_statistics(t.failed_claims))
query("health_rollup", sql("SELECT *, CASE WHEN unhealthy > 0 THEN 'unhealthy' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM (SELECT count(*) FILTER (v <= 12) AS healthy, count(*) FILTER (v > 12 AND v <= 20) AS degraded, count(*) FILTER (v > 20) AS unhealthy FROM (SELECT name, sum(value)::DOUBLE / count(value) AS v FROM metric_points WHERE ts >= {E} - INTERVAL 1 DAY GROUP BY 1))"))(lambda t: monitoring.health_rollup(t.metric_points, P.as_of_events))
_HIT = "count(*) FILTER (bucket = '0')"
query("api_metrics", sql(f"SELECT name, count(*) AS n, {mean('value')} AS avg_value, min(value)::DECIMAL(18,2) AS min_value, max(value)::DECIMAL(18,2) AS max_value, {rate(_HIT, 'count(*)')} AS hit_ratio FROM (SELECT * FROM metric_points QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, point_id DESC) <= 1000) GROUP BY 1"))(lambda t: monitoring.api_metrics(t.metric_points))
query("fired_alerts", sql("SELECT 'high_error_rate' AS rule, 'pipeline' AS component, 'HIGH' AS severity, 'Error rate above 10 %' AS message FROM metric_points WHERE ts >= {E} - INTERVAL 48 HOUR HAVING count(*) FILTER (name = 'error') * 100.0 / count(*) > 10 UNION ALL SELECT 'low_throughput', 'pipeline', 'MEDIUM', 'Throughput below 10 a second' FROM metric_points WHERE ts >= {E} - INTERVAL 48 HOUR HAVING count(*) / 172800.0 < 10 UNION ALL SELECT 'slow_operations', 'pipeline', 'LOW', 'Mean time above 10' FROM metric_points WHERE ts >= {E} - INTERVAL 48 HOUR HAVING sum(value)::DOUBLE / count(value) > 10"))(lambda t: monitoring.fire_alerts(monitoring.health_score(t.metric_points, P.as_of_events, 48)))
query("training_imputation", sql(f"SELECT claim_id, coalesce(charge, (SELECT quantile_cont(charge, 0.5) FROM x)) AS charge, coalesce(facility_id, (SELECT facility_id FROM (SELECT facility_id, count(*) AS n FROM x WHERE facility_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, facility_id LIMIT 1))) AS facility_id FROM x", " x AS (SELECT claim_id, facility_id, CASE WHEN claim_key % 10 <> 0 THEN total_charge::DOUBLE END AS charge FROM claims)"))(
    lambda t: scoring.impute(t.claims.select("claim_id", "facility_id", F.when(F.col("claim_key") % 10 != 0, F.col("total_charge").cast("double")).alias("charge")), ["charge"], ["facility_id"]))


@query("rf_train_eval")
def rf_train_eval(t: Tables) -> DataFrame:
    """Trains on the formula's classes and reports each class; trained trees have no SQL form."""
    x = scoring.formula_predictions(scoring.features(t.claims, t.lines, t.diagnoses)).select(*scoring.FEATURES, F.col("prediction").cast("string").alias("target"))
    model, rest = scoring.train(x, scoring.FEATURES, "target")
    names = F.element_at(F.array(*[F.lit(s) for s in model.stages[0].labels]), (F.col("prediction") + 1).cast("int"))
    return scoring.class_report(rest.withColumn("guess", names), "target", "guess")


# -- streams --------------------------------------------------------------------------------------

query("stream_tumbling", sql("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"))(lambda t: jobs.tumbling(t))
query("stream_sliding", sql("SELECT s AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2"))(lambda t: jobs.sliding(t))
query("stream_dedup", sql("SELECT event_id, user_id FROM events"))(lambda t: jobs.deduplicated(t))
query("stream_pipeline", sql("SELECT facility_id, count(*) AS claims, count(*) FILTER (is_valid) AS valid_claims FROM validated GROUP BY 1"))(lambda t: jobs.pipeline(t, P))
