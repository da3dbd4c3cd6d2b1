"""DuckDB SQL that states the claims model over the driver's tables and each query's expected rows."""

from __future__ import annotations

AS_OF_CLAIMS = "TIMESTAMP '2001-08-02 00:00:00'"
AS_OF_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"
CENT = "0.01::DECIMAL(3,2)"

MODEL = f"""
regions AS (SELECT r_regionkey AS region_id, r_name AS region_name FROM region),
organizations AS (SELECT DISTINCT n_nationkey % 5 AS organization_id, 'ORG' || (n_nationkey % 5) AS organization_name FROM nation),
facilities AS (
  SELECT 'FAC' || lpad(n_nationkey::VARCHAR, 3, '0') AS facility_id, n_name AS facility_name, n_nationkey % 5 AS organization_id, n_regionkey AS region_id,
    CASE WHEN n_nationkey % 2 = 0 THEN 'Teaching' ELSE 'Non-Teaching' END AS facility_type, CASE WHEN n_nationkey % 7 = 0 THEN 'Y' ELSE 'N' END AS critical_access, n_nationkey NOT IN (3, 17) AS active FROM nation),
payers AS (
  SELECT payer_id, payer_name, CASE least(payer_id, 5) WHEN 1 THEN 'Commercial' WHEN 2 THEN 'Government' WHEN 3 THEN 'Managed Care' WHEN 4 THEN 'Self-Pay' ELSE 'Other' END AS payer_category
  FROM (SELECT payer_name, row_number() OVER (ORDER BY payer_name)::INTEGER AS payer_id FROM (SELECT DISTINCT c_mktsegment AS payer_name FROM customer))),
financial_classes AS (
  SELECT 'FC' || p || '_' || lpad(n_nationkey::VARCHAR, 3, '0') AS financial_class_id, 'Class ' || p AS description, CASE WHEN p <> 5 THEN 'FAC' || lpad(n_nationkey::VARCHAR, 3, '0') END AS facility_id,
    p::INTEGER AS payer_id, NOT (p = 4 AND n_nationkey % 10 = 0) AS active FROM nation, range(1, 6) r(p)),
departments AS (SELECT s_suppkey AS department_id, s_name AS department_name, 'FAC' || lpad(s_nationkey::VARCHAR, 3, '0') AS facility_id, s_acctbal >= 0 AS active FROM supplier),
rvu AS (SELECT p_partkey::VARCHAR AS cpt_code, (((round(p_retailprice * 100)::BIGINT + 50) // 100)::DECIMAL(18,0) * {CENT})::DECIMAL(10,2) AS rvu_value FROM part WHERE p_size <> 13),
claims0 AS (
  SELECT o_orderkey::VARCHAR AS claim_id, o_orderkey AS claim_key,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'FAC999' ELSE 'FAC' || lpad(c_nationkey::VARCHAR, 3, '0') END AS facility_id,
    CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE 'FC' || left(o_orderpriority, 1) || '_' || lpad(c_nationkey::VARCHAR, 3, '0') END AS financial_class_id,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN '   ' ELSE 'ACC' || lpad(o_custkey::VARCHAR, 10, '0') END AS account,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN DATE '2001-09-01' ELSE o_orderdate::DATE END AS service_date,
    o_custkey AS patient_id, 18 + o_custkey % 73 AS patient_age, (((round(o_totalprice * 100)::BIGINT + 11) // 22)::DECIMAL(18,0) * {CENT})::DECIMAL(12,2) AS total_charge,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS status, o_orderstatus = 'F' AS exported, o_orderdate + to_minutes(o_orderkey % 1440) AS created_date,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(o_orderkey % 1440) + to_minutes(o_orderkey % 500) END AS processed_date, department_id,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 13 = 0 THEN 'FAILED' ELSE 'VALIDATED' END END AS validation_status
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS department_id FROM lineitem GROUP BY l_orderkey) d ON d.l_orderkey = o_orderkey),
claims AS (SELECT *, service_date + 90 AS end_date FROM claims0),
lines AS (
  SELECT l_orderkey::VARCHAR AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)::INTEGER AS line_number, l_partkey::VARCHAR AS cpt_code,
    CASE WHEN l_partkey % 41 = 0 THEN 0 ELSE l_quantity::INTEGER END AS units, (round(l_extendedprice * 100)::BIGINT::DECIMAL(18,0) * {CENT})::DECIMAL(12,2) AS line_charge, l_shipdate::DATE AS line_date FROM lineitem),
diagnoses AS (
  SELECT * FROM (SELECT claim_id, icd_code, row_number() OVER (PARTITION BY claim_id ORDER BY icd_code)::INTEGER AS sequence FROM (SELECT DISTINCT l_orderkey::VARCHAR AS claim_id, p_brand AS icd_code FROM lineitem JOIN part ON p_partkey = l_partkey)) WHERE sequence <= 12),
ev AS (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k, (round(value * 100)::BIGINT::DECIMAL(18,0) * {CENT})::DECIMAL(12,2) AS cents FROM events),
validation_results AS (
  SELECT event_id AS result_id, user_id::VARCHAR AS claim_id, ts AS created_date, CASE event_type WHEN 'click' THEN 'FACILITY' WHEN 'view' THEN 'BUSINESS_RULES' WHEN 'purchase' THEN 'ML_FILTER' WHEN 'signup' THEN 'DATALOG_RULE' ELSE 'MEDICAL' END AS validation_type,
    CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 'FAILED' ELSE 'PASSED' END AS validation_status, 'E' || (k % 4) AS error_type, k / 100.0::DOUBLE AS confidence, cents AS processing_ms,
    CASE WHEN event_type = 'purchase' THEN cents END AS inference_ms, CASE WHEN user_id % 7 <> 0 THEN 'v' || (user_id % 3) END AS model_version FROM ev),
failed_claims AS (
  SELECT event_id AS failed_id, user_id::VARCHAR AS original_claim_id, 'FAC' || lpad((user_id % 25)::VARCHAR, 3, '0') AS facility_id, CASE event_id % 4 WHEN 0 THEN 'VALIDATION' WHEN 1 THEN 'ML' WHEN 2 THEN 'PRICING' ELSE 'EXPORT' END AS stage,
    CASE event_id % 5 WHEN 0 THEN 'New' WHEN 1 THEN 'Pending Review' WHEN 2 THEN 'In Progress' ELSE 'Resolved' END AS status, ts AS failed_at, CASE WHEN event_id % 5 >= 3 THEN ts + to_minutes(floor(value)::BIGINT) END AS resolved_at,
    CASE event_id % 4 WHEN 0 THEN 'CORE_FAC_01' WHEN 1 THEN 'CORE_FAC_02' WHEN 2 THEN 'CORE_PAT_01' ELSE 'CORE_FC_01' END AS error_codes,
    CASE event_id % 4 WHEN 0 THEN 'Facility ID is missing.' WHEN 1 THEN 'Facility not found or inactive.' WHEN 2 THEN 'Patient Account Number is missing.' ELSE 'Financial class is missing.' END AS error_messages FROM ev WHERE event_type = 'error'),
metric_points AS (SELECT event_id AS point_id, event_type AS name, CASE event_id % 4 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' WHEN 2 THEN 'histogram' ELSE 'timer' END AS type, ts, cents AS value, (user_id % 3)::VARCHAR AS bucket FROM ev),
error_metrics AS (
  SELECT event_id, ts, 'E' || (k % 8) AS code, CASE k % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'validation' WHEN 2 THEN 'ml' ELSE 'system' END AS category, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
    CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'degraded' ELSE 'outage' END AS impact, CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'rules' ELSE 'export' END AS component, event_id % 2 = 0 AS attempted, event_id % 6 = 0 AS recovered FROM ev WHERE event_type = 'error' AND k IS NOT NULL),
facts AS (
  SELECT c.*, coalesce(f.active, false) AS facility_active, coalesce(fc.active AND fc.facility_id = c.facility_id, false) AS fc_active
  FROM claims c LEFT JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN financial_classes fc ON fc.financial_class_id = c.financial_class_id),
checked AS (
  SELECT *, list_filter([
    CASE WHEN facility_id IS NULL THEN 'CORE_FAC_01|facility_id|Facility ID is missing.' END,
    CASE WHEN facility_id IS NOT NULL AND NOT facility_active THEN 'CORE_FAC_02|facility_id|Facility ID ''' || facility_id || ''' not found or is inactive.' END,
    CASE WHEN account IS NULL OR trim(account) = '' THEN 'CORE_PAT_01|patient_account_number|Patient Account Number is missing or empty.' END,
    CASE WHEN service_date IS NULL THEN 'CORE_DATE_01|service_date|Claim service_date is missing.' END,
    CASE WHEN service_date > DATE '2001-08-02' THEN 'CORE_DATE_02|service_date|Claim service_date cannot be in the future.' END,
    CASE WHEN financial_class_id IS NULL THEN 'CORE_FC_01|financial_class_id|Financial Class ID is missing.' END,
    CASE WHEN financial_class_id IS NOT NULL AND facility_active AND NOT fc_active THEN 'CORE_FC_03|financial_class_id|Financial Class ''' || financial_class_id || ''' not valid for facility ''' || facility_id || '''.' END], lambda x: x IS NOT NULL) AS core_errors,
  list_filter([
    CASE WHEN facility_id IS NOT NULL AND NOT facility_active THEN 'FACILITY_INACTIVE|facility_id|Facility ID on claim does not exist or is inactive' END,
    CASE WHEN total_charge < 50 THEN 'CHARGE_TOO_LOW|total_charge_amount|Total charge amount is less than 50' END,
    CASE WHEN total_charge > 20000 THEN 'CHARGE_TOO_HIGH|total_charge_amount|Total charge amount is over 20000' END], lambda x: x IS NOT NULL) AS rule_errors FROM facts),
validated AS (SELECT *, list_concat(core_errors, rule_errors) AS errors, len(core_errors) = 0 AS core_valid, len(rule_errors) = 0 AS rules_valid, len(core_errors) = 0 AND len(rule_errors) = 0 AS is_valid, facility_active AS facility_validated FROM checked),
priced AS (
  SELECT l.*, rvu_value, CASE WHEN units <= 0 THEN 'INVALID_UNITS' WHEN rvu_value IS NULL THEN 'RVU_NOT_FOUND' ELSE 'CALCULATED_OK' END AS pricing_status,
    CASE WHEN units > 0 AND rvu_value IS NOT NULL THEN round(rvu_value * units::DECIMAL(6,0) * 36.04::DECIMAL(6,2), 2)::DECIMAL(18,2) ELSE 0.00::DECIMAL(18,2) END AS amount FROM lines l LEFT JOIN rvu USING (cpt_code)),
paid AS (SELECT c.claim_id, coalesce(sum(p.amount), 0)::DECIMAL(18,2) AS reimbursement, count(p.claim_id) AS priced_lines FROM claims c LEFT JOIN priced p USING (claim_id) GROUP BY c.claim_id),
feats AS (
  SELECT c.claim_id, total_charge::DOUBLE AS f_charge, coalesce(nullif(patient_age, 0), 30)::INTEGER AS f_age, coalesce(d.n, 0) AS f_diagnoses, coalesce(l.n, 0) AS f_lines
  FROM claims c LEFT JOIN (SELECT claim_id, count(*) AS n FROM diagnoses GROUP BY 1) d USING (claim_id) LEFT JOIN (SELECT claim_id, count(*) AS n FROM lines GROUP BY 1) l USING (claim_id)),
gated AS (
  SELECT *, CASE WHEN confidence < 0.8 THEN 'FILTER_ML_LOW_CONFIDENCE_FALLBACK' ELSE 'ML_FILTER_' || prediction END AS assigned_filter, confidence < 0.8 AS fallback
  FROM (SELECT *, (score % 4)::INTEGER AS prediction, (50.0::DOUBLE + score / 2.0::DOUBLE) / 100.0::DOUBLE AS confidence FROM (SELECT *, (f_age * 7 + f_diagnoses * 13 + f_lines * 3 + floor(f_charge)::BIGINT) % 100 AS score FROM feats))),
disposed AS (
  SELECT v.*, assigned_filter, confidence, fallback, CASE WHEN NOT is_valid THEN 'VALIDATION_FAILED_RULES' WHEN fallback THEN 'ML_LOW_CONFIDENCE_FALLBACK' ELSE 'VALIDATED_RULES_PASSED' END AS disposition_reason,
    CASE WHEN is_valid THEN 'COMPLETED_EXPORTED_TO_PROD' ELSE 'VALIDATION_FAILED_RULES' END AS final_status FROM validated v LEFT JOIN gated USING (claim_id))
"""


def sql(body: str, ctes: str = "") -> str:
    text = f"WITH {MODEL.strip()}{',' + ctes if ctes else ''}\n{body}"
    return text.replace("{C}", AS_OF_CLAIMS).replace("{E}", AS_OF_EVENTS)


def mean(c: str) -> str:
    return f"sum({c})::DOUBLE / count({c})"


def money(c: str) -> str:
    return f"sum({c})::DECIMAL(18,2)"


def rate(a: str, b: str) -> str:
    return f"round({a} * 100.0::DOUBLE / nullif({b}, 0), 6)"
