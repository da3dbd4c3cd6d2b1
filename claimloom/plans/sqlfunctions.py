"""Table functions for SQL: registered in a session, with arguments that may be left out.

    register(tables)
    spark.sql("SELECT * FROM fn_facility_summary('FAC007')")
    spark.sql("SELECT * FROM fn_facility_summary()")

A call is replaced by its body before the plan is optimised, so an argument
becomes a filter like any other and a missing one (null) leaves no filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dml
from ..sources.testdata import Tables
from .oracle import sql
from .queries import _TWO_ALL, P, _existing, _incoming_all, query

VIEWS = ("facilities", "organizations", "regions", "departments", "financial_classes", "claims")

FUNCTIONS = {
    "fn_facility_summary": (
        "facility STRING DEFAULT NULL",
        "facility_id STRING, facility_name STRING, facility_type STRING, critical_access STRING, organization_name STRING, region_name STRING, total_claims BIGINT, pending_claims BIGINT,"
        " completed_claims BIGINT, total_charges DECIMAL(18,2), avg_charge DOUBLE, active_departments BIGINT, active_financial_classes BIGINT",
        """
        SELECT f.facility_id, f.facility_name, f.facility_type, f.critical_access, o.organization_name, r.region_name, coalesce(c.n, 0), coalesce(c.pending, 0),
          coalesce(c.completed, 0), cast(coalesce(c.charges, 0) AS DECIMAL(18,2)), coalesce(c.mean, 0), coalesce(d.n, 0), coalesce(k.n, 0)
        FROM loom_facilities f
        LEFT JOIN loom_organizations o ON o.organization_id = f.organization_id
        LEFT JOIN loom_regions r ON r.region_id = f.region_id
        LEFT JOIN (
          SELECT facility_id, count(*) AS n, count_if(status = 'PENDING') AS pending, count_if(status = 'COMPLETED') AS completed, sum(total_charge) AS charges,
            cast(sum(total_charge) AS DOUBLE) / count(total_charge) AS mean FROM loom_claims GROUP BY facility_id) c ON c.facility_id = f.facility_id
        LEFT JOIN (SELECT facility_id, count(*) AS n FROM loom_departments WHERE active GROUP BY facility_id) d ON d.facility_id = f.facility_id
        LEFT JOIN (SELECT facility_id, count(*) AS n FROM loom_financial_classes WHERE active GROUP BY facility_id) k ON k.facility_id = f.facility_id
        WHERE fn_facility_summary.facility IS NULL OR f.facility_id = fn_facility_summary.facility""",
    ),
    "fn_pending_claims": (
        "as_of TIMESTAMP_NTZ, facility STRING DEFAULT NULL, days INT DEFAULT 30",
        "claim_id STRING, facility_id STRING, total_charge DECIMAL(12,2), service_date DATE, status STRING, created_date TIMESTAMP_NTZ",
        """
        SELECT claim_id, facility_id, total_charge, service_date, status, created_date FROM loom_claims
        WHERE status = 'PENDING' AND (fn_pending_claims.facility IS NULL OR facility_id = fn_pending_claims.facility)
          AND created_date >= fn_pending_claims.as_of - make_dt_interval(fn_pending_claims.days)""",
    ),
    "fn_claims_of_month": (
        "year INT, month INT, facility STRING DEFAULT NULL",
        "claim_id STRING, facility_id STRING, service_date DATE, last_date DATE, total_charge DECIMAL(12,2)",
        """
        SELECT claim_id, facility_id, service_date, last_day(service_date), total_charge FROM loom_claims
        WHERE service_date BETWEEN make_date(fn_claims_of_month.year, fn_claims_of_month.month, 1) AND last_day(make_date(fn_claims_of_month.year, fn_claims_of_month.month, 1))
          AND (fn_claims_of_month.facility IS NULL OR facility_id = fn_claims_of_month.facility)""",
    ),
}


def register(t: Tables) -> None:
    """Puts the functions, and the views named loom_* that they read, into the session, in place of earlier ones."""
    for name in VIEWS:
        getattr(t, name).createOrReplaceTempView(f"loom_{name}")
    for name, (arguments, columns, body) in FUNCTIONS.items():
        t.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")


def call(t: Tables, text: str) -> DataFrame:
    register(t)
    return t.spark.sql(text)


_SUMMARY = """SELECT f.facility_id, facility_name, facility_type, critical_access, organization_name, region_name, (SELECT count(*) FROM claims c WHERE c.facility_id = f.facility_id) AS total_claims,
  (SELECT count(*) FROM claims c WHERE c.facility_id = f.facility_id AND status = 'PENDING') AS pending_claims, (SELECT count(*) FROM claims c WHERE c.facility_id = f.facility_id AND status = 'COMPLETED') AS completed_claims,
  (SELECT coalesce(sum(total_charge), 0)::DECIMAL(18,2) FROM claims c WHERE c.facility_id = f.facility_id) AS total_charges, (SELECT coalesce(sum(total_charge)::DOUBLE / count(total_charge), 0) FROM claims c WHERE c.facility_id = f.facility_id) AS avg_charge,
  (SELECT count(*) FROM departments d WHERE d.facility_id = f.facility_id AND active) AS active_departments, (SELECT count(*) FROM financial_classes k WHERE k.facility_id = f.facility_id AND active) AS active_financial_classes
FROM facilities f LEFT JOIN organizations o USING (organization_id) LEFT JOIN regions r ON r.region_id = f.region_id"""
_RECENT = "SELECT claim_id, facility_id, total_charge, service_date, status, created_date FROM claims WHERE status = 'PENDING' AND created_date >= {C} - to_days(%d)"

query("sql_facility_summary", sql(f"SELECT 'one' AS asked, * FROM ({_SUMMARY}) WHERE facility_id = 'FAC007' UNION ALL SELECT 'all', * FROM ({_SUMMARY})"))(
    lambda t: call(t, "SELECT 'one' AS asked, * FROM fn_facility_summary('FAC007') UNION ALL SELECT 'all', * FROM fn_facility_summary()"))
query("sql_pending_claims", sql(f"SELECT 'recent' AS asked, * FROM ({_RECENT % 30}) UNION ALL SELECT 'one', * FROM ({_RECENT % 900}) WHERE facility_id = 'FAC004'"))(
    lambda t: call(t, f"SELECT 'recent' AS asked, * FROM fn_pending_claims(TIMESTAMP_NTZ'{P.as_of_claims}') UNION ALL SELECT 'one', * FROM fn_pending_claims(TIMESTAMP_NTZ'{P.as_of_claims}', facility => 'FAC004', days => 900)"))
query("sql_claims_of_month", sql("SELECT claim_id, facility_id, service_date, last_day(service_date) AS last_date, total_charge FROM claims WHERE year(service_date) = 1996 AND month(service_date) = 2"))(
    lambda t: call(t, "SELECT * FROM fn_claims_of_month(1996, 2)"))


def batch_of(t: Tables) -> DataFrame:
    """Incoming claims, every fifth of them twice, and the claims of a facility once more without an id."""
    x = _incoming_all(t).select("claim_id")
    lost = t.claims.where("facility_id = 'FAC003'").select(F.lit(None).cast("string").alias("claim_id"))
    return x.unionByName(x.where("cast(claim_id AS BIGINT) % 5 = 0")).unionByName(lost)


_BATCH = _TWO_ALL + """, batch AS (SELECT claim_id FROM fresh UNION ALL SELECT claim_id FROM fresh WHERE claim_key % 5 = 0 UNION ALL SELECT NULL FROM claims WHERE facility_id = 'FAC003'),
told AS (SELECT claim_id, CASE WHEN claim_id IS NULL THEN 'skipped' WHEN claim_id IN (SELECT claim_id FROM old) OR row_number() OVER (PARTITION BY claim_id) > 1 THEN 'updated' ELSE 'inserted' END AS what FROM batch)"""
query("insert_batch_counts", sql("SELECT count(*) FILTER (what = 'inserted') AS inserted, count(*) FILTER (what = 'updated') AS updated, count(*) FILTER (what = 'skipped') AS skipped FROM told", _BATCH))(
    lambda t: dml.outcome_counts(_existing(t), batch_of(t), "claim_id"))
query("staging_skips", sql("SELECT claim_id, count(*) AS rows, count(*) FILTER (what = 'inserted') AS inserted FROM told GROUP BY 1 HAVING count(*) > count(*) FILTER (what = 'inserted')", _BATCH))(
    lambda t: dml.outcomes(_existing(t), batch_of(t), "claim_id").where("inserted < in_batch").select("claim_id", F.col("in_batch").alias("rows"), "inserted"))
