"""Analytics views over staging and production, each a function of tables and as-of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, boundaries, count_if, mean, percent, since, total, truncated
from ..operators.pricing import price_lines
from ..operators.validation import facts, validate
from ..params import Params
from ..sources.testdata import Tables


def staged(t: Tables, p: Params) -> DataFrame:
    """Claims with the flags that staging keeps."""
    x = facts(t, t.claims, p)
    return x.withColumns({"facility_validated": F.col("facility_active"), "department_validated": F.col("department_id").isNotNull(), "financial_class_validated": F.col("fc_active")})


def production(t: Tables) -> DataFrame:
    """What the production database holds: here all claims of the source, whatever their status."""
    return t.claims


def _lines(t: Tables) -> DataFrame:
    """Lines carry their claim's service date in staging; a claim without one has no joinable lines."""
    return t.lines


def percentiles(rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """Exact interpolated percentiles of each group, rounded to six digits.

    From counts of distinct values and their running sums, so that no group's
    values are gathered in memory.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    return percentiles_of_counts(counts, keys, **shares)


def percentiles_of_counts(counts: DataFrame, keys: list[str], **shares: float) -> DataFrame:
    """The same from rows of keys, _v and _n: how often each value stands in a group."""
    own = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(own.orderBy("_v"))).withColumn("_all", F.sum("_n").over(own))
    place = {name: (F.col("_all") - 1) * F.lit(share) for name, share in shares.items()}
    at_ = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    ends = [x for name, p in place.items() for x in (at_(F.floor(p)).alias(f"_low_{name}"), at_(F.ceil(p)).alias(f"_high_{name}"), F.max(p - F.floor(p)).alias(f"_part_{name}"))]
    found = ranked.groupBy(*keys).agg(*ends)
    mixed = {name: F.round(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_part_{name}"), 6) for name in shares}
    return found.select(*keys, *[c.alias(name) for name, c in mixed.items()])


def with_percentiles(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """Groups (by keys, nulls included) with the percentiles of their rows; a group without values gets nulls."""
    return joined_null_safe(groups, percentiles(rows, keys, value, **shares), keys, list(shares))


def joined_null_safe(groups: DataFrame, found: DataFrame, keys: list[str], shares: list[str]) -> DataFrame:
    """Groups with columns of found, null keys matching null keys."""
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *shares)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def processing_summary(t: Tables, p: Params) -> DataFrame:
    own = staged(t, p).where(since("created_date", p.as_of_claims, 7, "DAYS"))
    return own.groupBy(truncated("hour", "created_date").alias("processing_hour"), "status", "facility_validated", "department_validated", "financial_class_validated").agg(
        F.count("*").alias("claim_count"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"),
        count_if(F.col("exported")).alias("exported_count"), F.min("service_date").alias("earliest"), F.max("service_date").alias("latest"),
    )


def facility_performance_daily(t: Tables, p: Params) -> DataFrame:
    own = staged(t, p).where(since("service_date", p.as_of_claims, 30, "DAYS"))
    x = own.join(t.facilities.select("facility_id", "facility_name", "facility_type"), "facility_id").join(_lines(t).select("claim_id", "cpt_code"), "claim_id", "left")
    return x.groupBy("facility_id", "facility_name", "facility_type", F.col("service_date").alias("service_day")).agg(
        F.count("claim_id").alias("total_claims"), count_if(F.col("status") == "COMPLETED").alias("completed_claims"), count_if(F.col("facility_validated")).alias("validated_claims"), count_if(F.col("exported")).alias("exported_claims"),
        total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"), F.count_distinct("patient_id").alias("unique_patients"), F.count_distinct("cpt_code").alias("unique_procedures"),
    )


def validation_failure_patterns(t: Tables, p: Params) -> DataFrame:
    own = t.validation_results.where((F.col("validation_status") == "FAILED") & since("created_date", p.as_of_events, 7, "DAYS")).withColumn("validation_day", F.to_date("created_date"))
    keys = ["validation_type", "model_version", "validation_day"]
    errors = own.groupBy(*keys, F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("error_count"))
    # Each result row meets each error type of its group: both sides are summed first and multiplied, which is the join's fan-out.
    kinds = errors.groupBy(*keys).agg(F.count("*").alias("types"), F.array_join(F.array_sort(F.collect_list(F.concat("error_type", F.lit("="), F.col("error_count").cast("string")))), ",").alias("error_type_counts"))
    rows = own.groupBy(*keys).agg(F.count("*").alias("results"), *[f(c).alias(f"{n}_{c}") for c in ("processing_ms", "inference_ms") for n, f in (("sum", F.sum), ("count", F.count))])
    fanned = lambda c: (F.col(f"sum_{c}") * F.col("types")).cast("double") / (F.col(f"count_{c}") * F.col("types"))
    return kinds.join(rows, keys).select(*keys, (F.col("types") * F.col("results")).alias("failure_count"), fanned("processing_ms").alias("avg_processing_ms"), fanned("inference_ms").alias("avg_inference_ms"), "error_type_counts")


def financial_metrics(t: Tables, p: Params) -> DataFrame:
    own = t.claims.where(since("service_date", p.as_of_claims, 90, "DAYS") & F.col("exported"))
    classes = t.financial_classes.select("financial_class_id", F.col("description").alias("fc_description"), "payer_id").join(t.payers.select("payer_id", "payer_category"), "payer_id", "left")
    # Only lines of claims in the window are priced; the window is found in orders alone, before anything is joined.
    priced = price_lines(_lines(t).join(own.select("claim_id"), "claim_id", "left_semi"), t.rvu, p).select("claim_id", "amount")
    x = own.join(t.facilities.select("facility_id", "facility_type"), "facility_id").join(classes, "financial_class_id", "left").join(priced, "claim_id", "left")
    charges, paid = F.sum("total_charge"), F.sum("amount")
    return x.groupBy(F.col("service_date").alias("service_day"), "fc_description", "payer_category", "facility_type").agg(
        F.count("claim_id").alias("claim_count"), charges.cast("decimal(18,2)").alias("total_charges"), paid.cast("decimal(18,2)").alias("total_reimbursement"), mean("total_charge").alias("avg_charge"), mean("amount").alias("avg_reimbursement"),
        F.when(charges > 0, F.round(paid.cast("double") / charges.cast("double"), 6)).alias("reimbursement_ratio"),
    )


def ml_model_performance(t: Tables, p: Params) -> DataFrame:
    own = t.validation_results.where((F.col("validation_type") == "ML_FILTER") & since("created_date", p.as_of_events, p.window_days, "DAYS") & F.col("inference_ms").isNotNull())
    x, keys = own.withColumn("prediction_hour", truncated("hour", "created_date")), ["model_version", "prediction_hour"]
    groups = x.groupBy(*keys).agg(
        F.count("*").alias("total_predictions"), mean("inference_ms").alias("avg_inference"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"), count_if(F.col("confidence") > 0.8).alias("high_confidence"),
    )
    return with_percentiles(groups, x, keys, "inference_ms", median_inference=0.5, p95_inference=0.95)


def claims_for_validation(t: Tables, p: Params) -> DataFrame:
    """Pending claims with names, distinct codes and the reimbursement total, inflated by the number of diagnoses as the join has it."""
    own = t.claims.where((F.col("status") == "PENDING") & ~F.col("exported"))
    x = own.join(t.facilities.select("facility_id", "facility_name"), "facility_id", "left").join(t.departments.select("department_id", "department_name"), "department_id", "left")
    x = x.join(t.financial_classes.join(t.payers, "payer_id", "left").select("financial_class_id", F.col("description").alias("fc_description"), "payer_name"), "financial_class_id", "left")
    dated = F.col("service_date").isNotNull()
    # Children of other claims go before they are priced or gathered.
    keys = own.select("claim_id")
    ill = t.diagnoses.join(keys, "claim_id", "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("icd_code")).alias("icd"), F.count("*").alias("n_ill"))
    line = price_lines(_lines(t).join(keys, "claim_id", "left_semi"), t.rvu, p).groupBy("claim_id").agg(F.array_sort(F.collect_set("cpt_code")).alias("cpt"), F.count("*").alias("n_line"), F.sum("amount").alias("paid"))
    y = x.join(ill, "claim_id", "left").join(line, "claim_id", "left")
    text = lambda c: F.when(dated & F.col(c).isNotNull(), F.array_join(c, ",")).otherwise("")
    return y.select(
        "facility_id", "department_id", "financial_class_id", "patient_id", "patient_age", F.col("account").alias("patient_account_number"), "service_date", F.col("total_charge").alias("total_charge_amount"), "payer_name", F.col("status").alias("processing_status"), "created_date",
        "claim_id", F.coalesce("facility_name", F.lit("N/A")).alias("facility_name"), F.coalesce("department_name", F.lit("N/A")).alias("department_name"), F.coalesce("fc_description", F.lit("N/A")).alias("fc_description"),
        text("icd").alias("diagnosis_codes"), text("cpt").alias("procedure_codes"), F.when(dated, F.coalesce("n_ill", F.lit(0))).otherwise(0).cast("bigint").alias("diagnosis_count"), F.when(dated, F.coalesce("n_line", F.lit(0))).otherwise(0).cast("bigint").alias("line_count"),
        F.when(dated, F.col("paid") * F.greatest(F.coalesce("n_ill", F.lit(1)), F.lit(1))).cast("decimal(18,2)").alias("total_reimbursement"),
    )


def high_volume_stats(t: Tables, p: Params) -> DataFrame:
    own = staged(t, p).where(since("created_date", p.as_of_claims, p.window_days, "DAYS"))
    x, keys = own.withColumn("processing_hour", truncated("hour", "created_date")), ["processing_hour", "status"]
    groups = x.groupBy(*keys).agg(
        F.count("*").alias("claim_count"), count_if(F.col("facility_validated")).alias("validated_count"), count_if(F.col("exported")).alias("exported_count"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"),
        F.count_distinct("facility_id").alias("unique_facilities"), F.count_distinct(F.substring("account", 1, 3)).alias("account_prefixes"),
    )
    return with_percentiles(groups, x, keys, "total_charge", median_charge=0.5)


def validation_summary(t: Tables, p: Params) -> DataFrame:
    own = t.validation_results.where(since("created_date", p.as_of_events, 7, "DAYS"))
    x, keys = own.withColumn("hour", truncated("hour", "created_date")), ["hour", "validation_type", "validation_status"]
    groups = x.groupBy(*keys).agg(F.count("*").alias("n"), mean("processing_ms").alias("avg_ms"), count_if(F.col("validation_status") == "FAILED").alias("failed_count"))
    return with_percentiles(groups, x, keys, "processing_ms", p95_ms=0.95)


def facility_metrics(t: Tables, p: Params) -> DataFrame:
    own = validate(t, t.claims, p).where(since("service_date", p.as_of_claims, 30, "DAYS"))
    return own.groupBy("facility_id", F.col("service_date").alias("service_day"), "status").agg(F.count("*").alias("claim_count"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"), count_if(F.col("facility_validated")).alias("validated_claims"), count_if(F.size("errors") > 0).alias("error_claims"))


def _minutes() -> Column:
    return boundaries("MINUTE", F.col("created_date"), F.col("processed_date"))


def _seconds() -> Column:
    return boundaries("SECOND", F.col("created_date"), F.col("processed_date"))


def _average(value: Column) -> Column:
    """The mean of whole numbers as an exact sum over a count."""
    return F.sum(value).cast("double") / F.count(value)


def processing_performance(t: Tables, p: Params) -> DataFrame:
    c = production(t).where(since("created_date", p.as_of_claims, 30, "DAYS"))
    valid = count_if(F.col("validation_status") == "VALIDATED")
    return c.agg(
        F.count("*").alias("total_claims"), *[count_if(F.col("status") == s).alias(f"{s.lower()}_claims") for s in ("PENDING", "PROCESSING", "COMPLETED", "ERROR")], _average(_minutes()).alias("avg_minutes"),
        count_if(since("created_date", p.as_of_claims, 1, "HOURS")).alias("claims_last_hour"), count_if(since("created_date", p.as_of_claims, 1, "DAYS")).alias("claims_last_day"), count_if(since("processed_date", p.as_of_claims, 1, "HOURS")).alias("processed_last_hour"),
        total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"), valid.alias("validated_claims"), percent(valid, F.count("*")).alias("validation_rate"),
    )


def system_health(t: Tables, p: Params) -> DataFrame:
    def one(name: str, df: DataFrame, column: str, moment) -> DataFrame:
        return df.agg(F.count("*").alias("row_count"), F.max(column).alias("newest"), F.min(column).alias("oldest"), count_if(since(column, moment, 24, "HOURS")).alias("last_day")).select(F.lit(name).alias("table_name"), "*")

    parts = [one("claims", production(t), "created_date", p.as_of_claims), one("failed_claims", t.failed_claims, "failed_at", p.as_of_events), one("validation_results", t.validation_results, "created_date", p.as_of_events), one("metric_points", t.metric_points, "ts", p.as_of_events)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def failed_claims_analytics(t: Tables, p: Params) -> DataFrame:
    own = t.failed_claims.where(since("failed_at", p.as_of_events, 30, "DAYS"))
    hours, done = boundaries("HOUR", F.col("failed_at"), F.col("resolved_at")), count_if(F.col("status") == "Resolved")
    return own.groupBy("stage", "status").agg(F.count("*").alias("failures"), count_if(since("failed_at", p.as_of_events, 1, "DAYS")).alias("last_day"), count_if(since("failed_at", p.as_of_events, 7, "DAYS")).alias("last_week"), _average(hours).alias("avg_resolution_hours"), done.alias("resolved"), percent(done, F.count("*")).alias("resolution_rate"))


def facility_performance(t: Tables, p: Params) -> DataFrame:
    recent = t.failed_claims.where(since("failed_at", p.as_of_events, 30, "DAYS")).groupBy("facility_id").agg(F.count("*").alias("failed_last_30_days"))
    valid = count_if(F.col("validation_status") == "VALIDATED")
    sums = production(t).groupBy("facility_id").agg(
        F.count("*").alias("total_claims"), count_if(since("created_date", p.as_of_claims, 1, "DAYS")).alias("claims_last_day"), count_if(since("created_date", p.as_of_claims, 7, "DAYS")).alias("claims_last_week"), _average(_minutes()).alias("avg_minutes"),
        count_if(F.col("status") == "COMPLETED").alias("completed_claims"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"), valid.alias("validated_claims"), percent(valid, F.count("*")).alias("validation_rate"),
    )
    counts = ["total_claims", "claims_last_day", "claims_last_week", "completed_claims", "validated_claims", "failed_last_30_days"]
    own = t.facilities.where("active").select("facility_id", "facility_name", "facility_type", "critical_access")
    return own.join(sums, "facility_id", "left").join(recent, "facility_id", "left").na.fill(0, counts)


def facility_performance_30d(t: Tables, p: Params) -> DataFrame:
    """The date test stands in the join, so facilities without recent claims stay with zeros."""
    own = production(t).where(since("created_date", p.as_of_claims, 30, "DAYS"))
    failed = t.failed_claims.groupBy(F.col("original_claim_id").alias("claim_id")).agg(F.count("*").alias("failures"))
    x = own.join(failed, "claim_id", "left").withColumn("times", F.greatest(F.coalesce("failures", F.lit(0)), F.lit(1)))
    n, bad = F.sum("times"), F.coalesce(F.sum("failures"), F.lit(0))
    sums = x.groupBy("facility_id").agg(n.alias("total_claims"), F.coalesce(F.sum(F.when(F.col("validation_status") == "VALIDATED", F.col("times"))), F.lit(0)).alias("validated_claims"), bad.alias("failed_claims"), F.coalesce(percent(bad, n), F.lit(0.0)).alias("failure_rate"), F.sum(F.col("total_charge") * F.col("times")).cast("decimal(18,2)").alias("total_charges"), F.max("created_date").alias("last_claim"))
    return t.facilities.select("facility_id", "facility_name", "facility_type").join(sums, "facility_id", "left").na.fill(0, ["total_claims", "validated_claims", "failed_claims", "failure_rate"])


def _hierarchy(t: Tables) -> DataFrame:
    return t.facilities.join(t.organizations, "organization_id", "left").join(t.regions, "region_id", "left")


def facility_details(t: Tables, p: Params) -> DataFrame:
    d = t.departments.where("active").groupBy("facility_id").agg(F.count("*").alias("active_departments"))
    c = t.financial_classes.where("active").groupBy("facility_id").agg(F.count("*").alias("active_classes"))
    x = _hierarchy(t).join(d, "facility_id", "left").join(c, "facility_id", "left").na.fill(0, ["active_departments", "active_classes"])
    return x.select("facility_id", "facility_name", "facility_type", "organization_name", "region_name", "active", "active_departments", "active_classes")


def claims_by_facility(t: Tables, p: Params, facility_id: str | None = None) -> DataFrame:
    sums = production(t).groupBy("facility_id").agg(
        F.count("*").alias("total_claims"), *[count_if(F.col("status") == s).alias(f"{s.lower()}_claims") for s in ("PENDING", "COMPLETED", "ERROR")], count_if(F.col("validation_status") == "VALIDATED").alias("validated_claims"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"),
        F.min("service_date").alias("earliest"), F.max("service_date").alias("latest"), F.count_distinct("department_id").alias("departments"), F.count_distinct("financial_class_id").alias("financial_classes"),
    )
    x = _hierarchy(t).select("facility_id", "facility_name", "organization_name", "region_name").join(sums, "facility_id", "left")
    x = x.na.fill(0, ["total_claims", "pending_claims", "completed_claims", "error_claims", "validated_claims", "departments", "financial_classes", "avg_charge"])
    x = x.withColumn("total_charges", F.coalesce("total_charges", F.lit("0.00").cast("decimal(18,2)")))
    return x if facility_id is None else x.where(F.col("facility_id") == facility_id)


def financial_class_summary(t: Tables, p: Params) -> DataFrame:
    counts = production(t).groupBy("financial_class_id", "facility_id").agg(F.count("*").alias("claims"))
    x = t.financial_classes.join(t.facilities.select("facility_id", "facility_name"), "facility_id", "left").join(t.payers, "payer_id", "left").join(counts, ["financial_class_id", "facility_id"], "left")
    return x.select("financial_class_id", "description", "facility_id", "facility_name", "payer_name", "payer_category", "active", F.coalesce("claims", F.lit(0)).alias("total_claims"))


def department_utilization(t: Tables, p: Params) -> DataFrame:
    sums = production(t).groupBy("department_id", "facility_id").agg(F.count("*").alias("total_claims"), total("total_charge").alias("total_charges"), mean("total_charge").alias("avg_charge"), count_if(since("service_date", p.as_of_claims, 30, "DAYS")).alias("last_30_days"), count_if(since("service_date", p.as_of_claims, 90, "DAYS")).alias("last_90_days"), F.min("service_date").alias("first_claim"), F.max("service_date").alias("last_claim"))
    x = t.departments.where("active").select("department_id", "department_name", "facility_id").join(t.facilities.select("facility_id", "facility_name"), "facility_id", "left").join(sums, ["department_id", "facility_id"], "left")
    return x.na.fill(0, ["total_claims", "last_30_days", "last_90_days", "avg_charge"]).withColumn("total_charges", F.coalesce("total_charges", F.lit("0.00").cast("decimal(18,2)")))


def realtime_dashboard(t: Tables, p: Params) -> DataFrame:
    """One row: both tables in one pass each, then joined on a constant key."""
    day = F.date_trunc("day", at(p.as_of_claims)).cast("timestamp_ntz")
    today, hour = F.col("created_date") >= day, since("created_date", p.as_of_claims, 1, "HOURS")
    done = since("processed_date", p.as_of_claims, 1, "HOURS")
    c = production(t).agg(
        count_if(today).alias("claims_today"), count_if(hour).alias("claims_last_hour"), count_if(F.col("status") == "PENDING").alias("pending_claims"), count_if(F.col("status") == "PROCESSING").alias("processing_claims"), _average(F.when(done, _seconds())).alias("avg_seconds_last_hour"),
        total(F.when(today, F.col("total_charge"))).alias("charges_today"), F.count("*").alias("total_claims"), F.count_distinct(F.when(today, F.col("facility_id"))).alias("facilities_today"), F.lit(1).alias("k"),
    )
    f = t.failed_claims.agg(count_if(F.col("failed_at") >= F.date_trunc("day", at(p.as_of_events)).cast("timestamp_ntz")).alias("failures_today"), count_if(since("failed_at", p.as_of_events, 1, "HOURS")).alias("failures_last_hour"), F.lit(1).alias("k"))
    return c.join(f, "k").drop("k").withColumn("last_updated", at(p.as_of_claims))


def system_alerts(t: Tables, p: Params, days: int = 30) -> DataFrame:
    """Alerts whose value is over its threshold, over the last `days`."""
    failed = t.failed_claims.agg(count_if(since("failed_at", p.as_of_events, days, "DAYS")).alias("failures"), F.lit(1).alias("k"))
    c = production(t).agg(count_if(since("created_date", p.as_of_claims, days, "DAYS")).alias("created"), _average(F.when(since("processed_date", p.as_of_claims, days, "DAYS"), _seconds())).alias("seconds"), count_if(F.col("status") == "PENDING").alias("pending"), F.lit(1).alias("k"))
    alert = lambda kind, severity, value, limit: F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), value.cast("double").alias("alert_value"), F.lit(limit).alias("threshold"))
    rate = F.col("failures").cast("double") / F.nullif("created", F.lit(0)) * 100
    rows = F.array(alert("ERROR_RATE", "HIGH", rate, 10.0), alert("SLOW_PROCESSING", "MEDIUM", F.col("seconds"), 300.0), alert("HIGH_PENDING_VOLUME", "MEDIUM", F.col("pending"), 1000.0))
    return c.join(failed, "k").select(F.inline(rows)).where("alert_value > threshold")


def processing_metrics(t: Tables, p: Params) -> DataFrame:
    own = production(t).where(since("created_date", p.as_of_claims, 24, "HOURS"))
    last = count_if(since("created_date", p.as_of_claims, 15, "MINUTES"))
    seconds = F.floor(F.sum(_seconds()) / F.count(_seconds())).cast("bigint")
    return own.agg(F.lit(p.as_of_claims.hour).alias("current_hour"), F.count("*").alias("total_claims"), *[count_if(F.col("status") == s).alias(f"{s.lower()}_claims") for s in ("PENDING", "PROCESSING", "COMPLETED")], last.alias("last_15_minutes"), (last / F.lit(15.0)).alias("claims_per_minute"), seconds.alias("avg_seconds"))


def performance_metrics(t: Tables, p: Params) -> DataFrame:
    age = lambda c, moment: F.floor(F.sum(boundaries("MINUTE", F.col(c), at(moment))) / F.count(c)).cast("double")
    now = production(t).where(since("created_date", p.as_of_claims, 1, "DAYS")).groupBy("status").agg(F.count("*").alias("n"), age("created_date", p.as_of_claims).alias("value")).select(F.lit("Current Processing Status").alias("category"), F.col("status").alias("name"), "n", "value")
    hour = production(t).where(since("processed_date", p.as_of_claims, 1, "HOURS")).agg(F.count("*").alias("n")).select(F.lit("Throughput Last Hour").alias("category"), F.lit("Claims Processed").alias("name"), "n", (F.col("n") / F.lit(60.0)).alias("value"))
    bad = t.failed_claims.where(since("failed_at", p.as_of_events, 1, "DAYS")).groupBy("stage").agg(F.count("*").alias("n"), age("failed_at", p.as_of_events).alias("value")).select(F.lit("Failed Claims").alias("category"), F.col("stage").alias("name"), "n", "value")
    return now.unionByName(hour).unionByName(bad).orderBy("category", "name")


def realtime_throughput(t: Tables, p: Params) -> DataFrame:
    own = production(t).where(since("created_date", p.as_of_claims, 24, "HOURS"))
    n = {k: count_if(since("created_date", p.as_of_claims, k, "MINUTES")) for k in (5, 15, 60)}
    tier = F.when(n[15] / F.lit(15.0) >= 111.11, "MEETING_TARGET").when(n[15] / F.lit(15.0) >= 50, "BELOW_TARGET").otherwise("CRITICAL")
    return own.agg(*[n[k].alias(f"last_{k}_minutes") for k in n], *[(n[k] / F.lit(float(k))).alias(f"per_minute_{k}") for k in n], tier.alias("performance_status"))


def facility_hierarchy(t: Tables, p: Params) -> DataFrame:
    return _hierarchy(t).select("facility_id", "facility_name", "organization_id", "organization_name", "region_id", "region_name")


#: The views that a refresh rebuilds, by name.
VIEWS = {f.__name__: f for f in (processing_summary, facility_performance_daily, validation_failure_patterns, financial_metrics, ml_model_performance, claims_for_validation, high_volume_stats, validation_summary, facility_metrics)}


def refresh(t: Tables, p: Params, folder: str, names: list[str] | None = None) -> list[str]:
    """Rebuilds views as tables under a folder; returns their names."""
    for name in names or sorted(VIEWS):
        VIEWS[name](t, p).write.mode("overwrite").parquet(f"{folder}/{name}")
    return names or sorted(VIEWS)
