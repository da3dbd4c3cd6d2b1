"""The driver's tables seen as the claims model: staging, production, dimensions, metrics.

Dimensions are joined without hints: Spark broadcasts those whose size it knows
to be under its threshold and shuffles larger ones, at run time too (AQE).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import json_text, money

def code(prefix: str, number: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


class Tables:
    """Lazily built DataFrames over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def regions(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))

    @cached_property
    def organizations(self) -> DataFrame:
        key = (F.col("n_nationkey") % 5).alias("organization_id")
        return self.read("nation").select(key).distinct().withColumn("organization_name", F.concat(F.lit("ORG"), F.col("organization_id").cast("string")))

    @cached_property
    def facilities(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.read("nation").select(
            code("FAC", n).alias("facility_id"), F.col("n_name").alias("facility_name"), (n % 5).alias("organization_id"), F.col("n_regionkey").alias("region_id"),
            F.when(n % 2 == 0, "Teaching").otherwise("Non-Teaching").alias("facility_type"), F.when(n % 7 == 0, "Y").otherwise("N").alias("critical_access"), (~n.isin(3, 17)).alias("active"),
        )

    @cached_property
    def facility_parents(self) -> DataFrame:
        """(facility_id, parent_id): a binary tree of facilities under the first."""
        n = F.col("n_nationkey")
        return self.read("nation").where(n > 0).select(code("FAC", n).alias("facility_id"), code("FAC", F.floor(n / 2)).alias("parent_id"))

    @cached_property
    def payers(self) -> DataFrame:
        names = self.read("customer").select(F.col("c_mktsegment").alias("payer_name")).distinct()
        place = F.row_number().over(Window.orderBy("payer_name"))
        kinds = F.array(*map(F.lit, ("Commercial", "Government", "Managed Care", "Self-Pay", "Other")))
        return names.withColumn("payer_id", place).withColumn("payer_category", F.element_at(kinds, F.least("payer_id", F.lit(5))))

    @cached_property
    def financial_classes(self) -> DataFrame:
        n, p = F.col("n_nationkey"), F.col("p")
        each = self.read("nation").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(5))))
        return each.select(
            F.concat(F.lit("FC"), p.cast("string"), F.lit("_"), F.lpad(n.cast("string"), 3, "0")).alias("financial_class_id"), F.concat(F.lit("Class "), p.cast("string")).alias("description"),
            F.when(p != 5, code("FAC", n)).alias("facility_id"), p.alias("payer_id"), (~((p == 4) & (n % 10 == 0))).alias("active"),
        )

    @cached_property
    def departments(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("department_id"), F.col("s_name").alias("department_name"), code("FAC", F.col("s_nationkey")).alias("facility_id"), (F.col("s_acctbal") >= 0).alias("active"))

    @cached_property
    def rvu(self) -> DataFrame:
        cents = F.floor((F.round(F.col("p_retailprice") * 100).cast("bigint") + 50) / 100)
        return self.read("part").where("p_size <> 13").select(F.col("p_partkey").cast("string").alias("cpt_code"), money(cents, "decimal(10,2)").alias("rvu_value"))

    @cached_property
    def claims(self) -> DataFrame:
        k = F.col("o_orderkey")
        customer = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        department = self.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("department_id"))
        joined = self.read("orders").join(customer, "o_custkey").join(department, "o_orderkey", "left")
        created = F.col("o_orderdate") + F.make_dt_interval(mins=(k % 1440).cast("int"))
        service = F.when(k % 101 == 0, F.lit(None).cast("date")).when(k % 103 == 0, F.lit("2001-09-01").cast("date")).otherwise(F.col("o_orderdate").cast("date"))
        fc = F.concat(F.lit("FC"), F.left("o_orderpriority", F.lit(1)), F.lit("_"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
        status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSING")
        charge = F.floor((F.round(F.col("o_totalprice") * 100).cast("bigint") + 11) / 22)
        rows = joined.select(
            k.cast("string").alias("claim_id"), k.alias("claim_key"),
            F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, "FAC999").otherwise(code("FAC", F.col("c_nationkey"))).alias("facility_id"),
            F.when(k % 83 == 0, F.lit(None).cast("string")).otherwise(fc).alias("financial_class_id"),
            F.when(k % 53 == 0, F.lit(None).cast("string")).when(k % 59 == 0, "   ").otherwise(F.concat(F.lit("ACC"), F.lpad(F.col("o_custkey").cast("string"), 10, "0"))).alias("account"),
            service.alias("service_date"), F.date_add(service, 90).alias("end_date"), F.col("o_custkey").alias("patient_id"), (18 + F.col("o_custkey") % 73).alias("patient_age"),
            money(charge, "decimal(12,2)").alias("total_charge"), status.alias("status"), (F.col("o_orderstatus") == "F").alias("exported"), created.alias("created_date"),
            F.when(F.col("o_orderstatus") == "F", created + F.make_dt_interval(mins=(k % 500).cast("int"))).alias("processed_date"), "department_id",
        )
        return rows.withColumn("validation_status", F.when(F.col("exported"), F.when(F.col("claim_key") % 13 == 0, "FAILED").otherwise("VALIDATED")))

    @cached_property
    def lines(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        part = F.col("l_partkey")
        return self.read("lineitem").select(
            F.col("l_orderkey").cast("string").alias("claim_id"), F.row_number().over(order).alias("line_number"), part.cast("string").alias("cpt_code"),
            F.when(part % 41 == 0, 0).otherwise(F.col("l_quantity").cast("int")).alias("units"), money(F.round(F.col("l_extendedprice") * 100).cast("bigint"), "decimal(12,2)").alias("line_charge"), F.col("l_shipdate").cast("date").alias("line_date"),
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        pairs = self.read("lineitem").join(self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_orderkey").cast("string").alias("claim_id"), F.col("p_brand").alias("icd_code")).distinct()
        place = F.row_number().over(Window.partitionBy("claim_id").orderBy("icd_code"))
        return pairs.withColumn("sequence", place).where("sequence <= 12").withColumn("is_primary", F.col("sequence") == 1)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("k", json_text("props", "k").cast("int"))

    @cached_property
    def validation_results(self) -> DataFrame:
        kind, user = F.col("event_type"), F.col("user_id")
        name = F.when(kind == "click", "FACILITY").when(kind == "view", "BUSINESS_RULES").when(kind == "purchase", "ML_FILTER").when(kind == "signup", "DATALOG_RULE").otherwise("MEDICAL")
        return self.events.select(
            F.col("event_id").alias("result_id"), user.cast("string").alias("claim_id"), F.col("ts").alias("created_date"), name.alias("validation_type"),
            F.when((kind == "error") | (F.col("event_id") % 5 == 0), "FAILED").otherwise("PASSED").alias("validation_status"),
            F.when(F.col("k").isNotNull(), F.concat(F.lit("E"), (F.col("k") % 4).cast("string"))).alias("error_type"), (F.col("k") / F.lit(100.0)).alias("confidence"),
            money(F.round(F.col("value") * 100).cast("bigint"), "decimal(12,2)").alias("processing_ms"), F.when(kind == "purchase", money(F.round(F.col("value") * 100).cast("bigint"), "decimal(12,2)")).alias("inference_ms"),
            F.when(user % 7 != 0, F.concat(F.lit("v"), (user % 3).cast("string"))).alias("model_version"),
        )

    @cached_property
    def failed_claims(self) -> DataFrame:
        e = F.col("event_id")
        stages, states = ("VALIDATION", "ML", "PRICING", "EXPORT"), ("New", "Pending Review", "In Progress", "Resolved", "Resolved")
        codes, texts = ("CORE_FAC_01", "CORE_FAC_02", "CORE_PAT_01", "CORE_FC_01"), ("Facility ID is missing.", "Facility not found or inactive.", "Patient Account Number is missing.", "Financial class is missing.")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (e % n + 1).cast("int"))
        status = pick(states, 5)
        return self.events.where("event_type = 'error'").select(
            e.alias("failed_id"), F.col("user_id").cast("string").alias("original_claim_id"), code("FAC", F.col("user_id") % 25).alias("facility_id"), pick(stages, 4).alias("stage"), status.alias("status"),
            F.col("ts").alias("failed_at"), F.when(status == "Resolved", F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("resolved_at"), pick(codes, 4).alias("error_codes"), pick(texts, 4).alias("error_messages"),
        )

    @cached_property
    def metric_points(self) -> DataFrame:
        e = F.col("event_id")
        kind = F.element_at(F.array(*map(F.lit, ("counter", "gauge", "histogram", "timer"))), (e % 4 + 1).cast("int"))
        return self.events.select(e.alias("point_id"), F.col("event_type").alias("name"), kind.alias("type"), F.col("ts"), money(F.round(F.col("value") * 100).cast("bigint"), "decimal(12,2)").alias("value"), F.create_map(F.lit("bucket"), (F.col("user_id") % 3).cast("string")).alias("labels"))

    @cached_property
    def error_metrics(self) -> DataFrame:
        k = F.col("k")
        pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
        return self.events.where("event_type = 'error' and k is not null").select(
            "event_id", "ts", F.concat(F.lit("E"), (k % 8).cast("string")).alias("code"), pick(("database", "validation", "ml", "system"), k).alias("category"), pick(("low", "medium", "high", "critical"), F.col("event_id")).alias("severity"),
            pick(("none", "degraded", "outage"), k).alias("impact"), pick(("api", "rules", "export"), F.col("user_id")).alias("component"), (F.col("event_id") % 2 == 0).alias("attempted"), (F.col("event_id") % 6 == 0).alias("recovered"),
        )
