"""Sources: files, JSON record sets, identifier lists, month series, rule and model registries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RVU_SCHEMA = "cpt_code string, description string, rvu_value double"
TRAINING_SCHEMA = "claim_id string, total_charge_amount double, patient_age int, num_diagnoses int, num_line_items int, target_filter_id string"


def read_rvu_csv(spark: SparkSession, path: str) -> DataFrame:
    """The price table with a fixed schema; rows without a value are left out."""
    rows = spark.read.csv(path, schema=RVU_SCHEMA, header=True)
    return rows.where(F.col("rvu_value").isNotNull() & ~F.isnan("rvu_value")).withColumn("rvu_value", F.col("rvu_value").cast("decimal(8,2)"))


def json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON array of records in a column, as rows."""
    return df.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def split_ids(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """A separated list of identifiers, as distinct rows."""
    each = F.explode(F.split(F.col(column), separator)).alias("claim_id")
    return df.select(each).select(F.trim("claim_id").alias("claim_id")).where("claim_id <> ''").distinct()


def months(spark: SparkSession, first: date, last: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def missing_months(spark: SparkSession, df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """Months of a range without a partition in the data."""
    present = df.select(F.trunc(F.col(column), "month").alias("month")).distinct()
    return months(spark, first, last).join(present, "month", "left_anti")


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def active_rules(filters: DataFrame, kind: str = "DATALOG") -> DataFrame:
    return filters.where((F.col("rule_type") == kind) & F.col("is_active") & F.col("is_latest_version"))


def latest_model(registry: DataFrame) -> DataFrame:
    """The registry's newest version by training date, unknown dates last."""
    return registry.orderBy(F.desc_nulls_last("training_date"), F.desc("version")).limit(1)


def pending(claims: DataFrame, size: int, status: str = "PENDING", facility_id: str | None = None) -> DataFrame:
    """The oldest claims in a status: the next batch of a queue."""
    rows = claims.where(F.col("status") == status)
    rows = rows if facility_id is None else rows.where(F.col("facility_id") == facility_id)
    return rows.orderBy("created_date", "claim_key").limit(size)


def with_children(claims: DataFrame, lines: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """One row for each claim with its lines and diagnoses as sorted arrays of structs."""
    own = lines.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "cpt_code", "units", "line_charge"))).alias("lines"))
    ill = diagnoses.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "icd_code"))).alias("diagnoses"))
    return claims.join(own, "claim_id", "left").join(ill, "claim_id", "left")


def partition_lag(claims: DataFrame) -> DataFrame:
    """Each month of service with its rows and the boundary before it."""
    counts = claims.where("service_date is not null").groupBy(F.trunc("service_date", "month").alias("boundary")).agg(F.count("*").alias("rows"))
    return counts.withColumn("lower_boundary", F.lag("boundary", 1).over(Window.orderBy("boundary")))
