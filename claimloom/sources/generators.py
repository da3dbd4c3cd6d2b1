"""Synthetic claims and facilities by arithmetic, the same rows on every run and any number of executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MULTIPLIER, _MODULUS = 48271, 2147483647


def _draw(key: Column, salt: int, below: int) -> Column:
    """A whole number in 0..below - 1 that a Lehmer step draws from a key."""
    seed = (key + F.lit(salt)) % F.lit(_MODULUS - 1) + F.lit(1)
    return (seed * F.lit(_MULTIPLIER)) % F.lit(_MODULUS) % F.lit(below)


def facilities(spark: SparkSession, n: int) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(F.concat(F.lit("GEN"), F.lpad(k.cast("string"), 5, "0")).alias("facility_id"), F.concat(F.lit("Facility "), k.cast("string")).alias("facility_name"), (_draw(k, 11, 100) < 90).alias("active"))


def claims(spark: SparkSession, n: int, n_facilities: int = 10) -> DataFrame:
    """n claims over the generated facilities: charges of 10 to 25,009.99, dates of a year, ages of 0 to 99."""
    k = F.col("id")
    cents = _draw(k, 3, 2_500_000) + F.lit(1000)
    return spark.range(n).select(
        F.concat(F.lit("CLM"), F.lpad(k.cast("string"), 9, "0")).alias("claim_id"), F.concat(F.lit("GEN"), F.lpad(_draw(k, 5, n_facilities).cast("string"), 5, "0")).alias("facility_id"),
        _draw(k, 7, 100).cast("int").alias("patient_age"), F.date_add(F.lit("2024-01-01").cast("date"), _draw(k, 13, 365).cast("int")).alias("service_date"), cents.alias("charge_cents"),
    )
