"""Pricing of lines and claims by relative value units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params


def price_lines(lines: DataFrame, rvu: DataFrame, params: Params = Params()) -> DataFrame:
    """Lines with status and amount = value * units * factor, half up to cents; 0.00 where it can't be priced."""
    units = F.coalesce("units", F.lit(1))
    priced = lines.join(rvu, "cpt_code", "left")
    status = (
        F.when(F.coalesce(F.col("cpt_code") == "", F.lit(True)), "CPT_CODE_MISSING").when(units <= 0, "INVALID_UNITS")
        .when(F.col("rvu_value").isNull(), "RVU_NOT_FOUND").otherwise("CALCULATED_OK")
    )
    amount = F.round(F.col("rvu_value") * units.cast("decimal(6,0)") * F.lit(params.conversion_factor).cast("decimal(6,2)"), 2).cast("decimal(18,2)")
    return priced.withColumn("pricing_status", status).withColumn("amount", F.when(F.col("pricing_status") == "CALCULATED_OK", amount).otherwise(F.lit("0.00").cast("decimal(18,2)")))


def price_claims(claims: DataFrame, priced: DataFrame) -> DataFrame:
    """Claims with the sum of their lines' amounts; lines without a code don't count; 0.00 without lines."""
    sums = priced.where("pricing_status <> 'CPT_CODE_MISSING'").groupBy("claim_id").agg(F.sum("amount").cast("decimal(18,2)").alias("reimbursement"), F.count("*").alias("priced_lines"))
    joined = claims.join(sums, "claim_id", "left")
    return joined.withColumn("reimbursement", F.coalesce("reimbursement", F.lit("0.00").cast("decimal(18,2)"))).withColumn("priced_lines", F.coalesce("priced_lines", F.lit(0)))


def merge_amounts(lines: DataFrame, amounts: dict[int, str]) -> DataFrame:
    """Lines with amounts given by line number; other lines get null."""
    pairs = [x for k, v in amounts.items() for x in (F.lit(k), F.lit(v).cast("decimal(18,2)"))]
    return lines.withColumn("amount", F.create_map(*pairs)[F.col("line_number")] if pairs else F.lit(None).cast("decimal(18,2)"))
