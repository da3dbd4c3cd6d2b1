"""Sinks: appended JSON lines, dashboards, batch records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at

BATCHES = "batch_id long, batch_name string, status string, total_claims long, start_time timestamp_ntz"


def append_lines(df: DataFrame, path: str) -> None:
    """One JSON object for each row, appended; nulls are written."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def metrics_snapshot(windows: DataFrame, as_of: datetime) -> DataFrame:
    """One row for each trailing window: its aggregated metrics as an array, as one line of an export holds them."""
    entry = F.struct("metric", "type", "n", "sum_value", "min_value", "max_value", "avg_value")
    return windows.groupBy("window").agg(F.array_sort(F.collect_list(entry)).alias("metrics")).withColumn("exported_at", at(as_of))


def dashboard(parts: dict[str, DataFrame]) -> DataFrame:
    """Small summaries side by side, each row as JSON under its panel."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("panel"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def create_batch(spark: SparkSession, path: str, name: str, total_claims: int, as_of: datetime) -> int:
    """Appends a pending batch to the log and returns its id, one more than the largest."""
    known = spark.read.schema(BATCHES).parquet(path).agg(F.max("batch_id")).first()[0] if _exists(spark, path) else None
    number = (known or 0) + 1
    spark.createDataFrame([(number, name, "PENDING", total_claims, as_of)], BATCHES).coalesce(1).write.mode("append").parquet(path)
    return number


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(BATCHES).parquet(path)
        return True
    except Exception as error:  # Spark names a missing path by its error class only
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False
