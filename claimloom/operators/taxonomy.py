"""Error classes as a table that joins to error events by code, and the analyses over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code string, class string, category string, severity string, impact string, component string, recoverable boolean, auto_retry boolean, max_retries int"
# Each class of errors.
TAXONOMY = [
    ("CIRCUIT_BREAKER_OPEN", "CircuitBreakerOpenError", "Integration", "HIGH", "SystemWide", "Unknown", True, True, 3),
    ("CONFIG_ERROR", "ConfigError", "Configuration", "HIGH", "SystemWide", "Configuration", False, False, 3),
    ("DB_ERROR", "DatabaseError", "Database", "HIGH", "BackgroundProcess", "Database", True, True, 3),
    ("STAGING_DB_ERROR", "StagingDBError", "StagingDatabase", "HIGH", "BackgroundProcess", "StagingDatabase", True, True, 3),
    ("PROD_DB_ERROR", "ProductionDBError", "ProductionDatabase", "HIGH", "BackgroundProcess", "ProductionDatabase", True, True, 3),
    ("VALIDATION_ERROR", "ValidationError", "Validation", "MEDIUM", "DataQuality", "ValidationEngine", True, False, 3),
    ("ML_MODEL_ERROR", "MLModelError", "MachineLearning", "HIGH", "BackgroundProcess", "MLPredictor", True, True, 3),
    ("API_ERROR", "APIError", "API", "MEDIUM", "UserFacing", "API", True, False, 3),
    ("EXT_SERVICE_ERROR", "ExternalServiceError", "ExternalService", "MEDIUM", "SystemWide", "ExternalService", True, False, 3),
    ("CACHE_ERROR", "CacheError", "Caching", "LOW", "Performance", "CacheManager", True, True, 3),
    ("SECURITY_ERROR", "SecurityError", "Security", "CRITICAL", "SecurityBreach", "Security", False, False, 3),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, SCHEMA)


def classified(errors: DataFrame, classes: DataFrame, code: str = "code") -> DataFrame:
    """Errors with what their class says; an unknown code gets the general application error."""
    known = classes.select(F.col("code").alias(code), *[c for c in classes.columns if c != "code"])
    x = errors.join(F.broadcast(known), code, "left")  # the classes are a constant of this module or a table like it
    general = {"class": "AppException", "category": "Configuration", "severity": "MEDIUM", "impact": "BackgroundProcess", "component": "Unknown"}
    return x.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in general.items()} | {"recoverable": F.coalesce("recoverable", F.lit(True)), "auto_retry": F.coalesce("auto_retry", F.lit(False)), "max_retries": F.coalesce("max_retries", F.lit(3))})


def retry_plan(errors: DataFrame) -> DataFrame:
    """By class: errors, those that are retried at once, and the most attempts that this may take."""
    retried = F.col("recoverable") & F.col("auto_retry")
    return errors.groupBy("class", "category", "severity", "impact").agg(F.count("*").alias("n"), F.count_if(retried).alias("retried"), F.sum(F.when(retried, F.col("max_retries")).otherwise(0)).alias("most_attempts"))


def correlations(errors: DataFrame, minutes: int = 5, least: int = 2) -> DataFrame:
    """Ordered pairs of different codes seen in the same period, in `least` periods or more. A period has few distinct codes."""
    codes = errors.select(F.window("ts", f"{minutes} minutes").start.alias("bucket"), "code").distinct()
    a, b = codes.select("bucket", F.col("code").alias("code_a")), codes.select("bucket", F.col("code").alias("code_b"))
    return a.join(b, "bucket").where("code_a <> code_b").groupBy("code_a", "code_b").agg(F.count("*").alias("buckets")).where(F.col("buckets") >= least)


def bucket_load(errors: DataFrame, minutes: int = 5) -> DataFrame:
    """How many periods have errors, and how many errors they have on average."""
    counts = errors.groupBy(F.window("ts", f"{minutes} minutes").start).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("total_buckets"), (F.sum("n") / F.count("*")).alias("avg_errors_per_bucket"))


def clusters(errors: DataFrame) -> DataFrame:
    """The errors of each category and component, one row each, numbered by their cluster."""
    return errors.select(F.concat_ws("_", "category", "component").alias("cluster"), "event_id", "code", "ts", "severity")


def analysis(errors: DataFrame, breakers: DataFrame) -> dict[str, DataFrame]:
    """All analyses of errors by name; breakers has key and state."""
    from . import monitoring

    return {
        "patterns": monitoring.error_distributions(errors),
        "error_clusters": monitoring.error_clusters(errors),
        "temporal_patterns": monitoring.error_temporal(errors),
        "correlation_analysis": correlations(errors),
        "time_bucket_analysis": bucket_load(errors),
        "recovery_effectiveness": monitoring.recovery_effectiveness(errors),
        "circuit_breaker_status": breakers,
    }


def analysis_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The analyses as one table: section, and each row as JSON."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*sorted(df.columns))).alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out
