"""Models kept by version in a shared folder, with a registry row for each."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import latest_model

SCHEMA = "version string, model_type string, feature_names array<string>, training_date timestamp_ntz, metrics map<string,double>, path string"


def save(model: PipelineModel, spark: SparkSession, folder: str, version: str, trained: datetime | None, features: list[str], metrics: dict[str, float], kind: str = "random_forest") -> None:
    """Writes the model, then its row: a version without a row is not there yet."""
    path = f"{folder}/models/{version}"
    model.write().overwrite().save(path)
    row = spark.createDataFrame([(version, kind, features, trained, metrics, path)], SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/registry")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/registry")


def load(spark: SparkSession, folder: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """A version's model and row, the latest by training date if none is named."""
    rows = versions(spark, folder)
    row = (latest_model(rows) if version is None else rows.where(F.col("version") == version)).first()
    if row is None:
        raise ValueError(f"no model {version or ''} in {folder}")
    return PipelineModel.load(row["path"]), row.asDict()
