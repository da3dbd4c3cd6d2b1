"""Sessions with the settings the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("claimloom").config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once for each context, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_claimloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._claimloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: spark.checkpoint.dir, or one under /tmp/checkpoints with a local master where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return shared or "file:///tmp/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: a table of Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
