"""Claims by month of service, and an export that can be run again.

Layout below one folder that the cluster shares:

    claims/service_month=2001-05/        staging, whole months in a folder
    archive/service_month=2001-05/       completed claims that were moved out
    batches/batch=7/                     the claims that batch 7 took, decided once
    production/batch=7/service_month=..  valid claims of the batch
    failed/batch=7/service_month=..      failed claims of the batch
    disposed/batch=7/                    the batch's claims as validated; goes when the batch is done
    status/batch=7/                      what the batch says about its claims
    manifest/batch=7/                    counts; written last, so it marks the batch as done

Every write replaces its own partitions and nothing else, and only the manifest
makes a batch count. A batch that was killed runs again under its number: it
takes the same claims and replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import at

NO_MONTH = "none"
MANIFEST = "dequeued long, exported long, failed long, batch long"


def month_of(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(NO_MONTH))


class Folders:
    """Folders below one that the cluster shares, moved and dropped through the Hadoop file system of the session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, *parts: str) -> str:
        return "/".join([self.folder, *parts])

    def _files(self, path: str):
        """The file system of a path and the path in its terms; Spark has no other way to move or drop a folder."""
        jvm = self.spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), own

    def exists(self, *parts: str) -> bool:
        files, path = self._files(self.path(*parts))
        return files.exists(path)

    def drop(self, *parts: str) -> None:
        files, path = self._files(self.path(*parts))
        files.delete(path, True)

    def move(self, source: str, target: str) -> None:
        files, path = self._files(source)
        _, there = self._files(target)
        files.mkdirs(there.getParent())
        if not files.rename(path, there):
            raise OSError(f"{source} couldn't be moved to {target}")


class ClaimStore(Folders):
    # -- tables ----------------------------------------------------------------------------

    def write(self, rows: DataFrame, name: str, *by: str, whole: bool = False) -> None:
        """Replaces the partitions that rows fall into, or the whole table; rows meet by partition first, so that each gets few files.

        Only whole tables get the file _SUCCESS that says they are complete.
        """
        dealt = rows.repartition(*by) if len(by) > 1 else rows.repartition(*by, F.pmod(F.hash(*rows.columns), F.lit(8)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy(*by).parquet(self.path(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A table, or None while it has no files; partition columns are read as text, batch numbers as numbers."""
        if not self.exists(name):
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(self.path(name))
        return rows.withColumn("service_month", F.col("service_month").cast("string")) if "service_month" in rows.columns else rows

    # -- claims by month -------------------------------------------------------------------

    def load(self, claims: DataFrame) -> None:
        """Claims into their months, whole months replaced."""
        self.write(claims.withColumn("service_month", month_of("service_date")), "claims", "service_month")

    def claims(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Claims of the months from first to last ('2001-05'); only their folders are read."""
        rows = self.read("claims")
        if first is not None:
            rows = rows.where(F.col("service_month") >= first)
        return rows if last is None else rows.where(F.col("service_month") <= last)

    def current(self) -> DataFrame:
        """Claims with the status that the latest finished batch gave them."""
        claims, status, done = self.read("claims"), self.read("status"), self.read("manifest", MANIFEST)
        if status is None or done is None:
            return claims
        said = status.join(done.select("batch"), "batch", "left_semi").groupBy("claim_id").agg(F.max_by(F.struct("final_status", "is_exported"), "batch").alias("said"))
        x = claims.join(said, "claim_id", "left")
        return x.withColumns({"status": F.coalesce("said.final_status", "status"), "exported": F.coalesce("said.is_exported", "exported")}).drop("said")

    # -- export ----------------------------------------------------------------------------

    def take(self, batch: int, size: int | None = None, status: str = "PENDING", facility_id: str | None = None, since: datetime | None = None) -> DataFrame:
        """The batch's claims: the oldest in a status that no other batch has taken; decided once, then read again.

        facility_id and since (the earliest created_date) narrow the choice.
        """
        if not self.exists("batches", f"batch={batch}", "_SUCCESS"):
            rows = self.claims().where(F.col("status") == status)
            taken = self.read("batches")
            if taken is not None:
                rows = rows.join(taken.where(F.col("batch") != batch).select("claim_id"), "claim_id", "left_anti")
            rows = rows if facility_id is None else rows.where(F.col("facility_id") == facility_id)
            rows = rows if since is None else rows.where(F.col("created_date") >= at(since))
            rows = rows.select("claim_id", "service_month", "created_date", "claim_key")
            rows = rows if size is None else rows.orderBy("created_date", "claim_key").limit(size)
            rows.select("claim_id", "service_month").write.mode("overwrite").parquet(self.path("batches", f"batch={batch}"))
        own = self.spark.read.parquet(self.path("batches", f"batch={batch}"))
        return self.claims().join(own, ["claim_id", "service_month"], "left_semi")

    def export(self, batch: int, dispose: Callable[[DataFrame], DataFrame], valid: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], DataFrame], **choice: object) -> DataFrame:
        """Takes, validates, writes both targets and the status of a batch, then its manifest: batch, dequeued, exported, failed.

        dispose adds is_valid and final_status to claims; valid and failed make
        the targets' rows from the disposed claims, service_month included. A
        batch with a manifest is done and is only read.
        """
        if not self.exists("manifest", f"batch={batch}", "_SUCCESS"):
            validated = dispose(self.take(batch, **choice))
            validated.write.mode("overwrite").parquet(self.path("disposed", f"batch={batch}"))  # once, for three targets
            disposed = self.spark.read.schema(validated.schema).parquet(self.path("disposed", f"batch={batch}"))
            number = F.lit(batch).cast("long")
            for name, rows in (("production", valid(disposed)), ("failed", failed(disposed))):
                self.drop(name, f"batch={batch}")
                self.write(rows.withColumn("batch", number), name, "batch", "service_month")
            said = disposed.select("claim_id", "final_status", F.col("is_valid").alias("is_exported"))
            said.write.mode("overwrite").parquet(self.path("status", f"batch={batch}"))
            written = self.spark.read.schema(said.schema).parquet(self.path("status", f"batch={batch}"))
            counts = written.agg(F.count("*").alias("dequeued"), F.count_if("is_exported").alias("exported"), F.count_if(~F.col("is_exported")).alias("failed"))
            counts.write.mode("overwrite").parquet(self.path("manifest", f"batch={batch}"))
            self.drop("disposed", f"batch={batch}")
        return self.read("manifest", MANIFEST).where(F.col("batch") == batch)

    def set_status(self, batch: int, ids: DataFrame, status: str) -> DataFrame:
        """Gives claims a status as a batch of its own: success, updated, missing, message. Ids without a claim change nothing and are counted."""
        asked = ids.select("claim_id").distinct()
        found = asked.join(self.claims().select("claim_id"), "claim_id", "left_semi")
        rows = found.withColumns({"final_status": F.lit(status), "is_exported": F.lit(status == "COMPLETED_EXPORTED_TO_PROD")})
        rows.write.mode("overwrite").parquet(self.path("status", f"batch={batch}"))
        hit = self.spark.read.schema(rows.schema).parquet(self.path("status", f"batch={batch}")).select("claim_id", F.lit(1).alias("hit"))
        hit.agg(F.count("*").alias("dequeued"), F.lit(0).cast("long").alias("exported"), F.lit(0).cast("long").alias("failed")).write.mode("overwrite").parquet(self.path("manifest", f"batch={batch}"))
        counts = asked.join(hit, "claim_id", "left").agg(F.count("*").alias("asked"), F.count("hit").alias("updated"))
        missing = F.col("asked") - F.col("updated")
        message = F.when(missing == 0, F.concat(F.lit("Updated "), "updated", F.lit(" claims"))).otherwise(F.concat("updated", F.lit(" claims updated, "), missing, F.lit(" not found")))
        return counts.select((F.col("updated") > 0).alias("success"), "updated", missing.alias("missing"), message.alias("message"))

    # -- archive and retention -------------------------------------------------------------

    def archive(self, old: Column, last: str) -> DataFrame:
        """Moves claims for which `old` holds out of the months up to `last`; service_month, archived, kept.

        A month whose claims are all old is moved as a folder, one without any is
        not touched, and only mixed months are written again. Other months are
        not even read. A run that was killed can be run again (see _swap).
        """
        self._swap()
        own = self.claims(last=last).where(F.col("service_month") != NO_MONTH)
        counts = own.groupBy("service_month").agg(F.count_if(F.coalesce(old, F.lit(False))).alias("archived"), F.count_if(~F.coalesce(old, F.lit(False))).alias("kept"))
        months = [r.asDict() for r in counts.orderBy("service_month").collect()]  # a row for each month
        there = {r[0] for r in (self.read("archive").select("service_month").distinct().collect() if self.exists("archive") else [])}
        whole = [m["service_month"] for m in months if not m["kept"] and m["service_month"] not in there]
        mixed = [m["service_month"] for m in months if m["archived"] and m["service_month"] not in whole]
        if mixed:
            rows = self.claims().where(F.col("service_month").isin(mixed)).withColumn("is_old", F.coalesce(old, F.lit(False)))
            out = rows.where("is_old").drop("is_old")
            if there & {*mixed}:
                before = self.read("archive").where(F.col("service_month").isin(mixed))
                out = out.unionByName(before.join(out.select("claim_id"), "claim_id", "left_anti"))
            self.write(rows.where("not is_old").drop("is_old"), "claims-new", "service_month", whole=True)
            self.write(out, "archive-new", "service_month", whole=True)
            self._swap()
        for month in whole:
            self.move(self.path("claims", f"service_month={month}"), self.path("archive", f"service_month={month}"))
        return self.spark.createDataFrame([(m["service_month"], m["archived"], m["kept"]) for m in months], "service_month string, archived long, kept long")

    def _swap(self) -> None:
        """Puts both new versions of mixed months in place, if both were written whole; a killed swap is done again by the next run."""
        if self.exists("archive-new", "_SUCCESS"):
            out = self.read("archive-new")
            months = {r[0] for r in out.select("service_month").distinct().collect()}
            self.write(out, "archive", "service_month")
            if self.exists("claims-new", "_SUCCESS"):
                left = {r[0] for r in self.read("claims-new").select("service_month").distinct().collect()} if self._parts("claims-new") else set()
                if left:
                    self.write(self.read("claims-new"), "claims", "service_month")
                for month in months - left:
                    self.drop("claims", f"service_month={month}")
        self.drop("claims-new")
        self.drop("archive-new")

    def _parts(self, name: str) -> bool:
        files, path = self._files(self.path(name))
        return any(s.isDirectory() for s in files.listStatus(path))

    def retain(self, first: str, batches_before: int) -> DataFrame:
        """Drops archived months before `first` as folders, and the records of finished batches below a number: what, dropped."""
        months = [r[0] for r in self.read("archive").where(F.col("service_month") < first).select("service_month").distinct().collect()] if self.exists("archive") else []
        done = [r[0] for r in self.read("manifest", MANIFEST).where(F.col("batch") < batches_before).select("batch").collect()] if self.exists("manifest") else []
        for month in months:
            self.drop("archive", f"service_month={month}")
        for batch in done:
            for name in ("batches", "manifest", "status"):
                self.drop(name, f"batch={batch}")
        return self.spark.createDataFrame([("months", len(months)), ("batches", len(done))], "what string, dropped long")
