"""Changes of tables as pure functions: (target, updates) to the new target, with flags that say what happened."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, since


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target and those new rows whose key it lacks, one for each key."""
    fresh = rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(target.columns))


def split_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New rows that can be inserted, and those whose key exists already."""
    own = rows.dropDuplicates(list(keys))
    return own.join(target.select(*keys), list(keys), "left_anti"), own.join(target.select(*keys), list(keys), "left_semi")


def upsert(target: DataFrame, rows: DataFrame, key: str, as_of: datetime, touched: str = "updated_date") -> DataFrame:
    """Inserts new keys; for known ones only the touch time changes. `change` says inserted, updated or kept."""
    known = target.join(rows.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    old = known.withColumn("change", F.when(F.col("_hit"), "updated").otherwise("kept")).withColumn(touched, F.when(F.col("_hit"), at(as_of)).otherwise(F.col(touched))).drop("_hit")
    fresh = rows.dropDuplicates([key]).join(target.select(key), key, "left_anti").withColumn(touched, at(as_of)).withColumn("change", F.lit("inserted"))
    return old.unionByName(fresh.select(old.columns))


def outcomes(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Of each key in a batch: in_batch, inserted, updated, skipped (rows of it). The first row of a new key is inserted, each further row of a key updates, rows without a key are skipped.

    Keys are counted before they meet the target, so that a key with most of the rows is one row in the join.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("in_batch"))
    known = target.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_known")).distinct()
    new = F.when(F.col(key).isNotNull() & F.col("_known").isNull(), 1).otherwise(0).cast("long")
    skipped = F.when(F.col(key).isNull(), F.col("in_batch")).otherwise(F.lit(0).cast("long"))
    x = counts.join(known, key, "left").withColumns({"inserted": new, "skipped": skipped})
    return x.withColumn("updated", F.col("in_batch") - F.col("inserted") - F.col("skipped")).select(key, "in_batch", "inserted", "updated", "skipped")


def outcome_counts(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated and skipped rows of a batch; zeros for an empty one."""
    return outcomes(target, rows, key).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("inserted", "updated", "skipped")])


def merge_latest(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows of both, of each key the one that is new, or else latest."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_place", place).where("_place = 1").drop("_new", "_place")


def set_status(target: DataFrame, ids: DataFrame, key: str, status: str, as_of: datetime, errors: DataFrame | None = None) -> DataFrame:
    """Sets a status for the ids; given errors (key, new_errors) replace old ones unless null. `changed` flags the rows."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    x = target.join(hit, key, "left").withColumn("changed", F.coalesce("_hit", F.lit(False)))
    if errors is not None:
        x = x.join(errors, key, "left").withColumn("errors", F.when(F.col("changed"), F.coalesce("new_errors", "errors")).otherwise(F.col("errors"))).drop("new_errors")
    x = x.withColumn("exported", F.when(F.col("changed") & F.lit(status == "COMPLETED_EXPORTED_TO_PROD"), True).otherwise(F.col("exported"))) if "exported" in target.columns else x
    return x.withColumn("status", F.when(F.col("changed"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def assign_facility(claims: DataFrame, pairs: DataFrame, facilities: DataFrame, facility_id: str, departments: DataFrame | None = None, department_id: int | None = None) -> DataFrame:
    """Moves the claims named by (claim_id, service_date) to a facility; a facility or department that doesn't exist changes nothing."""
    guard = facilities.where((F.col("facility_id") == facility_id) & F.col("active")).limit(1).count() > 0
    if guard and department_id is not None and departments is not None:
        guard = departments.where((F.col("department_id") == department_id) & F.col("active") & (F.col("facility_id") == facility_id)).limit(1).count() > 0
    if not guard:
        return claims.withColumn("assigned", F.lit(False))
    x = claims.join(pairs.select("claim_id", "service_date").distinct().withColumn("_hit", F.lit(True)), ["claim_id", "service_date"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    x = x.withColumn("facility_id", F.when(hit, F.lit(facility_id)).otherwise(F.col("facility_id"))).withColumn("assigned", hit)
    if department_id is not None:
        x = x.withColumn("department_id", F.when(hit, F.lit(department_id)).otherwise(F.col("department_id")))
    return x.drop("_hit").select(*claims.columns, "assigned")


def archive(claims: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Completed claims processed before a moment, and the rest."""
    old = F.coalesce((F.col("status") == "COMPLETED") & (F.col("processed_date") < at(cutoff)), F.lit(False))
    return claims.where(old), claims.where(~old)


def retain(claims: DataFrame, results: DataFrame, as_of: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """Claims without exported ones older than `days`, and results whose claim is left."""
    old = F.coalesce(F.col("exported") & ~since("processed_date", as_of, days, "DAYS"), F.lit(False))
    kept = claims.where(~old)
    return kept, results.join(kept.select("claim_id"), "claim_id", "left_semi")


def orphans(results: DataFrame, claims: DataFrame) -> DataFrame:
    return results.join(claims.select("claim_id"), "claim_id", "left_anti")


def purge_resolved(failed: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    return failed.where(~((F.col("status") == "Resolved") & F.coalesce(~since("resolved_at", as_of, days, "DAYS"), F.lit(False))))


def touch(old: DataFrame, new: DataFrame, key: str, watched: Sequence[str], as_of: datetime, column: str = "updated_date") -> DataFrame:
    """The new rows with a touch time where a watched column differs from the old row (nulls compared as values)."""
    before = old.select(key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_old_{c}") for c in watched], F.col(column).alias("_touched"))
    changed = F.lit(False)
    for c in watched:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    x = new.drop(column).join(before, key, "left").withColumn("changed", F.col("_known").isNull() | changed)
    return x.withColumn(column, F.when(F.col("changed"), at(as_of)).otherwise(F.col("_touched"))).drop("_known", "_touched", *[f"_old_{c}" for c in watched])
