"""Files whose broken lines are kept apart, and tables that a full load replaces as a whole.

A load reads each line once, permissively. Lines that can't be parsed, fail a
check or contradict another line go to a table of rejects with the reason, so
rows and rejects always add up to the lines read:

    <name>/             the rows, replaced whole by a load that has any
    <name>-rejects/     reason, record, file, n of the last load
    <name>-parsed/      what was read; dropped when the load is done

A load without a single good row leaves the rows as they were. A run that was
killed is run again; one that died while folders were swapped is finished by
the next reader. A feed has one load at a time; readers see the old rows meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import resolve
from .readers import RVU_SCHEMA, TRAINING_SCHEMA
from .store import Folders

BROKEN = "_broken_line"
REJECTS = "reason string, record string, file string, n long"


@dataclass(frozen=True)
class Feed:
    """What a file holds. checks: reason to the condition (SQL) of a good row, tried in order. unique: the column that names a row, if any."""

    name: str
    schema: str
    checks: Mapping[str, str]
    unique: str | None = None
    options: Mapping[str, str] | None = None


RVU = Feed("rvu", RVU_SCHEMA, {"no_cpt_code": "trim(cpt_code) <> ''", "no_rvu_value": "rvu_value is not null and not isnan(rvu_value)", "rvu_value_below_zero": "rvu_value >= 0"}, "cpt_code")
TRAINING = Feed("training", TRAINING_SCHEMA, {"no_target": "trim(target_filter_id) <> ''", "charge_below_zero": "coalesce(total_charge_amount, 0) >= 0", "count_below_zero": "least(num_diagnoses, num_line_items, 0) = 0"})


def parse(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """Each line as a row: the feed's columns, file, reason (null for a good row) and the raw text of a line that can't be parsed.

    A line has one record: quoted line ends aren't joined, so that large files
    can be split. A file whose header has other names ends the load.
    """
    reader = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, enforceSchema=False, **(feed.options or {}))
    rows = reader.schema(f"{feed.schema}, {BROKEN} string").csv(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("reason", reason_of(feed))


def reason_of(feed: Feed) -> Column:
    found = F.when(F.col(BROKEN).isNotNull(), F.lit("malformed"))
    for reason, good in feed.checks.items():
        found = found.when(~F.coalesce(F.expr(good), F.lit(False)), F.lit(reason))
    return found


def split(parsed: DataFrame, feed: Feed) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects (reason, record, file, n lines) of parsed lines.

    With a unique column, equal rows are kept once and the rest of them are
    rejects (repeated_row); rows of one key that differ are all rejects
    (contradicting_rows). Equal rows are counted before anything else, so a key
    that most lines have is only as large as its different rows.
    """
    columns = [c for c in parsed.columns if c not in (BROKEN, "file", "reason")]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    bad = parsed.where("reason is not null").select("reason", F.coalesce(F.col(BROKEN), record).alias("record"), "file", F.lit(1).cast("long").alias("n"))
    good = parsed.where("reason is null")
    if feed.unique is None:
        return good.select(*columns), bad
    each = good.groupBy(*columns).agg(F.count("*").alias("n"), F.min("file").alias("file"))
    forms = each.groupBy(feed.unique).agg(F.count("*").alias("forms"))
    told = each.join(forms, feed.unique)
    rejects = told.where("forms > 1 or n > 1").select(
        F.when(F.col("forms") > 1, "contradicting_rows").otherwise("repeated_row").alias("reason"), record.alias("record"), "file", F.when(F.col("forms") > 1, F.col("n")).otherwise(F.col("n") - 1).alias("n"))
    return told.where("forms = 1").select(*columns), bad.unionByName(rejects)


class Feeds(Folders):
    """Tables loaded from files, below a folder that the cluster shares."""

    def load(self, path: str, feed: Feed) -> DataFrame:
        """Replaces the feed's rows and rejects by those of the files at path: one row of lines, loaded, rejected, replaced."""
        self._finish(feed.name)
        parsed = parse(self.spark, path, feed)
        parsed.write.mode("overwrite").parquet(self.path(f"{feed.name}-parsed"))
        rows, rejects = split(self.spark.read.schema(parsed.schema).parquet(self.path(f"{feed.name}-parsed")), feed)
        rejects.write.mode("overwrite").parquet(self.path(f"{feed.name}-rejects"))
        rows.write.mode("overwrite").parquet(self.path(f"{feed.name}-new"))
        new = self.spark.read.schema(rows.schema).parquet(self.path(f"{feed.name}-new"))
        loaded = new.count()  # one number
        if loaded:
            self._finish(feed.name)
        else:
            self.drop(f"{feed.name}-new")
        rejected = self.rejects(feed).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rejected"))
        self.drop(f"{feed.name}-parsed")
        return rejected.select((F.col("rejected") + loaded).alias("lines"), F.lit(loaded).cast("long").alias("loaded"), "rejected", F.lit(loaded > 0).alias("replaced"))

    def rows(self, feed: Feed) -> DataFrame:
        if not self.exists(feed.name):
            self._finish(feed.name)
        return self.spark.read.schema(feed.schema).parquet(self.path(feed.name))

    def rejects(self, feed: Feed) -> DataFrame:
        return self.spark.read.schema(REJECTS).parquet(self.path(f"{feed.name}-rejects"))

    def _finish(self, name: str) -> None:
        """Puts a new version that was written whole and isn't empty in place of the old one; what a killed load left half written goes."""
        new = f"{name}-new"
        if self.exists(new, "_SUCCESS") and not self.spark.read.parquet(self.path(new)).isEmpty():
            self.drop(name)
            self.move(self.path(new), self.path(name))
        else:
            self.drop(new)


def settings(path: str, env: Mapping[str, str] | None = None) -> dict[str, object]:
    """Settings from a YAML or JSON file on the driver, with ${NAME} and ${NAME:-default} expanded. An empty file has none."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("settings in YAML need PyYAML; the same settings in a .json file do not") from missing
        found = yaml.safe_load(text)
    if not isinstance(found or {}, dict):
        raise ValueError(f"{path} holds no mapping")
    return resolve(found or {}, None if env is None else dict(env))
