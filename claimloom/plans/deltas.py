"""Views kept as mergeable partial aggregates, refreshed from new rows alone.

A view keeps two tables for each part: sums, counts, lows and highs by group,
and, for distinct counts and exact percentiles, how often each value stands in a
group. A refresh aggregates the new rows only and writes them as a part of its
own (a refresh that runs again replaces its part); reading merges the parts, and
`compact` folds them into one. Parts are aggregates, so what is merged grows with
groups and values and not with rows. Rows are appended; a view whose rows change
is rebuilt.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at
from ..params import Params
from ..session import shared_folder
from ..sources.testdata import Tables
from . import views
from .queries import ORACLE, P, query


@dataclass(frozen=True)
class MergeableView:
    """Names to SQL expressions: keys, additive, low and high measures, values to count; and how merged groups and counts become the view."""

    keys: dict[str, str]
    sums: dict[str, str]
    finish: Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]
    lows: dict[str, str] = field(default_factory=dict)
    highs: dict[str, str] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)

    def _merge(self, parts: DataFrame) -> DataFrame:
        each = [f(n).alias(n) for f, names in ((F.sum, self.sums), (F.min, self.lows), (F.max, self.highs)) for n in names]
        kinds = dict(parts.dtypes)
        return parts.groupBy(*self.keys).agg(*[c.cast(kinds[n]) for c, n in zip(each, [*self.sums, *self.lows, *self.highs], strict=True)]).toDF(*self.keys, *self.sums, *self.lows, *self.highs)

    def refresh(self, folder: str, part: int, rows: DataFrame) -> None:
        """Aggregates new rows into a part."""
        own = rows.withColumns({n: F.expr(c) for n, c in (self.keys | {f"_value_{n}": c for n, c in self.values.items()}).items()})
        groups = own.groupBy(*self.keys).agg(*[f(F.expr(c)).alias(n) for f, measures in ((F.sum, self.sums), (F.min, self.lows), (F.max, self.highs)) for n, c in measures.items()])
        for n in self.values:
            counted = own.where(F.col(f"_value_{n}").isNotNull()).groupBy(*self.keys, F.col(f"_value_{n}").alias("_v")).agg(F.count("*").alias("_n"))
            counted.write.mode("overwrite").parquet(f"{folder}/value_{n}/part={part}")
        groups.write.mode("overwrite").parquet(f"{folder}/groups/part={part}")

    def result(self, spark, folder: str, since: datetime | None = None) -> DataFrame:
        """The view from its parts; since, on the hour, leaves out groups of earlier hours (the first key)."""
        hour = next(iter(self.keys))
        if since is not None and since != since.replace(minute=0, second=0, microsecond=0):
            raise ValueError("parts are kept by the hour")
        recent = lambda rows: rows if since is None else rows.where(F.col(hour) >= at(since))
        counts = lambda n: recent(spark.read.parquet(f"{folder}/value_{n}")).groupBy(*self.keys, "_v").agg(F.sum("_n").alias("_n"))
        return self.finish(self._merge(recent(spark.read.parquet(f"{folder}/groups"))), counts)

    def compact(self, spark, folder: str) -> str:
        """All parts as part 0 of a new folder, which is returned."""
        new = f"{folder.rsplit('-', 1)[0]}-{uuid.uuid4().hex}"
        self._merge(spark.read.parquet(f"{folder}/groups")).write.parquet(f"{new}/groups/part=0")
        for n in self.values:
            spark.read.parquet(f"{folder}/value_{n}").groupBy(*self.keys, "_v").agg(F.sum("_n").alias("_n")).write.parquet(f"{new}/value_{n}/part=0")
        return new


def _mean(total: str, n: str) -> Column:
    return F.col(total).cast("double") / F.col(n)


def _distinct(groups: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    found = counts.groupBy(*keys).agg(F.count("*").alias(name))
    return views.joined_null_safe(groups, found, keys, [name]).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


_HOUR = "cast(date_trunc('hour', created_date) AS timestamp_ntz)"
_FLAGS = {n: n for n in ("status", "facility_validated", "department_validated", "financial_class_validated")}
_CHARGES = {"claim_count": "1", "total_charges": "total_charge", "charged": "cast(total_charge IS NOT NULL AS int)", "exported_count": "cast(exported AS int)"}


def _processing(groups: DataFrame, counts: Callable[[str], DataFrame]) -> DataFrame:
    return groups.select("processing_hour", *_FLAGS, "claim_count", F.col("total_charges").cast("decimal(18,2)").alias("total_charges"), _mean("total_charges", "charged").alias("avg_charge"), "exported_count", "earliest", "latest")


def _volumes(groups: DataFrame, counts: Callable[[str], DataFrame]) -> DataFrame:
    keys = ["processing_hour", "status"]
    out = groups.select(*keys, "claim_count", "validated_count", "exported_count", F.col("total_charges").cast("decimal(18,2)").alias("total_charges"), _mean("total_charges", "charged").alias("avg_charge"))
    out = _distinct(_distinct(out, counts("facility"), keys, "unique_facilities"), counts("prefix"), keys, "account_prefixes")
    return views.joined_null_safe(out, views.percentiles_of_counts(counts("charge"), keys, median_charge=0.5), keys, ["median_charge"])


def _validations(groups: DataFrame, counts: Callable[[str], DataFrame]) -> DataFrame:
    keys = ["hour", "validation_type", "validation_status"]
    out = groups.select(*keys, "n", _mean("ms", "timed").alias("avg_ms"), "failed_count")
    return views.joined_null_safe(out, views.percentiles_of_counts(counts("ms"), keys, p95_ms=0.95), keys, ["p95_ms"])


MERGEABLE = {
    "mv_processing_summary": MergeableView({"processing_hour": _HOUR, **_FLAGS}, _CHARGES, _processing, lows={"earliest": "service_date"}, highs={"latest": "service_date"}),
    "v_high_volume_stats": MergeableView(
        {"processing_hour": _HOUR, "status": "status"}, _CHARGES | {"validated_count": "cast(facility_validated AS int)"}, _volumes,
        values={"facility": "facility_id", "prefix": "substring(account, 1, 3)", "charge": "cast(total_charge AS double)"},
    ),
    "mv_validation_summary": MergeableView(
        {"hour": _HOUR, "validation_type": "validation_type", "validation_status": "validation_status"},
        {"n": "1", "ms": "processing_ms", "timed": "cast(processing_ms IS NOT NULL AS int)", "failed_count": "cast(validation_status = 'FAILED' AS int)"}, _validations,
        values={"ms": "cast(processing_ms AS double)"},
    ),
}
#: What a view reads, and the days that it looks back from a moment.
SOURCES = {
    "mv_processing_summary": (lambda t, p: views.staged(t, p), lambda p: p.as_of_claims - timedelta(days=7)),
    "v_high_volume_stats": (lambda t, p: views.staged(t, p), lambda p: p.as_of_claims - timedelta(days=p.window_days)),
    "mv_validation_summary": (lambda t, p: t.validation_results, lambda p: p.as_of_events - timedelta(days=7)),
}


def with_rows(t: Tables, keep: Callable[[Column], Column]) -> Tables:
    """The same tables with some of the claims and validation results, chosen by their number."""
    own = Tables(t.spark, t.path)
    own.__dict__["claims"] = t.claims.where(keep(F.col("claim_key")))
    own.__dict__["validation_results"] = t.validation_results.where(keep(F.col("result_id")))
    return own


def refreshed(t: Tables, name: str, p: Params) -> DataFrame:
    """A view built without a hundredth of its rows, then refreshed with that hundredth."""
    view, (source, since) = MERGEABLE[name], SOURCES[name]
    folder = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    view.refresh(folder, 0, source(with_rows(t, lambda k: k % 100 != 7), p))
    view.refresh(folder, 1, source(with_rows(t, lambda k: k % 100 == 7), p))
    return view.result(t.spark, folder, since(p))


for _name in MERGEABLE:
    query(f"refreshed_{_name}", ORACLE[_name])(lambda t, name=_name: refreshed(t, name, P))
