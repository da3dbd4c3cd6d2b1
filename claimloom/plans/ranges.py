"""Queries that join on ranges of time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.testdata import Tables
from .oracle import sql
from .queries import query


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("points_in_failures", sql("""SELECT failed_id, count(*) AS points, sum(value)::DECIMAL(18,2) AS total FROM failed_claims JOIN metric_points p ON p.ts BETWEEN failed_at AND resolved_at WHERE resolved_at IS NOT NULL GROUP BY 1"""))
def points_in_failures(t: Tables) -> DataFrame:
    """Metric points of any name while a failed claim was open, for those that have been resolved."""
    open_ = t.failed_claims.where("resolved_at is not null").select("failed_id", "failed_at", "resolved_at")
    met = intervals.totals_within(t.metric_points, micros("ts"), F.col("value"), open_, "failed_id", micros("failed_at"), micros("resolved_at"))
    return met.select("failed_id", F.col("n").alias("points"), F.col("total").cast("decimal(18,2)").alias("total"))


@query("overlapping_stays", sql("""SELECT x.patient_id, least(x.claim_key, y.claim_key) AS a, greatest(x.claim_key, y.claim_key) AS b, (least(x.end_date, y.end_date)::DATE - greatest(x.service_date, y.service_date)::DATE + 1)::BIGINT AS days
FROM claims x JOIN claims y ON x.patient_id = y.patient_id AND x.claim_key < y.claim_key AND x.service_date <= y.end_date AND y.service_date <= x.end_date"""))
def overlapping_stays(t: Tables) -> DataFrame:
    """A patient's claims whose stays share a day, and how many they share."""
    stays = t.claims.select("patient_id", "claim_key", F.unix_date("service_date").alias("from"), F.unix_date("end_date").alias("to"))
    met = intervals.overlaps(stays, "claim_key", F.col("from"), F.col("to"), ["patient_id"])
    return met.select("patient_id", "a", "b", (F.col("last") - F.col("first") + 1).alias("days"))


@query("failures_at_once", sql("""SELECT x.failed_id AS a, y.failed_id AS b FROM failed_claims x JOIN failed_claims y ON x.failed_id < y.failed_id AND x.failed_at <= y.resolved_at AND y.failed_at <= x.resolved_at"""))
def failures_at_once(t: Tables) -> DataFrame:
    """Pairs of resolved failures that were open at the same time, whatever they have in common besides."""
    return intervals.overlaps(t.failed_claims, "failed_id", micros("failed_at"), micros("resolved_at")).select("a", "b")
