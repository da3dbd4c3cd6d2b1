"""Alert rules over periodic checks, and the life of the alerts that they raise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at


@dataclass(frozen=True)
class AlertRule:
    name: str
    severity: str
    component: str
    cooldown_minutes: int
    condition: str  # over a row of check_facts
    message: str  # an expression over it
    auto_resolve: bool = True


# The rules with their thresholds, severities and cooldowns.
RULES = [
    AlertRule("database_unhealthy", "CRITICAL", "database", 10, "database_ms > 60", "concat('Database health check failed: ', floor(database_ms), ' ms')"),
    AlertRule("high_error_rate", "WARNING", "processing", 15, "errors * 100 > points * 10", "concat('High error rate detected: ', errors * 100 div points, '%')"),
    AlertRule("low_throughput", "WARNING", "performance", 20, "claims < 10 * seconds", "concat('Low processing throughput: ', claims, ' claims in ', seconds, ' seconds')"),
    AlertRule("high_cpu_usage", "WARNING", "system", 10, "cpu_percent > 90", "concat('High CPU usage: ', floor(cpu_percent), '%')"),
    AlertRule("high_memory_usage", "CRITICAL", "system", 5, "memory_percent > 90", "concat('High memory usage: ', floor(memory_percent), '%')"),
    AlertRule("failed_claims_accumulating", "WARNING", "claims_processing", 30, "new_failed > 50", "concat('Failed claims accumulating: ', new_failed, ' new failures')"),
]

ALERTS = "rule string, severity string, component string, message string, created_at timestamp_ntz, resolved_at timestamp_ntz"


def check_facts(points: DataFrame, failed: DataFrame, minutes: int = 10) -> DataFrame:
    """What the rules see at each check: one row for each period with metric points."""
    period = lambda c: F.window(c, f"{minutes} minutes").start.cast("timestamp_ntz").alias("checked_at")
    own = lambda name: F.when(F.col("name") == name, F.col("value"))
    facts = points.groupBy(period("ts")).agg(
        F.count("*").alias("points"), F.count(own("error")).alias("errors"), F.count(own("purchase")).alias("claims"), F.max(own("click")).alias("cpu_percent"),
        F.max(own("view")).alias("memory_percent"), (F.sum(own("signup")).cast("double") / F.count(own("signup"))).alias("database_ms"),
    )
    new = failed.where("status = 'New'").groupBy(period("failed_at")).agg(F.count("*").alias("new_failed"))
    return facts.join(new, "checked_at", "left").na.fill(0, ["new_failed"]).withColumn("seconds", F.lit(60 * minutes))


def checks(facts: DataFrame, rules: Sequence[AlertRule] = RULES) -> DataFrame:
    """Each rule at each check: whether it fires, and its message. An unknown condition doesn't fire."""
    each = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.component).alias("component"), F.lit(r.cooldown_minutes).alias("cooldown"),
            F.lit(r.auto_resolve).alias("auto_resolve"), F.coalesce(F.expr(r.condition), F.lit(False)).alias("fired"), F.expr(r.message).alias("message"),
        ) for r in rules
    ])
    return facts.select("checked_at", F.inline(each))


def lifecycle(checked: DataFrame) -> DataFrame:
    """Alerts with their id, times and status, folded over each rule's checks in order of time.

    A check within the cooldown after the rule's last alert is passed over. Else a
    rule that fires raises an alert, and one that doesn't resolves all its open
    alerts. Checks are periods, not points, so a rule's share stays small however
    many points there are.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("rule", "severity", "component", "cooldown", "auto_resolve", "fired", "message", "checked_at")
        rule, last, active = None, None, []
        schema = pa.schema([*((n, pa.string()) for n in ("rule", "severity", "component", "message")), ("created_at", pa.timestamp("us")), ("resolved_at", pa.timestamp("us"))])

        def closed(moment: datetime | None) -> list[tuple]:
            out = [(*a, moment) for a in active]
            active.clear()
            return out

        for batch in batches:
            done: list[tuple] = []
            for own, severity, component, cooldown, auto, fired, message, t in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if own != rule:
                    done += closed(None)
                    rule, last = own, None
                if last is not None and (t - last).total_seconds() < 60 * cooldown:
                    continue
                if fired:
                    active.append((own, severity, component, message, t))
                    last = t
                elif auto:
                    done += closed(t)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*done, strict=True)) or [[]] * 6, schema, strict=True)], schema=schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*closed(None), strict=True)) or [[]] * 6, schema, strict=True)], schema=schema)

    alerts = checked.repartition("rule").sortWithinPartitions("rule", "checked_at").mapInArrow(run, ALERTS)
    epoch = F.unix_seconds(F.col("created_at").cast("timestamp")).cast("string")
    return alerts.select(F.concat_ws("_", "rule", epoch).alias("alert_id"), *alerts.columns, F.when(F.col("resolved_at").isNull(), "ACTIVE").otherwise("RESOLVED").alias("status"))


def resolve(alerts: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """Open alerts among the ids, resolved by hand."""
    x = alerts.join(ids.select("alert_id").distinct().withColumn("_hit", F.lit(True)), "alert_id", "left")
    hit = F.col("_hit") & (F.col("status") != "RESOLVED")
    return x.withColumns({"resolved_at": F.when(hit, at(as_of)).otherwise(F.col("resolved_at")), "status": F.when(hit, "RESOLVED").otherwise(F.col("status"))}).drop("_hit")


def suppress(alerts: DataFrame, ids: DataFrame, as_of: datetime, minutes: int = 60) -> DataFrame:
    """Active alerts among the ids are quiet until then; suppressed_until is null for all others."""
    x = alerts.join(ids.select("alert_id").distinct().withColumn("_hit", F.lit(True)), "alert_id", "left")
    hit = F.coalesce(F.col("_hit") & (F.col("status") == "ACTIVE"), F.lit(False))
    until = F.when(hit, at(as_of) + F.expr(f"INTERVAL {minutes} MINUTES"))
    return x.withColumns({"status": F.when(hit, "SUPPRESSED").otherwise(F.col("status")), "suppressed_until": until}).drop("_hit")


def active_report(alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Unresolved alerts with their age in minutes, newest first."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), at(as_of)) / F.lit(60.0)
    return alerts.where("status <> 'RESOLVED'").withColumn("age_minutes", age).orderBy(F.desc("created_at"), "alert_id")


def history(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """The latest alerts in order, newest first."""
    top = alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "alert_id")))


def statistics(alerts: DataFrame, as_of: datetime, hours: int | None = None) -> DataFrame:
    """Alerts of the last hours (or all) by severity, component and status, with resolution seconds."""
    own = alerts if hours is None else alerts.where(F.col("created_at") >= at(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.col("resolved_at"))
    return own.groupBy("severity", "component", "status").agg(F.count("*").alias("total"), (F.sum(seconds).cast("double") / F.count(seconds)).alias("avg_seconds"), F.max(seconds).alias("max_seconds"))
