"""Metrics, errors, alerts and health as queries over event tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MONEY, at, label_key, mean, percent, since
from . import machines

#: Trailing windows of the metrics report, in minutes.
WINDOWS = {"1h": 60, "6h": 360, "24h": 1440, "7d": 10080}


def metric_windows(points: DataFrame, as_of: datetime, windows: dict[str, int] | None = None) -> DataFrame:
    """Each metric over each trailing window: latest value of counters and gauges, sums of histograms and timers.

    A point enters every window that reaches it (one row for each), then one
    aggregation by metric and window.
    """
    sizes = WINDOWS if windows is None else windows
    reach = F.array_compact(F.array(*[F.when(F.col("ts") >= at(as_of) - F.expr(f"INTERVAL {m} MINUTES"), F.lit(w)) for w, m in sizes.items()]))
    x = points.withColumn("metric", label_key(F.col("name"), F.col("labels"))).withColumn("window", F.explode(reach))
    last = F.max_by("value", F.struct("ts", "point_id"))
    latest = F.col("type").isin("counter", "gauge")
    g = x.groupBy("metric", "type", "window").agg(F.count("*").alias("n"), last.alias("l"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"), mean("value").alias("m"))
    pick = lambda other: F.when(latest, F.col("l")).otherwise(F.col(other)).cast(MONEY)
    return g.select("metric", "type", "window", "n", pick("s").alias("sum_value"), pick("lo").alias("min_value"), pick("hi").alias("max_value"), F.when(latest, F.col("l").cast("double")).otherwise(F.col("m")).alias("avg_value"))


def nearest_rank(points: DataFrame, group: str = "name") -> DataFrame:
    """Count, range, mean and the 0-based nearest-rank quantiles value[int(n * q)]; times also in milliseconds.

    Ranks come from counts of distinct values and their running sums, so no
    group's values are gathered into one array.
    """
    counts = points.where(F.col("type").isin("histogram", "timer")).groupBy(group, "type", "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy(group, "type")
    ranked = counts.withColumn("upto", F.sum("n").over(own.orderBy("value"))).withColumn("all", F.sum("n").over(own))
    q = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * p), F.col("all") - 1), F.col("value"))).cast("double")
    out = ranked.groupBy(group, "type").agg(F.max("all").alias("n"), F.min("value").cast("double").alias("min_value"), F.max("value").cast("double").alias("max_value"), (F.sum(F.col("value") * F.col("n")).cast("double") / F.max("all")).alias("avg_value"), *[q(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)])
    return out.withColumn("avg_ms", F.when(F.col("type") == "timer", F.col("avg_value") * 1000))


def health_score(points: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Error rate, throughput and mean time of the last hours, and a score that loses points over thresholds."""
    own = points.where(since("ts", as_of, hours, "HOURS"))
    n, bad = F.count("*"), F.count_if(F.col("name") == "error")
    x = own.agg(n.alias("n"), bad.alias("errors"), mean("value").alias("avg_value")).withColumn("error_rate", percent(F.col("errors"), F.col("n"))).withColumn("per_second", F.col("n") / F.lit(hours * 3600.0))
    lost = F.when(F.col("error_rate") > 10, 30).when(F.col("error_rate") > 5, 15).otherwise(0) + F.when(F.col("per_second") < 1000, 20).otherwise(0) + F.when(F.col("avg_value") > 10, 15).otherwise(0)
    return x.withColumn("health_score", F.greatest(F.lit(100) - lost, F.lit(0)).cast("int"))


def error_distributions(errors: DataFrame) -> DataFrame:
    """Counts by code, category, component, severity, impact and hour: (dimension, value, n), in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in [(k, F.col(k)) for k in ("code", "category", "component", "severity", "impact")] + [("hour", F.date_format("ts", "yyyy-MM-dd-HH"))]])
    return errors.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def error_rate(errors: DataFrame, as_of: datetime, minutes: int) -> DataFrame:
    return errors.where(since("ts", as_of, minutes, "MINUTES")).groupBy("category").agg((F.count("*") / F.lit(float(max(minutes, 1)))).alias("per_minute"))


def error_clusters(errors: DataFrame) -> DataFrame:
    """Each category and component with its number of errors, codes and times."""
    return errors.groupBy(F.concat_ws("_", "category", "component").alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def error_temporal(errors: DataFrame) -> DataFrame:
    """Counts by hour of day and by weekday, the peak of each flagged (ties: smallest)."""
    pairs = F.array(F.struct(F.lit("hour").alias("kind"), F.lpad(F.hour("ts").cast("string"), 2, "0").alias("slot")), F.struct(F.lit("weekday").alias("kind"), F.date_format("ts", "EEEE").alias("slot")))
    counts = errors.select(F.inline(pairs)).groupBy("kind", "slot").agg(F.count("*").alias("n"))
    return counts.withColumn("is_peak", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "slot")) == 1)


def error_cooccurrence(errors: DataFrame, minutes: int = 30, least: int = 2) -> DataFrame:
    """Pairs of codes seen in the same time bucket, in `least` buckets or more. Distinct codes of a bucket are few and bounded."""
    bucket = F.window("ts", f"{minutes} minutes").start
    codes = errors.select(bucket.alias("bucket"), "code").distinct()
    a, b = codes.select("bucket", F.col("code").alias("code_a")), codes.select("bucket", F.col("code").alias("code_b"))
    return a.join(b, "bucket").where("code_a < code_b").groupBy("code_a", "code_b").agg(F.count("*").alias("buckets")).where(F.col("buckets") >= least)


def recovery_effectiveness(errors: DataFrame) -> DataFrame:
    """Attempts and successes by category and code, and over all."""
    tried = errors.where("attempted")
    hits = F.count_if("recovered")
    x = tried.rollup(F.concat_ws("_", "category", "code").alias("key")).agg(F.count("*").alias("attempts"), hits.alias("successes"), percent(hits, F.count("*")).alias("success_rate"))
    return x.withColumn("key", F.coalesce("key", F.lit("overall")))


def operation_stats(points: DataFrame, keep: int = 1000) -> DataFrame:
    """Each operation over its last `keep` points: counts, range, mean, success rate.

    Spark keeps the last points of each task before it shuffles, up to 1,000 for a key.
    """
    place = F.row_number().over(Window.partitionBy("name", "bucket").orderBy(F.desc("ts"), F.desc("point_id")))
    x = points.withColumn("bucket", F.col("labels")["bucket"]).withColumn("_place", place).where(F.col("_place") <= keep)
    good = F.count_if(F.col("value") < 100)
    return x.groupBy("name", "bucket").agg(F.count("*").alias("n"), F.sum("value").cast(MONEY).alias("sum_value"), F.min("value").cast(MONEY).alias("min_value"), F.max("value").cast(MONEY).alias("max_value"), mean("value").alias("avg_value"), percent(good, F.count("*")).alias("success_rate"))


def keep_last(points: DataFrame, n: int, key: str = "name") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("point_id")))
    return points.withColumn("place", place).where(F.col("place") <= n)


def _blocks(points: DataFrame, key: str, block: str) -> tuple[DataFrame, Column]:
    """Rows with the time block that they fall in, and the columns that tell a key's blocks apart, nulls included."""
    x = points.withColumn("_block", F.date_trunc(block, "ts"))
    return x, F.struct(F.col(key).alias("k"), F.col("_block").alias("b"))


def rolling_mean(points: DataFrame, n: int = 100, key: str = "name", block: str = "hour", chunk: int = 100_000) -> DataFrame:
    """Mean of each row and the n - 1 before it. Null values don't count; repeated places count in any order.

    Rows are numbered by block counts and their running sums, cut into chunks of
    `chunk` numbers, and the last n - 1 of a chunk also go to the next one, so a
    key with a third of all rows is spread over its chunks.
    """
    x, name = _blocks(points, key, block)
    x = x.withColumn("_name", name)
    counts = x.groupBy("_name").agg(F.count("*").alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy("_name.k").orderBy("_name.b"))
    before = counts.select(F.col("_name").alias("_at"), (upto - F.col("_rows")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_name").orderBy("ts", "point_id")) - 1
    x = x.withColumn("_inner", inner).join(before, F.col("_name").eqNullSafe(F.col("_at"))).withColumn("_place", F.col("_before") + F.col("_inner"))
    size = max(chunk, n)
    own = F.floor(F.col("_place") / size)
    late = F.col("_place") % size > size - n
    x = x.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(key, "_chunk").orderBy("_place").rowsBetween(1 - n, 0)
    rolled = x.withColumn("rolling_avg", F.sum("value").over(frame).cast("double") / F.count("value").over(frame))
    return rolled.where("_chunk = _own").select(*points.columns, "rolling_avg")


def moving_average(points: DataFrame, weight: float = 0.1, key: str = "name", block: str = "hour") -> DataFrame:
    """Exponential moving average over all values, seeded by the first one; null values change nothing.

    Each block of time is folded apart, from nothing, to the decay of what came
    before it and the sum of its own values. A fold over the blocks then gives
    each the mean that it starts from, so no key is one task's work.
    """
    keep = 1 - weight

    def inner(batches):  # the rows of each block in order
        import pyarrow as pa

        last, decay, own, n = None, 1.0, 0.0, 0
        for batch in batches:
            out = []
            for k, b, v in zip(*(batch.column(c).to_pylist() for c in ("_key", "_block", "_v")), strict=True):
                if (k, b) != last:
                    last, decay, own, n = (k, b), 1.0, 0.0, 0
                if v is not None:
                    decay, own, n = decay * keep, own * keep + v * weight, n + 1
                out.append((decay, own, n))
            more = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.record_batch([*batch.columns, *more], [*batch.schema.names, "_decay", "_own", "_n"])

    def outer(batches):  # the blocks of each key in order
        import pyarrow as pa

        last, mean_, seeded = object(), None, False
        for batch in batches:
            out = []
            for k, first, decay, own in zip(*(batch.column(c).to_pylist() for c in ("_k", "_first", "_d", "_o")), strict=True):
                if k != last:
                    last, mean_, seeded = k, None, False
                start, was = (mean_ if seeded else first), seeded
                if start is not None:
                    mean_, seeded = decay * start + own, True
                out.append((start, was))
            yield pa.record_batch([batch.column("_k"), batch.column("_b"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.bool_())], ["_k", "_b", "_start", "_seeded"])

    x = points.withColumn("_key", F.col(key).cast("string")).withColumn("_block", F.unix_micros(F.date_trunc(block, "ts").cast("timestamp"))).withColumn("_v", F.col("value").cast("double"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    folded = x.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "ts", "point_id").mapInArrow(inner, f"{kinds}, _decay double, _own double, _n long")
    place = F.struct("ts", "point_id")
    ends = folded.groupBy(F.col("_key").alias("_k"), F.col("_block").alias("_b")).agg(F.min_by(F.col("_v"), F.when(F.col("_v").isNotNull(), place)).alias("_first"), F.max_by("_decay", place).alias("_d"), F.max_by("_own", place).alias("_o"))
    starts = ends.repartition("_k").sortWithinPartitions("_k", "_b").mapInArrow(outer, "_k string, _b long, _start double, _seeded boolean")
    mine = F.col("_key").eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b"))
    known = F.col("_seeded") | (F.col("_n") > 0)
    return folded.join(starts, mine).withColumn("ema", F.when(known, F.col("_decay") * F.col("_start") + F.col("_own"))).select(*points.columns, "ema")


def trailing_rate(points: DataFrame, seconds: int = 300, key: str = "name") -> DataFrame:
    """Points of the last seconds (start excluded) over the time they span, one second at least.

    Time is cut into ranges of twelve times `seconds`; the points of a range's
    last `seconds` also go to the next one, so no key is one task's work. Points
    without a time count among themselves and have no rate.

    No frame is summed for each point: the points of a moment are counted once,
    and each moment also leaves a mark `seconds` earlier. Counts that run up to
    the moment and to its mark differ by the points between; the first of these
    is met last when the range is walked backwards to the mark.
    """
    reach = seconds * 1_000_000
    width = 12 * reach
    at_ = F.unix_micros(F.col("ts").cast("timestamp"))
    moments = points.select(F.col(key).alias("_key"), at_.alias("_at")).where("_at is not null").groupBy("_key", "_at").agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_at") / width)
    late = F.pmod(F.col("_at"), F.lit(width)) > width - reach
    x = moments.withColumn("_own", own).withColumn("_range", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    point, mark = F.lit(0), F.lit(1)  # at one moment a point comes before a mark, as the start is excluded
    both = F.filter(F.array(F.struct(F.col("_at").alias("place"), point.alias("kind")), F.struct((F.col("_at") - reach).alias("place"), mark.alias("kind"))), lambda m: (m["kind"] == point) | (F.col("_own") == F.col("_range")))
    x = x.withColumn("m", F.explode(both)).select("_key", "_range", "_own", "_at", "_n", "m.place", "m.kind")
    each = Window.partitionBy("_key", "_range")
    up = each.orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = each.orderBy(F.desc("place"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    is_point = F.col("kind") == point
    x = x.withColumn("_upto", F.sum(F.when(is_point, F.col("_n")).otherwise(0)).over(up)).withColumn("_first", F.min(F.when(is_point, F.col("_at"))).over(down))
    rates = x.where("_range = _own").groupBy("_key", "_at").agg((F.max(F.when(is_point, F.col("_upto"))) - F.max(F.when(~is_point, F.col("_upto")))).alias("_count"), F.max(F.when(~is_point, F.col("_first"))).alias("_first"))
    span = F.greatest((F.col("_at") - F.col("_first")) / F.lit(1e6), F.lit(1.0))
    rates = rates.select("_key", F.col("_at").alias("_moment"), (F.col("_count") / span).alias("rate"))
    met = F.col(key).eqNullSafe(F.col("_key")) & (at_ == F.col("_moment"))
    return points.join(rates, met, "left").select(*points.columns, "rate")


def streaks(results: DataFrame, key: str = "name", block: str = "hour") -> DataFrame:
    """Failures in a row up to each point; an unknown outcome ends a row as a success does.

    Each block of time counts on its own; rows before a block's first success
    also take what the blocks before it carry over, summed over blocks only.
    """
    x, name = _blocks(results, key, block)
    x = x.withColumn("_name", name).withColumn("_bad", F.coalesce(F.col("failed"), F.lit(False)).cast("long"))
    order = Window.partitionBy("_name").orderBy("ts", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_run", F.sum(1 - F.col("_bad")).over(order))
    inner = Window.partitionBy("_name", "_run").orderBy("ts", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_streak", F.sum("_bad").over(inner))
    runs = x.groupBy("_name", "_run").agg(F.sum("_bad").alias("_tail"))
    ends = runs.groupBy("_name").agg(F.max("_run").alias("_good"), F.max_by("_tail", "_run").alias("_tail"))
    keyed = Window.partitionBy("_name.k").orderBy("_name.b")
    ends = ends.withColumn("_series", F.sum((F.col("_good") > 0).cast("long")).over(keyed))
    ends = ends.withColumn("_out", F.sum("_tail").over(Window.partitionBy("_name.k", "_series").orderBy("_name.b")))
    carried = ends.select(F.col("_name").alias("_place"), F.coalesce(F.lag("_out").over(keyed), F.lit(0)).alias("_carry"))
    joined = x.join(carried, F.col("_name").eqNullSafe(F.col("_place")))
    return joined.withColumn("streak", F.col("_streak") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)).select(*results.columns, "streak")


Breaker = tuple[str, int, int, float]  # state, failures and successes in a row, when it opened
CLOSED: Breaker = ("CLOSED", 0, 0, 0.0)


def breaker_step(state: Breaker, t: float, failed: bool, threshold: int = 5, timeout_seconds: int = 60) -> tuple[str, Breaker]:
    """The state that a call meets, and the breaker after it."""
    kind, bad, good, opened = state
    if kind == "OPEN" and t - opened >= timeout_seconds:
        kind, good = "HALF_OPEN", 0
    met = kind
    if kind != "OPEN":
        bad, good = (bad + 1, 0) if failed else (0, good + 1)
        if failed and (kind == "HALF_OPEN" or bad >= threshold):
            kind, opened = "OPEN", t
        elif not failed and kind == "HALF_OPEN" and good >= 3:
            kind = "CLOSED"
    return met, (kind, bad, good, opened)


def breaker(results: DataFrame, threshold: int = 5, timeout_seconds: int = 60, key: str = "name", block_seconds: int | None = None) -> DataFrame:
    """State of a circuit breaker before each call: key, t, failed, point_id, state.

    Open from the failure that fills the threshold until the timeout, then half
    open until three successes in a row close it or a failure opens it again.
    A key's calls are spread over blocks of time (operators.machines).
    """
    machine = machines.breaking(threshold, 3, timeout_seconds * 1_000_000)
    met = machines.run(results, machine, F.col(key), F.col("ts"), F.col("failed"), F.col("point_id"), block_seconds and block_seconds * 1_000_000)
    state = F.when(F.col("met") == machines.UNMET, "OPEN").when(F.col("met") < threshold, "CLOSED").otherwise("HALF_OPEN")
    return met.select("key", (F.col("time") / F.lit(1e6)).alias("t"), (F.col("flag") == 1).alias("failed"), F.col("id").alias("point_id"), state.alias("state"))


def cooldown(alerts: DataFrame, minutes: int, key: str = "name", block_seconds: int | None = None) -> DataFrame:
    """Alerts that are sent (key, t, point_id, sent): the first, and then each that follows the last sent one by the cooldown or more.

    A key's alerts are spread over blocks of time (operators.machines).
    """
    met = machines.run(alerts, machines.cooling(minutes * 60_000_000), F.col(key), F.col("ts"), F.lit(False), F.col("point_id"), block_seconds and block_seconds * 1_000_000)
    return met.where(F.col("met") != machines.UNMET).select("key", (F.col("time") / F.lit(1e6)).alias("t"), F.col("id").alias("point_id"), F.lit(True).alias("sent"))


#: Rules of alerts as data: name, component, severity, condition over a row of health numbers, message.
ALERT_RULES = [
    ("high_error_rate", "pipeline", "HIGH", "error_rate > 10", "Error rate above 10 %"),
    ("low_throughput", "pipeline", "MEDIUM", "per_second < 10", "Throughput below 10 a second"),
    ("slow_operations", "pipeline", "LOW", "avg_value > 10", "Mean time above 10"),
]


def fire_alerts(health: DataFrame, rules: list[tuple[str, str, str, str, str]] | None = None) -> DataFrame:
    rows = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("rule"), F.lit(k).alias("component"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for n, k, s, c, m in (ALERT_RULES if rules is None else rules)]))
    return health.select(F.inline(rows))


def alert_statistics(failed: DataFrame) -> DataFrame:
    """Alerts here are failed claims: totals and resolution seconds by stage."""
    seconds = F.timestamp_diff("SECOND", F.col("failed_at"), F.col("resolved_at"))
    return failed.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Resolved").alias("resolved"), F.count_if(F.col("status") != "Resolved").alias("active"), (F.sum(seconds).cast("double") / F.count(seconds)).alias("avg_seconds"), F.max(seconds).alias("max_seconds"))


def classify(value: Column, warn: float, bad: float) -> Column:
    return F.when(value > bad, "unhealthy").when(value > warn, "degraded").otherwise("healthy")


def health_rollup(points: DataFrame, as_of: datetime, warn: float = 12.0, bad: float = 20.0) -> DataFrame:
    """Components by their mean of the last day, and the worst over all."""
    x = points.where(since("ts", as_of, 1, "DAYS")).groupBy("name").agg(mean("value").alias("v")).withColumn("health", classify(F.col("v"), warn, bad))
    counts = x.agg(*[F.count_if(F.col("health") == h).alias(h) for h in ("healthy", "degraded", "unhealthy")])
    return counts.withColumn("overall", F.when(F.col("unhealthy") > 0, "unhealthy").when(F.col("degraded") > 0, "degraded").otherwise("healthy"))


def api_metrics(points: DataFrame, keep: int = 1000) -> DataFrame:
    """Mean, range and hit ratio of the last points of each name."""
    x = keep_last(points, keep)
    hit = F.count_if(F.col("labels")["bucket"] == "0")
    return x.groupBy("name").agg(F.count("*").alias("n"), mean("value").alias("avg_value"), F.min("value").cast(MONEY).alias("min_value"), F.max("value").cast(MONEY).alias("max_value"), percent(hit, F.count("*")).alias("hit_ratio"))


def metric_state(points: DataFrame) -> DataFrame:
    """What recorders hold after all points: counters their sum, gauges the last value, samples their sum and number."""
    kind = F.when(F.col("type").isin("counter", "gauge"), F.col("type")).otherwise("samples")
    g = points.groupBy(label_key(F.col("name"), F.col("labels")).alias("metric"), kind.alias("kind")).agg(F.max_by("value", F.struct("ts", "point_id")).alias("l"), F.sum("value").alias("s"), F.count("*").alias("n"))
    return g.select("metric", "kind", F.when(F.col("kind") == "gauge", F.col("l")).otherwise(F.col("s")).cast(MONEY).alias("value"), "n")


def operation_errors(points: DataFrame, operation: Column) -> DataFrame:
    """Error counters added to the operations that have timings."""
    bad = F.col("name") == "error"
    sums = points.groupBy(operation.alias("operation")).agg(F.count_if(~bad).alias("timings"), F.sum(F.when(bad, F.col("value")).otherwise(0)).cast(MONEY).alias("error_count"))
    return sums.where("timings > 0")


def rate_windows(points: DataFrame, as_of: datetime, windows: dict[str, int] | None = None) -> DataFrame:
    """Points a minute and percent of errors in each trailing window (minutes) that has points."""
    sizes = WINDOWS if windows is None else windows
    reach = F.array_compact(F.array(*[F.when(since("ts", as_of, m, "MINUTES"), F.struct(F.lit(w).alias("window"), F.lit(m).alias("minutes"))) for w, m in sizes.items()]))
    each = points.select("name", F.inline(reach))
    n = F.count("*")
    return each.groupBy("window", "minutes").agg((n / (F.col("minutes") * F.lit(60.0)) * 60).alias("per_minute"), percent(F.count_if(F.col("name") == "error"), n).alias("error_rate")).drop("minutes")


def throughput(claims: DataFrame, key: str = "facility_id") -> DataFrame:
    """Processed, successful and failed claims by key, over the time from the first creation to the last processing."""
    n = F.count("*")
    seconds = F.timestamp_diff("SECOND", F.min("created_date"), F.max("processed_date"))
    sums = claims.where("processed_date is not null").groupBy(key).agg(n.alias("total_processed"), F.count_if(F.col("validation_status") == "VALIDATED").alias("successful"), F.count_if(F.col("validation_status") == "FAILED").alias("failed"), seconds.alias("duration_seconds"))
    return sums.withColumn("throughput", F.when(F.col("duration_seconds") > 0, F.col("total_processed") / F.col("duration_seconds")).otherwise(0.0))


def connection_report(points: DataFrame, states: DataFrame, keep: int = 100, slow: float = 50.0) -> DataFrame:
    """Each connection's number of queries, mean of its last ones, breaker state and status."""
    counts = points.groupBy("name").agg(F.count("*").alias("queries"))
    recent = keep_last(points, keep).groupBy("name").agg(mean("value").alias("avg_last_100"))
    x = counts.join(recent, "name").join(states.withColumnRenamed("key", "name"), "name")
    return x.withColumn("status", F.when(F.col("state") == "OPEN", "unhealthy").when(F.col("avg_last_100") > slow, "degraded").otherwise("healthy"))
