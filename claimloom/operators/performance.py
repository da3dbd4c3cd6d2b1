"""Reports of operations and of predictors in one piece: totals, errors, moving averages and rates up to the last call."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at


def operations(timings: DataFrame) -> DataFrame:
    """Of each operation its calls, seconds in total, least and most, errors, share of errors and mean milliseconds.

    timings: operation, ts, seconds, items, failed. A null duration is a call without a measurement.
    """
    x = timings.groupBy("operation").agg(
        F.count("*").alias("total_count"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("decimal(18,2)").alias("total_seconds"), F.min("seconds").cast("decimal(18,2)").alias("min_seconds"),
        F.max("seconds").cast("decimal(18,2)").alias("max_seconds"), F.count_if("failed").alias("error_count"), F.count("seconds").alias("_measured"),
    )
    mean = F.when(F.col("_measured") > 0, F.round(F.col("total_seconds").cast("double") / F.col("_measured") * 1000, 6)).otherwise(0.0)
    return x.withColumns({"error_rate": F.round(F.col("error_count") / F.col("total_count"), 6), "avg_ms": mean}).drop("_measured")


def throughput(timings: DataFrame, as_of: datetime, windows: Mapping[str, int]) -> DataFrame:
    """Of each operation and trailing window (name to seconds): items, seconds and items a second as sum over sum; zeros where nothing came.

    All windows are counted in one pass, and only rows of the longest are read.
    """
    within = {name: (F.col("ts") > at(as_of) - F.make_dt_interval(secs=F.lit(size))) & (F.col("ts") <= at(as_of)) for name, size in windows.items()}
    longest = within[max(windows, key=windows.__getitem__)]
    sums = []
    for name, inside in within.items():
        items, seconds = (F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)) for c in ("items", "seconds"))
        sums.append(F.struct(F.lit(name).alias("window"), items.cast("bigint").alias("items"), seconds.cast("decimal(18,2)").alias("seconds")).alias(name))
    names = timings.select("operation").distinct()
    x = names.join(timings.where(longest).groupBy("operation").agg(*sums), "operation", "left")
    filled = [F.coalesce(F.col(f"`{n}`"), F.struct(F.lit(n).alias("window"), F.lit(0).cast("bigint").alias("items"), F.lit(0).cast("decimal(18,2)").alias("seconds"))) for n in windows]
    rows = x.select("operation", F.inline(F.array(*filled)))
    return rows.withColumn("rate", F.when(F.col("seconds") > 0, F.round(F.col("items") / F.col("seconds").cast("double"), 6)).otherwise(0.0))


def predictor(calls: DataFrame, weight: float = 0.1, window_seconds: int = 300, block: str = "hour") -> DataFrame:
    """Of each model version: predictions, batches, moving averages of the milliseconds of single calls and, for each claim, of batches,
    errors, their share, predictions a second and the last prediction.

    calls: call_id, ts, model_version, batch_size, inference_ms, failed. A
    failed call is an error and nothing else. An average starts with its first
    value above zero; a null duration moves none. The rate covers the window
    that ends with the last prediction, and at least a second.

    The average is a sum of values by powers of (1 - weight), so all that a row
    needs is its place from the end. Places come from counts by block of time,
    so a version with all calls is spread over its blocks.
    """
    done = calls.where("not failed")
    keep = 1.0 - weight
    single = F.col("batch_size") == 1
    value = F.col("inference_ms").cast("double") / F.col("batch_size")
    timed = done.where("inference_ms is not null").select("model_version", single.alias("single"), "ts", "call_id", value.alias("value"), F.date_trunc(block, "ts").alias("b"))
    key = ["model_version", "single"]
    counts = timed.groupBy(*key, "b").agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.partitionBy(*key).orderBy(F.desc("b"))) - F.col("n")
    after = counts.select(*[F.col(c).alias(f"_{c}") for c in (*key, "b")], later.alias("after"))
    same: Column = F.lit(True)
    for c in (*key, "b"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*key, "b").orderBy(F.desc("ts"), F.desc("call_id"))) - 1
    x = timed.withColumn("inner", place).join(after, same).withColumn("power", F.pow(F.lit(keep), F.col("after") + F.col("inner")))
    first = F.min(F.when(F.col("value") > 0, F.struct("ts", "call_id", (F.col("value") * F.col("power")).alias("start"))))
    means = x.groupBy(*key).agg((F.sum(F.col("value") * F.col("power")) * weight + F.coalesce(first["start"], F.lit(0.0)) * keep).alias("mean"))
    means = means.groupBy("model_version").agg(*[F.round(F.coalesce(F.max(F.when(F.col("single") == flag, F.col("mean"))), F.lit(0.0)), 6).alias(name) for flag, name in ((True, "avg_inference_ms"), (False, "avg_batch_inference_ms"))])
    totals = calls.groupBy("model_version").agg(
        F.coalesce(F.sum(F.when(~F.col("failed"), F.col("batch_size"))), F.lit(0)).cast("bigint").alias("total_predictions"), F.count_if(~F.col("failed") & (F.col("batch_size") > 1)).alias("batch_predictions"),
        F.count_if("failed").alias("error_count"), F.max(F.when(~F.col("failed"), F.col("ts"))).alias("last_prediction"),
    )
    ends = totals.select(F.col("model_version").alias("_model_version"), "last_prediction")
    own = F.col("model_version").eqNullSafe(F.col("_model_version"))
    recent = done.join(ends, own & (F.col("ts") > F.col("last_prediction") - F.make_dt_interval(secs=F.lit(window_seconds))))
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("last_prediction")) / F.lit(1e6)
    rates = recent.groupBy("model_version").agg(F.round(F.sum("batch_size") / F.greatest(span, F.lit(1.0)), 6).alias("predictions_per_second"))
    out = totals
    for i, part in enumerate((means, rates)):
        out = out.join(part.withColumnRenamed("model_version", f"_version{i}"), F.col("model_version").eqNullSafe(F.col(f"_version{i}")), "left").drop(f"_version{i}")
    share = F.round(F.col("error_count") / F.greatest("total_predictions", F.lit(1)), 6)
    return out.na.fill(0.0, ["avg_inference_ms", "avg_batch_inference_ms", "predictions_per_second"]).withColumn("error_rate", share)
