"""Queries of the reports on operations and predictors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import performance
from ..sources.testdata import Tables
from .oracle import AS_OF_EVENTS, sql
from .queries import P, query

_WINDOWS = {"minute": 60, "hour": 3600, "day": 86_400, "month": 30 * 86_400}
_TIMINGS = " timings AS (SELECT name || '_' || bucket AS operation, ts, value AS seconds, 1 + point_id % 7 AS items, point_id % 11 = 0 AS failed FROM metric_points)"
_CALLS = """ calls AS (SELECT event_id AS call_id, ts, 'v' || (user_id % 3) AS model_version, CASE WHEN event_id % 4 = 0 THEN 2 + user_id % 30 ELSE 1 END AS batch_size, cents AS inference_ms, event_type = 'error' AS failed FROM ev),
done AS (SELECT * FROM calls WHERE NOT failed),
placed AS (SELECT *, inference_ms::DOUBLE / batch_size AS v, row_number() OVER w AS place FROM done WINDOW w AS (PARTITION BY model_version, batch_size = 1 ORDER BY ts DESC, call_id DESC)),
firsts AS (SELECT model_version, batch_size = 1 AS single, max(place) AS place FROM placed WHERE v > 0 GROUP BY 1, 2),
means AS (SELECT p.model_version, p.batch_size = 1 AS single, sum(v * pow(0.9::DOUBLE, p.place - 1) * CASE WHEN p.place = f.place THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) AS mean
  FROM placed p JOIN firsts f ON f.model_version = p.model_version AND f.single = (p.batch_size = 1) GROUP BY 1, 2),
ends AS (SELECT model_version, max(ts) AS last_prediction FROM done GROUP BY 1),
recent AS (SELECT model_version, sum(batch_size) / greatest(date_diff('microsecond', min(ts), max(last_prediction)) / 1e6::DOUBLE, 1.0::DOUBLE) AS pps FROM done JOIN ends USING (model_version) WHERE ts > last_prediction - INTERVAL 5 MINUTE GROUP BY 1)"""


def timings(t: Tables) -> DataFrame:
    p = F.col("point_id")
    return t.metric_points.select(F.concat("name", F.lit("_"), F.col("labels")["bucket"]).alias("operation"), "ts", F.col("value").alias("seconds"), (1 + p % 7).alias("items"), (p % 11 == 0).alias("failed"))


def calls(t: Tables) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id")
    cents = (F.round(F.col("value") * 100).cast("bigint").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")
    return t.events.select(
        e.alias("call_id"), "ts", F.concat(F.lit("v"), (user % 3).cast("string")).alias("model_version"), F.when(e % 4 == 0, 2 + user % 30).otherwise(1).alias("batch_size"), cents.alias("inference_ms"), (F.col("event_type") == "error").alias("failed"))


query("performance_operations", sql("""SELECT operation, count(*) AS total_count, sum(seconds)::DECIMAL(18,2) AS total_seconds, min(seconds)::DECIMAL(18,2) AS min_seconds, max(seconds)::DECIMAL(18,2) AS max_seconds, count(*) FILTER (failed) AS error_count,
  round(count(*) FILTER (failed) / count(*)::DOUBLE, 6) AS error_rate, round(sum(seconds)::DOUBLE / count(seconds) * 1000, 6) AS avg_ms FROM timings GROUP BY 1""", _TIMINGS))(lambda t: performance.operations(timings(t)))
query("performance_throughput", sql(f"""SELECT o.operation, w AS "window", coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(seconds), 0)::DECIMAL(18,2) AS seconds, CASE WHEN sum(seconds) > 0 THEN round(sum(items) / sum(seconds)::DOUBLE, 6) ELSE 0 END AS rate
  FROM (SELECT DISTINCT operation FROM timings) o CROSS JOIN (VALUES {", ".join(f"('{w}', {n})" for w, n in _WINDOWS.items())}) v(w, n)
  LEFT JOIN timings t ON t.operation = o.operation AND ts > {AS_OF_EVENTS} - to_seconds(n) AND ts <= {AS_OF_EVENTS} GROUP BY 1, 2""", _TIMINGS))(lambda t: performance.throughput(timings(t), P.as_of_events, _WINDOWS))
query("predictor_report", sql("""SELECT c.model_version, coalesce(sum(batch_size) FILTER (NOT failed), 0)::BIGINT AS total_predictions, count(*) FILTER (NOT failed AND batch_size > 1) AS batch_predictions, count(*) FILTER (failed) AS error_count,
  max(ts) FILTER (NOT failed) AS last_prediction, round(coalesce((SELECT mean FROM means m WHERE m.model_version = c.model_version AND single), 0), 6) AS avg_inference_ms,
  round(coalesce((SELECT mean FROM means m WHERE m.model_version = c.model_version AND NOT single), 0), 6) AS avg_batch_inference_ms, round(coalesce((SELECT pps FROM recent r WHERE r.model_version = c.model_version), 0), 6) AS predictions_per_second,
  round(count(*) FILTER (failed) / greatest(sum(batch_size) FILTER (NOT failed), 1)::DOUBLE, 6) AS error_rate FROM calls c GROUP BY 1""", _CALLS))(lambda t: performance.predictor(calls(t)))
