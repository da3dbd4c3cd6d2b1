"""Queries of alerts, error classes, compiled rules, models, exports and generators, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import alerts, dml, failed, monitoring, registry, rules, scoring, taxonomy, validation
from ..session import written
from ..sources import generators, readers, sinks
from ..sources.testdata import Tables
from ..streaming import jobs, signals
from .oracle import AS_OF_EVENTS, mean, sql
from .queries import P, disposed, query


def recursive(body: str, ctes: str = "") -> str:
    return sql(body, ctes).replace("WITH", "WITH RECURSIVE", 1)


# -- alerts ---------------------------------------------------------------------------------------

_CHECKS = """ facts_at AS (
  SELECT t, points, errors, claims, cpu, mem, database_ms, coalesce(n, 0) AS new_failed FROM (
    SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS t, count(*) AS points, count(*) FILTER (name = 'error') AS errors, count(*) FILTER (name = 'purchase') AS claims, max(value) FILTER (name = 'click') AS cpu,
      max(value) FILTER (name = 'view') AS mem, sum(value) FILTER (name = 'signup')::DOUBLE / count(*) FILTER (name = 'signup') AS database_ms FROM metric_points GROUP BY 1)
  LEFT JOIN (SELECT time_bucket(INTERVAL 10 MINUTE, failed_at) AS t, count(*) AS n FROM failed_claims WHERE status = 'New' GROUP BY 1) USING (t)),
checks AS (
  SELECT t, rule, severity, component, cooldown, coalesce(CASE rule WHEN 'database_unhealthy' THEN database_ms > 60 WHEN 'high_error_rate' THEN errors * 100 > points * 10 WHEN 'low_throughput' THEN claims < 6000
      WHEN 'high_cpu_usage' THEN cpu > 90 WHEN 'high_memory_usage' THEN mem > 90 ELSE new_failed > 50 END, false) AS fired,
    CASE rule WHEN 'database_unhealthy' THEN 'Database health check failed: ' || floor(database_ms)::BIGINT || ' ms' WHEN 'high_error_rate' THEN 'High error rate detected: ' || (errors * 100 // points) || '%'
      WHEN 'low_throughput' THEN 'Low processing throughput: ' || claims || ' claims in 600 seconds' WHEN 'high_cpu_usage' THEN 'High CPU usage: ' || floor(cpu)::BIGINT || '%'
      WHEN 'high_memory_usage' THEN 'High memory usage: ' || floor(mem)::BIGINT || '%' ELSE 'Failed claims accumulating: ' || new_failed || ' new failures' END AS message
  FROM facts_at, (VALUES ('database_unhealthy', 'CRITICAL', 'database', 10), ('high_error_rate', 'WARNING', 'processing', 15), ('low_throughput', 'WARNING', 'performance', 20),
    ('high_cpu_usage', 'WARNING', 'system', 10), ('high_memory_usage', 'CRITICAL', 'system', 5), ('failed_claims_accumulating', 'WARNING', 'claims_processing', 30)) v(rule, severity, component, cooldown)),
firing AS (SELECT * FROM checks WHERE fired),
onward AS MATERIALIZED (SELECT rule, t, min(t) OVER (PARTITION BY rule ORDER BY epoch(t)::BIGINT RANGE BETWEEN cooldown * 60 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM firing),
raised(rule, t) AS (SELECT rule, min(t) FROM firing GROUP BY rule UNION ALL SELECT r.rule, o.after FROM raised r JOIN onward o ON o.rule = r.rule AND o.t = r.t WHERE o.after IS NOT NULL),
quiet AS (SELECT c.rule, c.t FROM checks c ASOF JOIN raised r ON c.rule = r.rule AND c.t >= r.t WHERE NOT c.fired AND c.t >= r.t + to_minutes(c.cooldown)),
alerts AS (
  SELECT r.rule || '_' || epoch(r.t)::BIGINT AS alert_id, r.rule, f.severity, f.component, f.message, r.t AS created_at, q.t AS resolved_at, CASE WHEN q.t IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS status
  FROM raised r JOIN firing f ON f.rule = r.rule AND f.t = r.t ASOF LEFT JOIN quiet q ON q.rule = r.rule AND r.t < q.t)"""


def _alerts(t: Tables) -> DataFrame:
    return alerts.lifecycle(alerts.checks(alerts.check_facts(t.metric_points, t.failed_claims)))


_LIVE = "status <> 'RESOLVED'"
query("alert_checks", sql("SELECT t AS checked_at, rule, fired, message FROM checks", _CHECKS.split("firing AS")[0].rstrip().rstrip(",")))(lambda t: alerts.checks(alerts.check_facts(t.metric_points, t.failed_claims)).select("checked_at", "rule", "fired", "message"))
query("alert_lifecycle", recursive("SELECT * FROM alerts", _CHECKS))(_alerts)
query("alert_report", recursive(f"SELECT alert_id, rule, severity, message, date_sub('second', created_at, {AS_OF_EVENTS}) / 60.0::DOUBLE AS age_minutes FROM alerts WHERE {_LIVE}", _CHECKS))(lambda t: alerts.active_report(_alerts(t), P.as_of_events).select("alert_id", "rule", "severity", "message", "age_minutes"))
query("alert_history", recursive("SELECT alert_id, row_number() OVER (ORDER BY created_at DESC, alert_id)::INTEGER AS place FROM alerts ORDER BY created_at DESC, alert_id LIMIT 100", _CHECKS))(lambda t: alerts.history(_alerts(t), 100).select("alert_id", "place"))
query("alert_lifecycle_statistics", recursive("SELECT severity, component, status, count(*) AS total, sum(date_sub('second', created_at, resolved_at))::DOUBLE / count(resolved_at) AS avg_seconds, max(date_sub('second', created_at, resolved_at)) AS max_seconds FROM alerts GROUP BY 1, 2, 3", _CHECKS))(lambda t: alerts.statistics(_alerts(t), P.as_of_events))
query("alert_statistics_24h", recursive(f"SELECT severity, component, status, count(*) AS total FROM alerts WHERE created_at >= {AS_OF_EVENTS} - INTERVAL 24 HOUR GROUP BY 1, 2, 3", _CHECKS))(lambda t: alerts.statistics(_alerts(t), P.as_of_events, 24).select("severity", "component", "status", "total"))


@query("alert_manual_changes", recursive(f"""SELECT alert_id, CASE WHEN {_LIVE} AND rule = 'high_error_rate' THEN 'RESOLVED' WHEN {_LIVE} AND rule = 'low_throughput' THEN 'SUPPRESSED' ELSE status END AS status,
  CASE WHEN {_LIVE} AND rule = 'high_error_rate' THEN {AS_OF_EVENTS} ELSE resolved_at END AS resolved_at, CASE WHEN {_LIVE} AND rule = 'low_throughput' THEN {AS_OF_EVENTS} + INTERVAL 60 MINUTE END AS suppressed_until FROM alerts""", _CHECKS))
def alert_manual_changes(t: Tables) -> DataFrame:
    """Error-rate alerts are resolved by hand, those of throughput suppressed for an hour."""
    own = _alerts(t)
    by_hand = alerts.resolve(own, own.where("rule = 'high_error_rate'"), P.as_of_events)
    return alerts.suppress(by_hand, own.where("rule = 'low_throughput'"), P.as_of_events).select("alert_id", "status", "resolved_at", "suppressed_until")


_OVER = """ over AS MATERIALIZED (SELECT name, point_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY name ORDER BY ts, point_id) AS rn FROM metric_points WHERE value > 30),
onward AS MATERIALIZED (SELECT name, rn, min(rn) OVER (PARTITION BY name ORDER BY t RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM over),
sent(name, rn) AS (SELECT name, min(rn) FROM over GROUP BY 1 UNION ALL SELECT s.name, f.after FROM sent s JOIN onward f ON f.name = s.name AND f.rn = s.rn WHERE f.after IS NOT NULL)"""
query("alert_cooldown", recursive("SELECT name AS key, point_id FROM sent JOIN over USING (name, rn)", _OVER))(lambda t: monitoring.cooldown(t.metric_points.where("value > 30"), 60).select("key", "point_id"))

_BREAKER = """ calls AS MATERIALIZED (SELECT name, point_id, epoch_us(ts) AS t, value > 12 AS failed, row_number() OVER (PARTITION BY name ORDER BY ts, point_id) AS rn FROM metric_points),
opened AS (SELECT name, 0::BIGINT AS rn, NULL::BIGINT AS point_id, 'CLOSED' AS seen, 'CLOSED' AS kind, 0 AS bad, 0 AS good, 0::BIGINT AS since FROM (SELECT DISTINCT name FROM calls)),
walk AS (SELECT * FROM opened UNION ALL
  SELECT name, rn, point_id, now AS seen,
    CASE WHEN now = 'OPEN' THEN 'OPEN' WHEN failed AND (now = 'HALF_OPEN' OR bad + 1 >= 5) THEN 'OPEN' WHEN NOT failed AND now = 'HALF_OPEN' AND good + 1 >= 3 THEN 'CLOSED' ELSE now END AS kind,
    CASE WHEN now = 'OPEN' THEN bad WHEN failed THEN bad + 1 ELSE 0 END AS bad, CASE WHEN now = 'OPEN' THEN good WHEN failed THEN 0 ELSE good + 1 END AS good,
    CASE WHEN now <> 'OPEN' AND failed AND (now = 'HALF_OPEN' OR bad + 1 >= 5) THEN t ELSE since END AS since
  FROM (SELECT c.name, c.rn, c.point_id, c.t, c.failed, w.bad, w.since, CASE WHEN w.kind = 'OPEN' AND c.t - w.since >= 60000000 THEN 'HALF_OPEN' ELSE w.kind END AS now,
      CASE WHEN w.kind = 'OPEN' AND c.t - w.since >= 60000000 THEN 0 ELSE w.good END AS good FROM walk w JOIN calls c ON c.name = w.name AND c.rn = w.rn + 1))"""
query("circuit_breaker", recursive("SELECT name AS key, point_id, seen AS state FROM walk WHERE rn > 0", _BREAKER))(lambda t: _breaker(t).select("key", "point_id", "state"))


def _breaker(t: Tables) -> DataFrame:
    return monitoring.breaker(t.metric_points.withColumn("failed", F.col("value") > 12))


def _last_states(t: Tables) -> DataFrame:
    """The state that the last call of each key met."""
    return _breaker(t).groupBy("key").agg(F.max_by("state", F.struct("t", "point_id")).alias("state"))


_LAST_STATES = " SELECT name AS key, arg_max(seen, rn) AS state FROM walk WHERE rn > 0 GROUP BY 1"
query("connection_report", recursive(f"""SELECT name, state, queries, avg_last_100, CASE WHEN state = 'OPEN' THEN 'unhealthy' WHEN avg_last_100 > 50 THEN 'degraded' ELSE 'healthy' END AS status FROM ({_LAST_STATES}) s
  JOIN (SELECT name, count(*) AS queries FROM metric_points GROUP BY 1) n ON n.name = s.key JOIN (SELECT name, {mean('value')} AS avg_last_100 FROM (SELECT name, value FROM metric_points QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, point_id DESC) <= 100) GROUP BY 1) m USING (name)""", _BREAKER))(
    lambda t: monitoring.connection_report(t.metric_points, _last_states(t)))

# -- error classes --------------------------------------------------------------------------------

_CLASSES = " classes(code, class, category, severity, impact, component, recoverable, auto_retry, max_retries) AS (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in taxonomy.TAXONOMY) + ")"
_NAMES = "[" + ", ".join(f"'{r[0]}'" for r in taxonomy.TAXONOMY) + ", 'OTHER']"
_CLASSED = _CLASSES + f", raised AS (SELECT event_id, ({_NAMES})[k % 12 + 1] AS code FROM ev WHERE event_type = 'error' AND k IS NOT NULL), classed AS (SELECT event_id, r.code, coalesce(class, 'AppException') AS class, coalesce(category, 'Configuration') AS category, coalesce(severity, 'MEDIUM') AS severity, coalesce(impact, 'BackgroundProcess') AS impact, coalesce(component, 'Unknown') AS component, coalesce(recoverable, true) AS recoverable, coalesce(auto_retry, false) AS auto_retry, coalesce(max_retries, 3) AS max_retries FROM raised r LEFT JOIN classes c ON c.code = r.code)"


def _classed(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(r[0]) for r in taxonomy.TAXONOMY], F.lit("OTHER"))
    k = fn.json_text("props", "k").cast("int")
    raised = t.read("events").where((F.col("event_type") == "error") & k.isNotNull()).select("event_id", F.element_at(names, k % 12 + 1).alias("code"))
    return taxonomy.classified(raised, taxonomy.taxonomy(t.spark))


query("error_taxonomy", sql("SELECT * FROM classes", _CLASSES))(lambda t: taxonomy.taxonomy(t.spark))
query("errors_classified", sql("SELECT * FROM classed", _CLASSED))(_classed)
query("error_retry_plan", sql("SELECT class, category, severity, impact, count(*) AS n, count(*) FILTER (recoverable AND auto_retry) AS retried, sum(CASE WHEN recoverable AND auto_retry THEN max_retries ELSE 0 END)::BIGINT AS most_attempts FROM classed GROUP BY 1, 2, 3, 4", _CLASSED))(lambda t: taxonomy.retry_plan(_classed(t)))
_BUCKETS = " buckets AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, code FROM error_metrics)"
query("error_correlations", sql("SELECT a.code AS code_a, b.code AS code_b, count(*) AS buckets FROM buckets a JOIN buckets b ON a.bucket = b.bucket AND a.code <> b.code GROUP BY 1, 2 HAVING count(*) >= 2", _BUCKETS))(lambda t: taxonomy.correlations(t.error_metrics))
query("error_bucket_load", sql("SELECT count(*) AS total_buckets, sum(n)::DOUBLE / count(*) AS avg_errors_per_bucket FROM (SELECT count(*) AS n FROM error_metrics GROUP BY time_bucket(INTERVAL 5 MINUTE, ts))"))(lambda t: taxonomy.bucket_load(t.error_metrics))
query("error_cluster_rows", sql("SELECT category || '_' || component AS cluster, event_id, code, ts, severity FROM error_metrics"))(lambda t: taxonomy.clusters(t.error_metrics))
query("error_top_codes", sql("SELECT code, count(*) AS n FROM error_metrics GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))(lambda t: t.error_metrics.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(5))


@query("error_analysis", recursive(f"""SELECT section, count(*) AS rows FROM (
  SELECT 'patterns' AS section FROM (SELECT DISTINCT d, v FROM (SELECT unnest(['code', 'category', 'component', 'severity', 'impact', 'hour']) AS d, unnest([code, category, component, severity, impact, strftime(ts, '%Y-%m-%d-%H')]) AS v FROM error_metrics))
  UNION ALL SELECT 'error_clusters' FROM (SELECT DISTINCT category, component FROM error_metrics) UNION ALL SELECT 'temporal_patterns' FROM (SELECT DISTINCT hour(ts) FROM error_metrics UNION ALL SELECT DISTINCT dayname(ts) FROM error_metrics)
  UNION ALL SELECT 'correlation_analysis' FROM (SELECT a.code FROM buckets a JOIN buckets b ON a.bucket = b.bucket AND a.code <> b.code GROUP BY a.code, b.code HAVING count(*) >= 2) UNION ALL SELECT 'time_bucket_analysis'
  UNION ALL SELECT 'recovery_effectiveness' FROM (SELECT category, code FROM error_metrics WHERE attempted GROUP BY ROLLUP ((category, code))) UNION ALL SELECT 'circuit_breaker_status' FROM ({_LAST_STATES})) GROUP BY 1""", _BREAKER + "," + _BUCKETS))
def error_analysis(t: Tables) -> DataFrame:
    """Rows of each section of the composite analysis; each section's content has a query of its own."""
    return taxonomy.analysis_rows(taxonomy.analysis(t.error_metrics, _last_states(t))).groupBy("section").agg(F.count("*").alias("rows"))


# -- rules as text ----------------------------------------------------------------------------------

query("compiled_rules", sql("""SELECT claim_id, 'FACILITY_INACTIVE' AS rule_id, 'facility_id' AS field, 'Facility ID on claim does not exist or is inactive' AS message FROM facts WHERE facility_id IS NOT NULL AND facility_id <> '' AND NOT facility_active
  UNION ALL SELECT claim_id, 'CHARGE_TOO_LOW', 'total_charge_amount', 'Total charge amount is less than 50' FROM facts WHERE total_charge < 50 UNION ALL SELECT claim_id, 'CHARGE_TOO_HIGH', 'total_charge_amount', 'Total charge amount is over 20000' FROM facts WHERE total_charge > 20000"""))(
    lambda t: rules.apply(validation.facts(t, t.claims, P), rules.TEXTS))


@query("rules_from_table", sql("SELECT claim_id, 'CHARGE_TOO_HIGH' AS rule_id FROM claims WHERE total_charge > 20000"))
def rules_from_table(t: Tables) -> DataFrame:
    """Only active rules of the latest version are read from the table of rules; there are few."""
    table = t.spark.createDataFrame([("DATALOG", True, k == 2, text) for k, text in enumerate(rules.TEXTS)] + [("DATALOG", False, True, rules.TEXTS[0]), ("OTHER", True, True, "x")], "rule_type string, is_active boolean, is_latest_version boolean, rule_definition string")
    texts = [r.rule_definition for r in readers.active_rules(table).select("rule_definition").collect()]
    return rules.apply(validation.facts(t, t.claims, P), texts).select("claim_id", "rule_id")


# -- models -----------------------------------------------------------------------------------------

@query("model_registry", sql("SELECT 'v2' AS version, count(*) AS rows, count(*) AS agreeing, count(*) AS named FROM feats"))
def model_registry(t: Tables) -> DataFrame:
    """Two versions are saved; the latest is found by its date, loaded and predicts what the trained one does."""
    folder = jobs.work_folder(t.spark)
    feats = scoring.formula_predictions(scoring.features(t.claims, t.lines, t.diagnoses)).select("claim_id", *scoring.FEATURES, F.col("prediction").cast("string").alias("target"))
    feats = written(feats, "features")  # for the training and for both predictions
    model, _ = scoring.train(feats, scoring.FEATURES, "target", trees=5, depth=4)
    for version, day in (("v2", 2), ("v1", 1)):
        registry.save(model, t.spark, folder, version, datetime(2024, 1, day), scoring.FEATURES, {"accuracy": 0.5})
    again, row = registry.load(t.spark, folder)
    both = scoring.predict(model, feats).select("claim_id", F.col("prediction").alias("a")).join(scoring.predict_filters(again, feats).select("claim_id", "prediction", "predicted_filter"), "claim_id")
    named = F.col("predicted_filter") == F.concat(F.lit("ML_FILTER_"), F.col("prediction").cast("string"))
    return both.agg(F.lit(row["version"]).alias("version"), F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("prediction")).alias("agreeing"), F.count_if(named).alias("named"))


_GUESS = " guessed AS (SELECT (f_age + f_lines) % 4 AS label, prediction FROM gated)"
_PER_CLASS = "SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS hits FROM guessed GROUP BY 1"
query("classification_report", sql(f"""SELECT class, support, hits::DOUBLE / nullif(predicted, 0) AS "precision", hits::DOUBLE / nullif(support, 0) AS recall FROM (
  SELECT coalesce(class, guess) AS class, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM ({_PER_CLASS}) FULL JOIN (SELECT prediction AS guess, count(*) AS predicted FROM guessed GROUP BY 1) ON class = guess)""", _GUESS))(
    lambda t: scoring.class_report(_guessed(t), "label", "prediction"))
query("classification_summary", sql(f"""SELECT sum(hits)::DOUBLE / sum(support) AS accuracy, round(sum(support * coalesce(2.0::DOUBLE * p * r / nullif(p + r, 0), 0)) / sum(support), 6) AS weighted_f1 FROM (
  SELECT support, hits, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS p, hits::DOUBLE / support AS r FROM ({_PER_CLASS}) LEFT JOIN (SELECT prediction AS guess, count(*) AS predicted FROM guessed GROUP BY 1) ON class = guess)""", _GUESS))(
    lambda t: scoring.summary(scoring.class_report(_guessed(t), "label", "prediction")).withColumn("weighted_f1", F.round("weighted_f1", 6)))


def _guessed(t: Tables) -> DataFrame:
    x = scoring.formula_predictions(scoring.features(t.claims, t.lines, t.diagnoses))
    return x.select(((F.col("f_age") + F.col("f_lines")) % 4).cast("int").alias("label"), "prediction")


# -- metrics, exports, reports ------------------------------------------------------------------------

_SIZES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "24h": 1440}
_VALUES = ", ".join(f"('{w}', {m})" for w, m in _SIZES.items())
_KINDS = "type IN ('counter', 'gauge')"
_LASTV = "arg_max(value, (ts, point_id))"
_WINDOWS = f"""SELECT metric, type, w AS "window", count(*) AS n, (CASE WHEN {_KINDS} THEN {_LASTV} ELSE sum(value) END)::DECIMAL(18,2) AS sum_value, (CASE WHEN {_KINDS} THEN {_LASTV} ELSE min(value) END)::DECIMAL(18,2) AS min_value,
  (CASE WHEN {_KINDS} THEN {_LASTV} ELSE max(value) END)::DECIMAL(18,2) AS max_value, CASE WHEN {_KINDS} THEN {_LASTV}::DOUBLE ELSE sum(value)::DOUBLE / count(value) END AS avg_value
  FROM (SELECT *, name || '{{bucket=' || bucket || '}}' AS metric FROM metric_points) JOIN (VALUES {_VALUES}) v(w, m) ON ts >= {AS_OF_EVENTS} - INTERVAL 1 DAY - to_minutes(m) GROUP BY 1, 2, 3"""
_EXPORT_AT = datetime(P.as_of_events.year, P.as_of_events.month, P.as_of_events.day - 1)


@query("metrics_export", sql(_WINDOWS))
def metrics_export(t: Tables) -> DataFrame:
    """Five trailing windows as lines of JSON, appended and read again."""
    path = f"{jobs.work_folder(t.spark)}/metrics"
    found = monitoring.metric_windows(t.metric_points, _EXPORT_AT, _SIZES)
    lines = sinks.metrics_snapshot(found, _EXPORT_AT)
    sinks.append_lines(lines, path)
    return t.spark.read.schema(lines.schema).json(path).select("window", F.inline("metrics")).select(*found.columns)


@query("dashboard_export", sql("SELECT 'stages' AS panel, stage AS name, count(*) AS n FROM failed_claims GROUP BY 2 UNION ALL SELECT 'categories', category, count(*) FROM error_metrics GROUP BY 2"))
def dashboard_export(t: Tables) -> DataFrame:
    path = f"{jobs.work_folder(t.spark)}/dashboard"
    count = lambda df, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    sinks.append_lines(sinks.dashboard({"stages": count(t.failed_claims, "stage"), "categories": count(t.error_metrics, "category")}), path)
    back = t.spark.read.schema("panel string, body string").json(path)
    return back.select("panel", F.from_json("body", "name string, n bigint").alias("b")).select("panel", "b.name", "b.n")


query("metric_state", sql(f"""SELECT name || '{{bucket=' || bucket || '}}' AS metric, CASE WHEN type IN ('counter', 'gauge') THEN type ELSE 'samples' END AS kind, (CASE any_value(type) WHEN 'gauge' THEN {_LASTV} ELSE sum(value) END)::DECIMAL(18,2) AS value, count(*) AS n
  FROM metric_points GROUP BY 1, 2"""))(lambda t: monitoring.metric_state(t.metric_points))
query("operation_errors", sql("SELECT bucket AS operation, count(*) FILTER (name <> 'error') AS timings, sum(CASE WHEN name = 'error' THEN value ELSE 0 END)::DECIMAL(18,2) AS error_count FROM metric_points GROUP BY 1 HAVING count(*) FILTER (name <> 'error') > 0"))(
    lambda t: monitoring.operation_errors(t.metric_points, F.col("labels")["bucket"]))
query("error_rate_windows", sql(f"SELECT w AS \"window\", count(*) / (m * 60.0::DOUBLE) * 60 AS per_minute, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (name = 'error') * 100.0::DOUBLE / count(*) ELSE 0 END, 6) AS error_rate FROM metric_points JOIN (VALUES {_VALUES}) v(w, m) ON ts >= {AS_OF_EVENTS} - INTERVAL 1 DAY - to_minutes(m) GROUP BY w, m"))(
    lambda t: monitoring.rate_windows(t.metric_points, _EXPORT_AT, _SIZES))
query("throughput_report", sql("""SELECT facility_id, count(*) AS total_processed, count(*) FILTER (validation_status = 'VALIDATED') AS successful, count(*) FILTER (validation_status = 'FAILED') AS failed,
  date_sub('second', min(created_date), max(processed_date)) AS duration_seconds, CASE WHEN date_sub('second', min(created_date), max(processed_date)) > 0 THEN count(*) / date_sub('second', min(created_date), max(processed_date))::DOUBLE ELSE 0 END AS throughput FROM claims WHERE processed_date IS NOT NULL GROUP BY 1"""))(
    lambda t: monitoring.throughput(t.claims))


@query("batch_log", sql("SELECT 1::BIGINT AS batch_id, 'all' AS batch_name, 'PENDING' AS status, (SELECT count(*) FROM claims) AS total_claims UNION ALL SELECT 2, 'pending', 'PENDING', (SELECT count(*) FROM claims WHERE status = 'PENDING')"))
def batch_log(t: Tables) -> DataFrame:
    path = f"{jobs.work_folder(t.spark)}/batches"
    for name, df in (("all", t.claims), ("pending", t.claims.where("status = 'PENDING'"))):
        sinks.create_batch(t.spark, path, name, df.count(), P.as_of_claims)
    return t.spark.read.schema(sinks.BATCHES).parquet(path).drop("start_time")


query("rvu_probe", sql("SELECT CASE WHEN count(*) FILTER (cpt_code = '99213') > 0 THEN 'healthy' ELSE 'degraded' END AS status, count(*) AS prices FROM rvu"))(lambda t: t.rvu.agg(F.when(F.count_if(F.col("cpt_code") == "99213") > 0, "healthy").otherwise("degraded").alias("status"), F.count("*").alias("prices")))

_DRAW = lambda salt, below: f"(((range + {salt}) % 2147483646 + 1) * 48271 % 2147483647 % {below})"
query("generated_claims", f"SELECT 'CLM' || lpad(range::VARCHAR, 9, '0') AS claim_id, 'GEN' || lpad({_DRAW(5, 10)}::VARCHAR, 5, '0') AS facility_id, {_DRAW(7, 100)}::INTEGER AS patient_age, DATE '2024-01-01' + {_DRAW(13, 365)}::INTEGER AS service_date, {_DRAW(3, 2500000)} + 1000 AS charge_cents FROM range(10000)")(
    lambda t: generators.claims(t.spark, 10_000))
query("generated_facilities", f"SELECT 'GEN' || lpad(range::VARCHAR, 5, '0') AS facility_id, 'Facility ' || range AS facility_name, {_DRAW(11, 100)} < 90 AS active FROM range(500)")(lambda t: generators.facilities(t.spark, 500))

# -- failed and production rows ---------------------------------------------------------------------------

_TEXT = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_LIST = lambda c: f"'[' || coalesce(array_to_string(list_transform({c}[1:3], lambda x: '\"' || x || '\"'), ','), '') || ']'"
_MASKED = "CASE WHEN length(account) > 4 THEN '********' || right(account, 4) WHEN length(account) > 3 THEN repeat('*', length(account)) ELSE account END"
query("failed_snapshots", sql(f"""SELECT d.claim_id AS original_claim_id, '{{"claim_id":' || {_TEXT('d.claim_id')} || ',"facility_id":' || {_TEXT('d.facility_id')} || ',"patient_account_number":' || {_TEXT(_MASKED)} || ',"service_date":' || {_TEXT('d.service_date::VARCHAR')}
  || ',"total_charge":' || {_TEXT('d.total_charge::VARCHAR')} || ',"payer_name":' || {_TEXT('y.payer_name')} || ',"diagnoses_codes":' || {_LIST('g.codes')} || ',"procedure_codes":' || {_LIST('l.codes')} || ',"original_staging_status":' || {_TEXT('d.status')}
  || ',"final_pipeline_status":' || {_TEXT('d.final_status')} || ',"ml_filters_attempted":' || {_TEXT('d.assigned_filter')} || ',"ml_confidence":' || {_TEXT('round(d.confidence, 3)::DECIMAL(4,3)::VARCHAR')} || '}}' AS snapshot, {{C}} AS failed_at
  FROM disposed d LEFT JOIN financial_classes k ON k.financial_class_id = d.financial_class_id LEFT JOIN payers y ON y.payer_id = k.payer_id LEFT JOIN (SELECT claim_id, list(icd_code ORDER BY sequence) AS codes FROM diagnoses GROUP BY 1) g ON g.claim_id = d.claim_id
  LEFT JOIN (SELECT claim_id, list(cpt_code ORDER BY line_number) AS codes FROM lines GROUP BY 1) l ON l.claim_id = d.claim_id WHERE NOT is_valid"""))(
    lambda t: failed.snapshots(disposed(t), t.lines, t.diagnoses, _payers(t), P.as_of_claims).withColumn("snapshot", fn.unwrapped("snapshot")))


def _payers(t: Tables) -> DataFrame:
    return t.financial_classes.join(t.payers, "payer_id", "left").select("financial_class_id", "payer_name")


query("assignment_info", sql("SELECT c.claim_id, f.facility_name, d.department_name, k.description AS financial_class FROM claims c LEFT JOIN facilities f ON f.facility_id = c.facility_id LEFT JOIN departments d ON d.department_id = c.department_id LEFT JOIN financial_classes k ON k.financial_class_id = c.financial_class_id"))(
    lambda t: validation.validate_assignments(t, t.claims).select("claim_id", F.from_json("info", "facility_name string, department_name string, financial_class string").alias("i")).select("claim_id", "i.*"))
query("validation_warnings", sql("SELECT claim_id, len(w) AS warnings FROM (SELECT claim_id, CASE WHEN end_date < service_date THEN ['CORE_DATE_03'] ELSE [] END AS w FROM claims)"))(lambda t: validation.validate(t, t.claims, P).select("claim_id", F.size("warnings").cast("bigint").alias("warnings")))
query("production_rows_wide", sql(f"""SELECT d.claim_id, d.facility_id, CASE WHEN length(patient_id::VARCHAR) > 3 THEN repeat('*', length(patient_id::VARCHAR)) ELSE patient_id::VARCHAR END AS patient_id, patient_age, {_MASKED} AS patient_account_number, service_date, end_date, total_charge AS total_charge_amount,
  department_id, d.financial_class_id, y.payer_name, 'COMPLETED_EXPORTED_TO_PROD' AS processing_status, {{C}} AS processed_date, 'VALIDATED_RULES_PASSED' AS validation_status, assigned_filter, confidence, reimbursement, priced_lines, created_date, 'system' AS created_by
  FROM disposed d JOIN paid USING (claim_id) LEFT JOIN financial_classes k ON k.financial_class_id = d.financial_class_id LEFT JOIN payers y ON y.payer_id = k.payer_id WHERE is_valid"""))(lambda t: failed.production_wide(disposed(t), t.lines, t.rvu, _payers(t), P))


@query("bulk_status_by_ids", sql("SELECT claim_id, CASE WHEN claim_key % 9 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN claim_key % 18 = 0 THEN 'E1' ELSE 'old' END AS errors FROM claims"))
def bulk_status_by_ids(t: Tables) -> DataFrame:
    """Identifiers come as separated lists; new errors replace old ones where there are any."""
    own = t.claims.where("claim_key % 9 = 0").select("claim_id", "claim_key")
    lists = own.groupBy(F.floor(F.col("claim_key") / 1000)).agg(F.array_join(F.collect_list("claim_id"), ", ").alias("ids"))
    ids = readers.split_ids(lists, "ids")
    errors = ids.join(own, "claim_id").select("claim_id", F.when(F.col("claim_key") % 2 == 0, "E1").alias("new_errors"))
    return dml.set_status(t.claims.select("claim_id", "status", F.lit("old").alias("errors")), ids, "claim_id", "FAILED", P.as_of_claims, errors).drop("changed")


# -- keyed state in streams -------------------------------------------------------------------------------

query("stream_breaker", recursive("SELECT name AS key, point_id, seen AS state FROM walk WHERE rn > 0", _BREAKER))(lambda t: jobs.breaker_stream(t))
query("stream_latest", sql("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1"))(lambda t: jobs.counted(t))

_SIGNALS = """ points AS MATERIALIZED (SELECT name, point_id, ts, epoch_us(ts) AS t, value, value > 12 AS failed, row_number() OVER (PARTITION BY name ORDER BY ts, point_id) AS rn FROM metric_points),
onward AS MATERIALIZED (SELECT name, rn, min(rn) OVER (PARTITION BY name ORDER BY t RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM points),
sent(name, rn) AS (SELECT name, min(rn) FROM points GROUP BY 1 UNION ALL SELECT s.name, f.after FROM sent s JOIN onward f ON f.name = s.name AND f.rn = s.rn WHERE f.after IS NOT NULL)"""
query("stream_signals", recursive("""SELECT name AS key, point_id, (name, rn) IN (SELECT (name, rn) FROM sent) AS sent, round(list_reduce(v, lambda acc, x: acc * 0.9::DOUBLE + x * 0.1::DOUBLE), 6) AS average, streak
FROM (SELECT name, rn, point_id, list(value::DOUBLE) OVER (PARTITION BY name ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS v,
  (sum(failed::INTEGER) OVER (PARTITION BY name, run ORDER BY ts, point_id))::BIGINT AS streak FROM (SELECT *, sum((NOT failed)::INTEGER) OVER (PARTITION BY name ORDER BY ts, point_id) AS run FROM points))""", _SIGNALS))(lambda t: signals.signal_stream(t))
