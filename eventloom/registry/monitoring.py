"""Anomaly and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.timeops import ts_lit
from eventloom.operators import alerts, anomaly, moments, rollup, sketches
from eventloom.registry import ANOMALY_AS_OF, AS_OF, MONTH_START, ev_sql, query, r6
from eventloom.session import work_folder
from eventloom.sources.canonical import alert_events, alert_rules, events
from eventloom.sources.store import write_by_day


def minutes(spark, folder, start=None, end=None):
    return rollup.minute_counts(events(spark, folder), start, end)


def day_before(spark, folder):
    return minutes(spark, folder, "2024-01-04 14:00:00", ANOMALY_AS_OF)


def hour_before(ev):
    return rollup.minute_counts(ev, "2024-01-05 13:00:00", ANOMALY_AS_OF)


def rounded(df, *names):
    for name in names:
        df = df.withColumn(name, r6(name))
    return df


WINDOWS_SQL = """w AS (SELECT source, "timestamp" >= TIMESTAMP '2024-01-05 13:55:00' AS cur,
  time_bucket(INTERVAL 5 MINUTE, "timestamp") AS win, count(*) AS total,
  count(*) FILTER (severity IN ('error','fatal')) AS errors FROM ev
  WHERE "timestamp" >= TIMESTAMP '2024-01-04 14:00:00' AND "timestamp" < TIMESTAMP '2024-01-05 14:00:00' GROUP BY ALL),
base AS (SELECT source,
  coalesce(avg(errors / total) FILTER (NOT cur), 0) AS error_rate_mean,
  coalesce(stddev_samp(errors / total) FILTER (NOT cur), 0) AS error_rate_stddev,
  coalesce(avg(total) FILTER (NOT cur), 0) AS event_count_mean,
  coalesce(stddev_samp(total) FILTER (NOT cur), 0) AS event_count_stddev,
  count(*) FILTER (NOT cur) AS windows,
  CAST(coalesce(sum(total) FILTER (cur), 0) AS BIGINT) AS current_total,
  CAST(coalesce(sum(errors) FILTER (cur), 0) AS BIGINT) AS current_errors,
  CASE WHEN current_total > 0 THEN current_errors / current_total ELSE 0 END AS current_error_rate
  FROM w GROUP BY 1),
z AS (SELECT source, 'error_rate' AS metric, CAST(current_error_rate AS DOUBLE) AS value, error_rate_mean AS mean, error_rate_stddev AS stddev,
    (current_error_rate - error_rate_mean) / nullif(error_rate_stddev, 0) AS z_score, z_score AS height FROM base
  UNION ALL SELECT source, 'event_count', CAST(current_total AS DOUBLE), event_count_mean, event_count_stddev,
    (current_total - event_count_mean) / nullif(event_count_stddev, 0) AS z2, abs(z2) FROM base)"""
Z_OUT = """source, metric, round(value, 6) AS value, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(z_score, 6) AS z_score"""


@query(
    "e1_active_sources",
    ev_sql(f"SELECT DISTINCT source FROM ev WHERE \"timestamp\" >= TIMESTAMP '{MONTH_START}' AND \"timestamp\" < TIMESTAMP '{AS_OF}'"),
)
def e1(spark, folder):
    return anomaly.sources_between(minutes(spark, folder, MONTH_START, AS_OF), MONTH_START, AS_OF)


def _baselines(spark, folder):
    return anomaly.source_baselines(day_before(spark, folder), as_of=ANOMALY_AS_OF)


@query(
    "e2_error_rate_baseline",
    ev_sql("SELECT source, round(error_rate_mean, 6) AS mean, round(error_rate_stddev, 6) AS stddev FROM base", WINDOWS_SQL),
)
def e2(spark, folder):
    return _baselines(spark, folder).select(
        "source", r6("error_rate_mean").alias("mean"), r6("error_rate_stddev").alias("stddev")
    )


@query(
    "e3_volume_baseline",
    ev_sql("SELECT source, windows, round(event_count_mean, 6) AS mean, round(event_count_stddev, 6) AS stddev FROM base", WINDOWS_SQL),
)
def e3(spark, folder):
    return _baselines(spark, folder).select(
        "source", "windows",
        r6("event_count_mean").alias("mean"), r6("event_count_stddev").alias("stddev"),
    )


def stored_moments(spark, folder):
    path = work_folder(spark, "moments")
    write_by_day(moments.hour_moments(minutes(spark, folder)), path, "bucket", sort=("source", "bucket"))
    return spark.read.parquet(path)


@query(
    "e2_stored_baselines",
    ev_sql(
        """SELECT source, round(error_rate_mean, 6) AS rate_mean, round(error_rate_stddev, 6) AS rate_stddev,
  round(event_count_mean, 6) AS mean, round(event_count_stddev, 6) AS stddev, windows, current_total, current_errors,
  round(current_error_rate, 6) AS current_error_rate FROM base""",
        WINDOWS_SQL,
    ),
)
def e2_stored(spark, folder):
    """The baselines of e2 to e4 merged from stored hours; only the ends of the day are counted."""
    base = moments.stored_baselines(stored_moments(spark, folder), minutes(spark, folder), as_of=ANOMALY_AS_OF)
    return base.select(
        "source", r6("error_rate_mean").alias("rate_mean"), r6("error_rate_stddev").alias("rate_stddev"),
        r6("event_count_mean").alias("mean"), r6("event_count_stddev").alias("stddev"), "windows", "current_total",
        "current_errors", r6("current_error_rate").alias("current_error_rate"),
    )


@query(
    "l26_stored_seasons",
    ev_sql(
        """SELECT source, isodow(win) - 1 AS weekday, hour(win) AS hour, round(avg(total), 6) AS mean,
  round(coalesce(stddev_samp(total), 0), 6) AS stddev, count(*) AS samples, round(avg(total) + 2 * coalesce(stddev_samp(total), 0), 6) AS threshold
FROM (SELECT source, time_bucket(INTERVAL 5 MINUTE, "timestamp") AS win, count(*) AS total FROM ev GROUP BY ALL) GROUP BY ALL"""
    ),
)
def l26_stored(spark, folder):
    """Seasonal thresholds merged from the same stored hours."""
    return rounded(moments.stored_seasons(stored_moments(spark, folder), 2), "mean", "stddev", "threshold")


@query(
    "l10_sketch_outliers",
    ev_sql(
        """SELECT source, win AS "window", round(p99, 6) AS p99, round(mean, 6) AS mean, round(stddev, 6) AS stddev
FROM (SELECT *, avg(p99) OVER (PARTITION BY source) AS mean, stddev_samp(p99) OVER (PARTITION BY source) AS stddev FROM (
  SELECT source, date_trunc('hour', "timestamp") AS win,
    quantile_disc(CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE), 0.99) AS p99 FROM ev GROUP BY ALL))
WHERE p99 > mean + 3 * stddev"""
    ),
)
def l10_sketches(spark, folder):
    """Hours with an unusual p99, from sketches per minute."""
    path = work_folder(spark, "sketches")
    write_by_day(sketches.latency_sketches(events(spark, folder)), path, "bucket", sort=("source", "bucket"))
    return rounded(sketches.latency_outliers(spark.read.parquet(path)), "p99", "mean", "stddev")


@query(
    "e3_volume_baseline_zero_filled",
    ev_sql(
        """SELECT source, round(sum(n) / 287, 6) AS mean,
  round(sqrt((sum(n * n) - sum(n) * sum(n) / 287) / 286), 6) AS stddev
FROM (SELECT source, CASE WHEN cur THEN 0.0::DOUBLE ELSE total END AS n FROM w) GROUP BY 1""",
        WINDOWS_SQL,
    ),
)
def e3_zero(spark, folder):
    base = anomaly.source_baselines(day_before(spark, folder), as_of=ANOMALY_AS_OF, zero_fill=True)
    return base.select(
        "source", r6("event_count_mean").alias("mean"), r6("event_count_stddev").alias("stddev")
    )


@query(
    "e4_current_values",
    ev_sql("SELECT source, current_total, current_errors, round(current_error_rate, 6) AS current_error_rate FROM base", WINDOWS_SQL),
)
def e4(spark, folder):
    return _baselines(spark, folder).select(
        "source", "current_total", "current_errors",
        r6("current_error_rate").alias("current_error_rate"),
    )


@query(
    "e5_anomalies",
    ev_sql(f"SELECT {Z_OUT} FROM z WHERE height > 3", WINDOWS_SQL),
)
def e5(spark, folder):
    found = anomaly.detect_anomalies(day_before(spark, folder), as_of=ANOMALY_AS_OF)
    return rounded(found, "value", "mean", "stddev", "z_score")


@query(
    "e5_all_scores",
    ev_sql(f"SELECT {Z_OUT}, coalesce(height > 3, false) AS anomalous FROM z", WINDOWS_SQL),
)
def e5_all(spark, folder):
    return rounded(anomaly.z_scores(_baselines(spark, folder)), "value", "mean", "stddev", "z_score")


@query(
    "e6_anomaly_facts",
    ev_sql(
        """SELECT source, metric, printf('- Source: %s\n- Metric: %s\n- Current value: %.4f\n- 24h baseline mean: %.4f\n- 24h baseline std dev: %.4f\n- Z-score: %.2f (threshold: 3.0)',
  source, metric, value, mean, stddev, z_score) AS facts FROM z WHERE height > 3""",
        WINDOWS_SQL,
    ),
)
def e6(spark, folder):
    found = anomaly.detect_anomalies(day_before(spark, folder), as_of=ANOMALY_AS_OF)
    return anomaly.describe(found).select("source", "metric", "facts")


METRIC_SQL = """mc AS (SELECT date_trunc('minute', "timestamp") AS bucket, source, severity FROM ev),
measured AS (SELECT r.rule_id, r.name, r.metric, r.operator, r.threshold, r."window", r.source, r.severity, r.enabled, CASE r.metric WHEN 'event_count' THEN count(m.bucket)
    WHEN 'error_count' THEN count(m.bucket) FILTER (m.severity IN ('error','fatal'))
    WHEN 'error_rate' THEN coalesce(count(m.bucket) FILTER (m.severity IN ('error','fatal')) / nullif(count(m.bucket), 0), 0)
    END::DOUBLE AS value,
  CASE WHEN r.metric NOT IN ('error_rate', 'event_count', 'error_count') THEN 'unknown metric: ' || r.metric END AS error
  FROM rules r LEFT JOIN mc m ON (r.source = '' OR r.source = m.source)
    AND m.bucket >= TIMESTAMP '2024-01-05 14:00:00' - CASE r."window" WHEN '1m' THEN INTERVAL 1 MINUTE
      WHEN '15m' THEN INTERVAL 15 MINUTE WHEN '1h' THEN INTERVAL 1 HOUR ELSE INTERVAL 5 MINUTE END
    AND m.bucket < TIMESTAMP '2024-01-05 14:00:00'
  GROUP BY r.rule_id, r.name, r.metric, r.operator, r.threshold, r."window", r.source, r.severity, r.channels,
    r.enabled, r.cooldown_seconds),
fired AS (SELECT m.* FROM measured m LEFT JOIN (SELECT rule_id, max(fired_at) AS last_fired FROM alerts
      WHERE fired_at < TIMESTAMP '2024-01-05 14:00:00' GROUP BY 1) l USING (rule_id)
  WHERE enabled AND (last_fired IS NULL OR last_fired <= TIMESTAMP '2024-01-05 14:00:00' - INTERVAL 7200 SECOND)
    AND CASE operator WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold
      WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold ELSE false END)"""


@query(
    "e7_rule_metrics",
    ev_sql('SELECT rule_id, metric, "window", source, round(value, 6) AS value, error FROM measured', "rules", "alerts", METRIC_SQL),
)
def e7(spark, folder):
    ev = events(spark, folder)
    found = alerts.rule_metrics(alert_rules(ev), hour_before(ev), as_of=ANOMALY_AS_OF)
    return found.select("rule_id", "metric", "window", "source", r6("value").alias("value"), "error")


@query(
    "e8_comparison",
    ev_sql(
        """SELECT op AS operator, count(*) FILTER (hit) AS hits, count(*) AS n FROM (
SELECT op, CASE op WHEN '>' THEN value > 50 WHEN '>=' THEN value >= 50 WHEN '<' THEN value < 50
  WHEN '<=' THEN value <= 50 WHEN '==' THEN value = 50 ELSE false END AS hit
FROM ev, (VALUES ('>'), ('>='), ('<'), ('<='), ('=='), ('!=')) o(op)) GROUP BY 1"""
    ),
)
def e8(spark, folder):
    operators = F.array(*(F.lit(o) for o in (">", ">=", "<", "<=", "==", "!=")))
    rows = events(spark, folder).select("value", F.explode(operators).alias("operator"))
    hit = alerts.triggered(F.col("value"), F.col("operator"), F.lit(50.0))
    return rows.groupBy("operator").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


@query(
    "e9_rule_windows",
    ev_sql(
        """SELECT rule_id, CAST(CASE "window" WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 ELSE 300 END AS INTEGER) AS seconds
FROM rules""",
        "rules",
    ),
)
def e9(spark, folder):
    from eventloom.functions.timeops import ALERT_WINDOWS, alert_window

    name = alert_window(F.col("window"))
    seconds = F.coalesce(*(F.when(name == n, F.lit(s)) for n, s in ALERT_WINDOWS.items()))
    return alert_rules(events(spark, folder)).select("rule_id", seconds.alias("seconds"))


def _fired(spark, folder):
    ev = events(spark, folder)
    rules = alert_rules(ev).withColumn("cooldown_seconds", F.lit(7200))
    past = alert_events(ev).where(F.col("fired_at") < ts_lit(ANOMALY_AS_OF))
    return alerts.evaluate_rules(rules, hour_before(ev), past, as_of=ANOMALY_AS_OF)


@query(
    "e10_evaluate_rules",
    ev_sql(
        """SELECT sha256(rule_id || '|2024-01-05 14:00:00') AS alert_event_id, rule_id, 'firing' AS status,
  TIMESTAMP '2024-01-05 14:00:00' AS fired_at, round(value, 6) AS value, metric AS context_metric, "window" AS context_window FROM fired""",
        "rules", "alerts", METRIC_SQL,
    ),
)
def e10(spark, folder):
    return _fired(spark, folder).select(
        "alert_event_id", "rule_id", "status", "fired_at", r6("value").alias("value"),
        F.get_json_object("context", "$.metric").alias("context_metric"),
        F.get_json_object("context", "$.window").alias("context_window"),
    )


@query("e11_last_firing", ev_sql("SELECT rule_id, max(fired_at) AS last_fired FROM alerts GROUP BY 1", "alerts"))
def e11(spark, folder):
    return alerts.last_firing(alert_events(events(spark, folder)))


@query(
    "e12_alert_history",
    ev_sql(
        """SELECT alert_event_id, rule_id, name AS rule_name, fired_at FROM alerts JOIN rules USING (rule_id)
ORDER BY fired_at DESC, alert_event_id DESC LIMIT 50""",
        "rules", "alerts",
    ),
)
def e12(spark, folder):
    ev = events(spark, folder)
    found = alerts.alert_history(alert_events(ev), alert_rules(ev))
    return found.select("alert_event_id", "rule_id", "rule_name", "fired_at")


CHANGES_SQL = """changes AS (SELECT 'rule-' || user_id AS rule_id, "timestamp" AS changed_at, seq,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_type <> 'click' THEN event_type || seq ELSE '' END AS name,
  CASE WHEN event_type = 'purchase' THEN 'critical' END AS severity,
  CASE WHEN event_type = 'view' THEN seq % 2 = 0 END AS enabled,
  CASE WHEN event_type = 'click' THEN CAST(seq % 900 AS INTEGER) END AS cooldown_seconds,
  CASE WHEN event_type = 'purchase' THEN metadata END AS channels FROM ev)"""


def _changes(spark, folder):
    kind = F.col("event_type")
    return events(spark, folder).select(
        F.concat(F.lit("rule-"), F.col("user_id").cast("string")).alias("rule_id"),
        F.col("timestamp").alias("changed_at"),
        "seq",
        F.when(kind == "signup", "create").when(kind == "error", "delete").otherwise("update").alias("op"),
        F.when(kind != "click", F.concat(kind, F.col("seq").cast("string"))).otherwise("").alias("name"),
        F.when(kind == "purchase", "critical").alias("severity"),
        F.when(kind == "view", F.col("seq") % 2 == 0).alias("enabled"),
        F.when(kind == "click", (F.col("seq") % 900).cast("int")).alias("cooldown_seconds"),
        F.when(kind == "purchase", F.col("metadata")).alias("channels"),
    )


@query(
    "e13_current_rules",
    ev_sql(
        """SELECT rule_id, arg_max(name, (changed_at, seq)) FILTER (name <> '') AS name,
  coalesce(arg_max(severity, (changed_at, seq)) FILTER (severity IS NOT NULL), 'warning') AS severity,
  coalesce(arg_max(enabled, (changed_at, seq)) FILTER (enabled IS NOT NULL), true) AS enabled,
  coalesce(arg_max(cooldown_seconds, (changed_at, seq)) FILTER (cooldown_seconds IS NOT NULL), 300) AS cooldown_seconds,
  coalesce(arg_max(channels, (changed_at, seq)) FILTER (channels IS NOT NULL), '[]') AS channels,
  any_value(born) AS created_at, max(changed_at) AS updated_at
FROM (SELECT *, max(changed_at) FILTER (op = 'create') OVER (PARTITION BY rule_id) AS born FROM changes)
WHERE changed_at >= born GROUP BY 1 HAVING arg_max(op, (changed_at, seq)) <> 'delete'""",
        CHANGES_SQL,
    ),
)
def e13(spark, folder):
    return alerts.current_rules(_changes(spark, folder))


@query(
    "e14_notifications",
    ev_sql(
        """SELECT sha256(rule_id || '|2024-01-05 14:00:00') AS alert_event_id, 'https://hooks.example/' || source AS url,
  name AS alert, severity, rule_id FROM fired""",
        "rules", "alerts", METRIC_SQL,
    ),
)
def e14(spark, folder):
    sent = alerts.notifications(_fired(spark, folder))
    return sent.select(
        "alert_event_id", "url",
        *(F.get_json_object("payload", f"$.{n}").alias(n) for n in ("alert", "severity", "rule_id")),
    )


@query(
    "e15_mark_notified",
    ev_sql(
        """SELECT alert_event_id, value < 60 AS notified FROM alerts""",
        "alerts",
    ),
)
def e15(spark, folder):
    fired = alert_events(events(spark, folder))
    done = fired.where(F.col("value") < 60).select("alert_event_id")
    return alerts.mark_notified(fired, done.unionAll(done)).select("alert_event_id", "notified")


@query(
    "l8_iqr_outliers",
    ev_sql(
        """SELECT source, win AS "window", total, q1, q3 FROM (
  SELECT *, quantile_cont(total, 0.25) OVER (PARTITION BY source) AS q1, quantile_cont(total, 0.75) OVER (PARTITION BY source) AS q3
  FROM (SELECT source, date_trunc('hour', "timestamp") AS win, count(*) AS total FROM ev GROUP BY ALL))
WHERE total < q1 - 1.5 * (q3 - q1) OR total > q3 + 1.5 * (q3 - q1)"""
    ),
)
def l8(spark, folder):
    return anomaly.iqr_outliers(minutes(spark, folder))


@query(
    "l9_rolling_outliers",
    ev_sql(
        """SELECT source, bucket, total, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM (
  SELECT *, avg(total) OVER win AS mean, stddev_samp(total) OVER win AS stddev
  FROM (SELECT source, bucket, CAST(sum(count) AS BIGINT) AS total FROM counts GROUP BY ALL)
  WINDOW win AS (PARTITION BY source ORDER BY bucket RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND INTERVAL 1 SECOND PRECEDING))
WHERE stddev > 0 AND total > mean + 3 * stddev""",
        "counts",
    ),
)
def l9(spark, folder):
    return rounded(anomaly.rolling_outliers(minutes(spark, folder)), "mean", "stddev")


@query(
    "l10_latency_outliers",
    ev_sql(
        """SELECT source, win AS "window", round(p99, 6) AS p99, round(mean, 6) AS mean, round(stddev, 6) AS stddev
FROM (SELECT *, avg(p99) OVER (PARTITION BY source) AS mean, stddev_samp(p99) OVER (PARTITION BY source) AS stddev FROM (
  SELECT source, date_trunc('hour', "timestamp") AS win,
    quantile_cont(CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE), 0.99) AS p99 FROM ev GROUP BY ALL))
WHERE p99 > mean + 3 * stddev"""
    ),
)
def l10(spark, folder):
    return rounded(anomaly.latency_outliers(events(spark, folder)), "p99", "mean", "stddev")


@query(
    "l10_latency_rules",
    ev_sql(
        """SELECT r.rule_id, round(quantile_cont(ms, 0.99), 6) AS value
FROM (SELECT * REPLACE ('latency_p99' AS metric) FROM rules) r
LEFT JOIN (SELECT source, "timestamp", CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) AS ms FROM ev) e
  ON (r.source = '' OR r.source = e.source) AND e."timestamp" < TIMESTAMP '2024-01-05 14:00:00'
  AND e."timestamp" >= TIMESTAMP '2024-01-05 14:00:00' - CASE r."window" WHEN '1m' THEN INTERVAL 1 MINUTE
      WHEN '15m' THEN INTERVAL 15 MINUTE WHEN '1h' THEN INTERVAL 1 HOUR ELSE INTERVAL 5 MINUTE END
GROUP BY 1""",
        "rules",
    ),
)
def l10_rules(spark, folder):
    ev = events(spark, folder)
    rules = alert_rules(ev).withColumn("metric", F.lit("latency_p99"))
    found = alerts.latency_metrics(rules, ev, as_of=ANOMALY_AS_OF)
    return found.select("rule_id", r6("value").alias("value"))


@query(
    "l11_breach_spans",
    ev_sql(
        """SELECT source, CAST(span AS BIGINT) AS span, min(win) AS fired_at, max(win) + INTERVAL 1 HOUR AS resolved_at, CAST(sum(errors) AS BIGINT) AS errors
FROM (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY win) AS span FROM (
  SELECT *, CASE WHEN lag(win) OVER (PARTITION BY source ORDER BY win) + INTERVAL 1 HOUR >= win THEN 0 ELSE 1 END AS st FROM (
    SELECT source, date_trunc('hour', "timestamp") AS win, count(*) AS errors FROM ev
    WHERE severity IN ('error','fatal') GROUP BY ALL HAVING count(*) >= 1))) GROUP BY source, span"""
    ),
)
def l11(spark, folder):
    return alerts.breach_spans(minutes(spark, folder), threshold=1)


@query(
    "l12_alert_groups",
    ev_sql(
        """SELECT rule_id, CAST(g AS BIGINT) AS alert_group, count(*) AS alerts, min(fired_at) AS first_fired, max(fired_at) AS last_fired FROM (
  SELECT *, sum(st) OVER (PARTITION BY rule_id ORDER BY fired_at, alert_event_id) AS g FROM (
    SELECT *, CASE WHEN epoch_us(fired_at) // 1000000 - epoch_us(lag(fired_at) OVER (PARTITION BY rule_id ORDER BY fired_at, alert_event_id)) // 1000000 <= 43200
      THEN 0 ELSE 1 END AS st FROM alerts)) GROUP BY rule_id, g""",
        "alerts",
    ),
)
def l12(spark, folder):
    return alerts.group_alerts(alert_events(events(spark, folder)), gap=43200)


SEASON_SQL = """hv AS (SELECT source, date_trunc('hour', "timestamp") AS bucket, count(*) AS total FROM ev GROUP BY ALL),
season AS (SELECT source, CAST(isodow(bucket) - 1 AS INTEGER) AS weekday, CAST(hour(bucket) AS INTEGER) AS hour, avg(total) AS mean,
  coalesce(stddev_samp(total), 0) AS stddev, count(*) AS samples, mean + 1.5 * stddev AS threshold FROM hv GROUP BY ALL)"""


@query(
    "l26_seasonal_thresholds",
    ev_sql(
        """SELECT source, weekday, hour, round(mean, 6) AS mean, round(stddev, 6) AS stddev, samples, round(threshold, 6) AS threshold FROM season""",
        SEASON_SQL,
    ),
)
def l26(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    return rounded(anomaly.seasonal_thresholds(hours, sigmas=1.5), "mean", "stddev", "threshold")


@query(
    "l26_above_season",
    ev_sql(
        """SELECT source, bucket, total, round(threshold, 6) AS threshold FROM hv
JOIN season USING (source) WHERE weekday = isodow(bucket) - 1 AND hour = hour(bucket) AND total > threshold""",
        SEASON_SQL,
    ),
)
def l26_above(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    return rounded(
        anomaly.above_season(hours, anomaly.seasonal_thresholds(hours, sigmas=1.5)), "threshold"
    )


@query(
    "l29_user_velocity",
    ev_sql(
        """SELECT user_id, at_second, recent, round(mean, 6) AS mean, round(sd, 6) AS stddev, round((recent - mean) / sd, 6) AS z_score
FROM (SELECT *, avg(recent) OVER (PARTITION BY user_id) AS mean, stddev_samp(recent) OVER (PARTITION BY user_id) AS sd FROM (
  SELECT user_id, at_second, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY at_second RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
  FROM (SELECT user_id, epoch_us("timestamp") // 1000000 AS at_second, count(*) AS n FROM ev GROUP BY ALL)))
WHERE sd > 0 AND (recent - mean) / sd > 3"""
    ),
)
def l29(spark, folder):
    found = anomaly.user_velocity(events(spark, folder), window=7200)
    return rounded(found, "mean", "stddev", "z_score")


@query(
    "l31_growth",
    ev_sql(
        """SELECT source, round(s, 6) AS slope_per_hour, round(i + s * x, 6) AS level,
  CASE WHEN s > 0 THEN round(greatest((1000 - (i + s * x)) / s, 0), 2) END AS hours_to_limit
FROM (SELECT source, regr_slope(value, x) AS s, regr_intercept(value, x) AS i, max(x) AS x
  FROM (SELECT source, value, (epoch_us("timestamp") // 1000000 - 1704067200) / 3600.0::DOUBLE AS x FROM ev) GROUP BY 1)"""
    ),
)
def l31(spark, folder):
    found = anomaly.growth(events(spark, folder), limit=1000.0)
    return rounded(found, "slope_per_hour", "level").withColumn(
        "hours_to_limit", F.round("hours_to_limit", 2)
    )


@query(
    "l34_preceding_deployment",
    ev_sql(
        """SELECT a.source, a."timestamp", d.event_id AS deployment_id, d."timestamp" AS deployed_at
FROM (SELECT source, "timestamp" FROM ev WHERE severity = 'fatal') a
LEFT JOIN LATERAL (SELECT event_id, "timestamp" FROM ev WHERE event_type = 'signup' AND ev.source = a.source
  AND ev."timestamp" <= a."timestamp" AND ev."timestamp" >= a."timestamp" - INTERVAL 6 HOUR
  ORDER BY ev."timestamp" DESC LIMIT 1) d ON true"""
    ),
)
def l34(spark, folder):
    ev = events(spark, folder)
    return anomaly.preceding_deployment(
        ev.where(F.col("severity") == "fatal"), ev.where(F.col("event_type") == "signup")
    )
