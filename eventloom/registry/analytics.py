"""Retrieval, rollup and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas as S
from eventloom.functions.fields import duration_ms
from eventloom.functions.cursors import cursor_column
from eventloom.operators import analytics, distincts, ingest, retrieval, rollup, sketches
from eventloom.registry import AS_OF, MONTH_START, ev_sql, query, r6
from eventloom.session import work_folder
from eventloom.sources.canonical import events, redelivered
from eventloom.sources.store import write_by_day

MONTH = f"\"timestamp\" >= TIMESTAMP '{MONTH_START}' AND \"timestamp\" < TIMESTAMP '{AS_OF}'"
B_MONTH = f"bucket >= TIMESTAMP '{MONTH_START}' AND bucket < TIMESTAMP '{AS_OF}'"
EVENT_SQL = 'event_id, source, event_type, severity, "timestamp", data'
EVENT_OUT = ["event_id", "source", "event_type", "severity", "timestamp", "data"]


def minutes(spark, folder, start=None, end=None):
    return rollup.minute_counts(events(spark, folder), start, end)


def month(spark, folder):
    return minutes(spark, folder, MONTH_START, AS_OF)


@query(
    "b1_event_query",
    ev_sql(
        f"""SELECT {EVENT_SQL} FROM ev WHERE source = 'svc-1' AND event_type = 'error' AND severity = 'error'
AND {MONTH} ORDER BY "timestamp" DESC, event_id DESC LIMIT 200"""
    ),
)
def b1(spark, folder):
    return retrieval.query_events(
        events(spark, folder), as_of=AS_OF, source="svc-1", event_type="error", severity="error",
        start=MONTH_START, end=AS_OF, limit=200,
    ).select(*EVENT_OUT)


@query(
    "b2_last_24h",
    ev_sql(f"""SELECT {EVENT_SQL} FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-30 00:00:00'"""),
)
def b2(spark, folder):
    return retrieval.filter_events(events(spark, folder), as_of=AS_OF).select(*EVENT_OUT)


@query("b3_event_by_id", ev_sql(f"SELECT {EVENT_SQL} FROM ev WHERE event_id = '000000000042'"))
def b3(spark, folder):
    return retrieval.event_by_id(events(spark, folder), "000000000042").select(*EVENT_OUT)


@query(
    "b3_stored_lookup",
    ev_sql('SELECT source, event_type, severity, "timestamp", data FROM ev WHERE seq % 499 = 7'),
)
def b3_stored(spark, folder):
    """All events stored by day under sortable ids, then some looked up by these ids; one received a week late."""
    path = work_folder(spark, "by-id")
    late = F.col("received_at") + F.when(F.col("seq") == 7, F.expr("interval 7 days")).otherwise(F.expr("interval 0 days"))
    made = ingest.sortable_id(late, F.col("event_id"), F.col("data"))
    ev = events(spark, folder).withColumn("event_id", made)
    write_by_day(ev.select(*S.EVENT_COLUMNS, "seq"), path, ids=["event_id"])
    stored = spark.read.parquet(path)
    ids = [r["event_id"] for r in stored.where("seq % 499 = 7").select("event_id").collect()]
    found = retrieval.stored_events_by_id(stored, ids)
    return found.select("source", "event_type", "severity", "timestamp", "data")


@query(
    "b4_keyset_page",
    ev_sql(
        f"""SELECT event_id, "timestamp", row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) AS position,
  (SELECT count(*) FROM page) > 50 AS has_more FROM page QUALIFY position <= 50""",
        """page AS (SELECT * FROM ev WHERE ("timestamp", event_id) < (TIMESTAMP '2024-01-15 00:00:00', '000000005000')
  AND "timestamp" >= TIMESTAMP '2024-01-01' ORDER BY "timestamp" DESC, event_id DESC LIMIT 51)""",
    ),
)
def b4(spark, folder):
    page = retrieval.event_page(
        events(spark, folder), as_of=AS_OF, start=MONTH_START,
        cursor=retrieval.Cursor(retrieval.as_datetime("2024-01-15 00:00:00"), "000000005000"),
    )
    return page.select("event_id", "timestamp", "position", "has_more")


@query(
    "b5_cursor_text",
    ev_sql(
        """SELECT event_id, replace(replace(to_base64(encode('{"ts":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ')
  || '","eid":"' || event_id || '"}')), '+', '-'), '/', '_') AS cursor FROM ev"""
    ),
)
def b5(spark, folder):
    text = cursor_column(F.col("timestamp"), F.col("event_id"))
    return events(spark, folder).select("event_id", text.alias("cursor"))


@query(
    "b5_next_page",
    ev_sql(
        f"""SELECT event_id, "timestamp", row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) AS position FROM (
  SELECT * FROM ev WHERE "timestamp" >= TIMESTAMP '{MONTH_START}' ORDER BY "timestamp" DESC, event_id DESC LIMIT 20 OFFSET 50)"""
    ),
)
def b5_next(spark, folder):
    """The page after the first one, by its cursor text; the first has the default size."""
    ev = events(spark, folder)
    first = retrieval.event_page(ev, as_of=AS_OF, start=MONTH_START)
    cursor = first.where("next_cursor is not null").first()["next_cursor"]
    page = retrieval.event_page(ev, as_of=AS_OF, start=MONTH_START, cursor=cursor, limit=20)
    return page.select("event_id", "timestamp", "position")


@query(
    "b6_default_page",
    ev_sql(f"""SELECT event_id FROM ev WHERE {MONTH} AND severity = 'info' ORDER BY "timestamp" DESC, event_id DESC LIMIT 50"""),
)
def b6(spark, folder):
    return retrieval.query_events(
        events(spark, folder), as_of=AS_OF, start=MONTH_START, end=AS_OF, severity="info"
    ).select("event_id")


@query(
    "b7_json_fields",
    ev_sql(
        """SELECT event_id, json_extract_string(data, '$.status') AS status, json_extract_string(data, '$.method') AS method,
  json_extract_string(data, '$.path') AS path, json_extract_string(metadata, '$.host') AS host FROM ev"""
    ),
)
def b7(spark, folder):
    ev = retrieval.with_fields(events(spark, folder), "status", "method", "path", "host")
    return ev.select("event_id", "status", "method", "path", "host")


@query(
    "b8_live_tail",
    ev_sql(
        """SELECT event_id, "timestamp", source, coalesce(l.n, 0) > 0 AS live,
  CASE WHEN l.n > 0 THEN 'live' ELSE 'stored' END AS seen
FROM ev LEFT JOIN (SELECT event_id, 1 AS n FROM ev WHERE event_type = 'error'
  ORDER BY "timestamp" DESC, event_id DESC LIMIT 700) l USING (event_id)
WHERE severity = 'error' AND (value < 40 OR l.n > 0)"""
    ),
)
def b8(spark, folder):
    ev = events(spark, folder)
    live = ev.where(F.col("event_type") == "error").withColumn("seen", F.lit("live"))
    stored = ev.where(F.col("value") < 40).withColumn("seen", F.lit("stored"))
    merged = retrieval.live_tail(live, stored, severity="error", buffer=700)
    return merged.select("event_id", "timestamp", "source", "live", "seen")


@query(
    "b8_live_unbounded",
    ev_sql(
        """SELECT event_id, severity, event_type = 'error' AS live FROM ev WHERE event_type = 'error' OR value < 40"""
    ),
)
def b8_unbounded(spark, folder):
    ev = events(spark, folder)
    merged = retrieval.live_tail(ev.where(F.col("event_type") == "error"), ev.where(F.col("value") < 40))
    return merged.select("event_id", "severity", "live")


@query("c1_minute_counts", ev_sql("SELECT * FROM counts", "counts"))
def c1(spark, folder):
    return minutes(spark, folder)


@query(
    "c2_hourly_rollup",
    ev_sql(
        """SELECT date_trunc('hour', bucket) AS bucket, source, event_type, severity, CAST(sum(count) AS BIGINT) AS count
FROM counts GROUP BY ALL""",
        "counts",
    ),
)
def c2(spark, folder):
    return rollup.coarser(minutes(spark, folder), "1 hour")


HOUR_SQL = """SELECT date_trunc('hour', "timestamp") AS bucket, source, event_type, severity, count(*) AS count FROM ev"""


@query(
    "c2_roll_one_hour",
    ev_sql(f"""{HOUR_SQL} WHERE date_trunc('hour', "timestamp") = TIMESTAMP '2024-01-05 13:00:00' GROUP BY ALL"""),
)
def c2_one(spark, folder):
    return rollup.roll_hour(
        minutes(spark, folder, "2024-01-05 13:00:00", "2024-01-05 14:00:00"), "2024-01-05 13:20:00"
    )


@query(
    "c3_roll_pending_hours",
    ev_sql(
        f"""{HOUR_SQL} WHERE "timestamp" >= TIMESTAMP '2024-01-05 12:00:00'
AND "timestamp" < TIMESTAMP '2024-01-05 14:00:00' GROUP BY ALL"""
    ),
)
def c3(spark, folder):
    return rollup.roll_pending(
        minutes(spark, folder, "2024-01-05 12:00:00", "2024-01-05 14:00:00"), as_of="2024-01-05 14:25:00"
    )


@query("c4_add_counts", ev_sql("SELECT bucket, source, event_type, severity, 2 * count AS count FROM counts WHERE source = 'svc-0' UNION ALL SELECT * FROM counts WHERE source <> 'svc-0'", "counts"))
def c4_add(spark, folder):
    stored = minutes(spark, folder)
    return rollup.add_counts(stored, stored.where(F.col("source") == "svc-0"))


@query("c4_replace_counts", ev_sql("SELECT bucket, source, event_type, severity, CASE WHEN source = 'svc-0' THEN count + 5 ELSE count END AS count FROM counts", "counts"))
def c4_replace(spark, folder):
    stored = minutes(spark, folder)
    fresh = stored.where(F.col("source") == "svc-0").withColumn("count", F.col("count") + 5)
    return rollup.replace_counts(stored, fresh)


def _series_sql(dimension: str, width: str, where: str = "") -> str:
    extra = f", {dimension}" if dimension else ""
    return ev_sql(
        f"""SELECT date_trunc('{width}', bucket) AS bucket{extra}, CAST(sum(count) AS BIGINT) AS count
FROM counts WHERE {B_MONTH}{where} GROUP BY ALL ORDER BY ALL""",
        "counts",
    )


@query("c5_timeseries_total", _series_sql("", "minute"))
def c5_total(spark, folder):
    return analytics.time_series(month(spark, folder), MONTH_START, AS_OF)


@query("c5_timeseries_by_source", _series_sql("source", "hour"))
def c5_source(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    return analytics.time_series(hours, MONTH_START, AS_OF, group_by="source")


@query("c5_timeseries_by_severity", _series_sql("severity", "hour"))
def c5_severity(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    return analytics.time_series(hours, MONTH_START, AS_OF, group_by="severity")


@query("c5_timeseries_filtered", _series_sql("", "minute", " AND source = 'svc-2' AND severity = 'warn'"))
def c5_filtered(spark, folder):
    return analytics.time_series(
        month(spark, folder), MONTH_START, AS_OF, source="svc-2", severity="warn"
    )


def _requested(spark, folder, **request):
    """A series as a request names it, over both count tables."""
    ev = events(spark, folder)
    minutes, hours = rollup.minute_counts(ev), rollup.counts_of(ev, "1 hour")
    return analytics.series_of(minutes, hours, as_of=AS_OF, **request)


@query(
    "c6_resolution_by_range",
    ev_sql(
        f"""SELECT date_trunc('hour', "timestamp") AS bucket, severity, count(*) AS count FROM ev
WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND "timestamp" < TIMESTAMP '{AS_OF}' GROUP BY ALL"""
    ),
)
def c6(spark, folder):
    return _requested(spark, folder, shorthand="7d", group_by="severity")


@query(
    "c6_resolution_given",
    ev_sql(
        f"""SELECT date_trunc('minute', "timestamp") AS bucket, count(*) AS count FROM ev
WHERE "timestamp" >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND "timestamp" < TIMESTAMP '{AS_OF}' GROUP BY ALL"""
    ),
)
def c6_given(spark, folder):
    return _requested(spark, folder, shorthand="30d", resolution="1m")


@query(
    "c7_range_shorthand",
    ev_sql(
        f"""SELECT date_trunc('minute', "timestamp") AS bucket, source, count(*) AS count FROM ev
WHERE "timestamp" >= TIMESTAMP '2024-01-16' - INTERVAL 24 HOUR AND "timestamp" < TIMESTAMP '2024-01-16' GROUP BY ALL"""
    ),
)
def c7(spark, folder):
    return _requested(spark, folder, shorthand="24h", end="2024-01-16 00:00:00", group_by="source")


@query(
    "c8_summary_totals",
    ev_sql(
        f"""SELECT count(*) AS total_events, count(*) FILTER (severity IN ('error','fatal')) AS error_count,
  round(count(*) FILTER (severity IN ('error','fatal')) / count(*), 6) AS error_rate,
  count(DISTINCT source) AS active_sources FROM ev WHERE {MONTH}"""
    ),
)
def c8(spark, folder):
    totals = analytics.summary_totals(month(spark, folder), MONTH_START, AS_OF)
    return totals.withColumn("error_rate", r6("error_rate"))


@query("c9_active_sources", ev_sql(f"SELECT count(DISTINCT source) AS active_sources FROM ev WHERE {MONTH}"))
def c9(spark, folder):
    return analytics.active_sources(month(spark, folder), MONTH_START, AS_OF)


def _top_sql(key: str, limit: str) -> str:
    return ev_sql(f"SELECT {key} AS key, count(*) AS count FROM ev WHERE {MONTH} GROUP BY 1 ORDER BY 2 DESC, 1 {limit}")


@query("c10_top_sources", _top_sql("source", "LIMIT 5"))
def c10(spark, folder):
    return analytics.top_n(month(spark, folder), MONTH_START, AS_OF, limit=5)


@query(
    "c9_bitmap_distincts",
    ev_sql(
        """SELECT 'day' AS part, severity, date_trunc('day', "timestamp") AS bucket, count(DISTINCT user_id) AS distinct_values FROM ev GROUP BY ALL
UNION ALL SELECT 'range', '', NULL, count(DISTINCT user_id) FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-05 07:00:00' AND "timestamp" < TIMESTAMP '2024-01-19 03:00:00'
UNION ALL SELECT 'sources', '', NULL, count(DISTINCT source) FROM ev"""
    ),
)
def c9_bitmaps(spark, folder):
    """Users and sources numbered, bitmaps per hour stored, and distinct counts of any range merged from these alone."""
    ev = events(spark, folder)
    older = F.dayofmonth("timestamp") <= 10
    path = work_folder(spark, "bitmaps")
    # Numbers are given in two runs, as new users come.
    distincts.number_values(ev.where(older), "user_id").write.parquet(f"{path}/first")
    distincts.number_values(ev, "user_id", spark.read.parquet(f"{path}/first")).write.parquet(f"{path}/users")
    users = spark.read.parquet(f"{path}/users")
    write_by_day(distincts.hour_bitmaps(ev, "user_id", users, ["severity"]), f"{path}/hours", "bucket", sort=("bucket",))
    hours = spark.read.parquet(f"{path}/hours")
    days = distincts.distinct_between(hours, keys=["severity"], width="1 day").select(
        F.lit("day").alias("part"), "severity", "bucket", "distinct_values"
    )
    sources = distincts.hour_bitmaps(ev, "source", distincts.number_values(ev, "source"))
    none = F.lit(None).cast("timestamp_ntz").alias("bucket")
    for part, found in (
        ("range", distincts.distinct_between(hours, "2024-01-05 07:00:00", "2024-01-19 03:00:00")),
        ("sources", distincts.distinct_between(sources)),
    ):
        days = days.unionByName(found.select(F.lit(part).alias("part"), F.lit("").alias("severity"), none, "distinct_values"))
    return days


@query("c11_by_severity", _top_sql("severity", ""))
def c11(spark, folder):
    return analytics.by_severity(month(spark, folder), MONTH_START, AS_OF)


@query("c12_top_event_types", _top_sql("event_type", "LIMIT 3"))
def c12(spark, folder):
    return analytics.top_n(month(spark, folder), MONTH_START, AS_OF, group_by="event_type", limit=3)


@query("c12_top_unknown_key", _top_sql("source", "LIMIT 6"))
def c12_unknown(spark, folder):
    return analytics.top_n(month(spark, folder), MONTH_START, AS_OF, group_by="host", limit=6)


@query(
    "c13_pivot_severity",
    ev_sql(
        "SELECT date_trunc('hour', \"timestamp\") AS bucket, "
        + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in S.SEVERITIES)
        + f" FROM ev WHERE {MONTH} GROUP BY 1"
    ),
)
def c13(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    return analytics.pivot_severity(hours, MONTH_START, AS_OF)


@query(
    "c14_volume_chart",
    ev_sql(
        """SELECT b.bucket, count(*) FILTER (severity IN ('debug', 'info')) AS info,
  count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity IN ('error', 'fatal')) AS error
FROM generate_series(TIMESTAMP '2024-01-05 13:00:00', TIMESTAMP '2024-01-05 14:00:00', INTERVAL 5 MINUTE) b(bucket)
LEFT JOIN ev ON time_bucket(INTERVAL 5 MINUTE, "timestamp") = b.bucket GROUP BY 1"""
    ),
)
def c14(spark, folder):
    return analytics.volume_chart(
        minutes(spark, folder, "2024-01-05 13:00:00", "2024-01-05 14:05:00"), as_of="2024-01-05 14:03:20"
    )


@query(
    "c15_overview",
    ev_sql(
        """SELECT count(*) AS total, count(*) FILTER (severity IN ('error','fatal')) AS errors,
  count(DISTINCT source) AS sources, round(count(*) FILTER (severity IN ('error','fatal')) / count(*) * 100, 1) AS error_percent
FROM (SELECT * FROM ev ORDER BY "timestamp" DESC, event_id DESC LIMIT 100)"""
    ),
)
def c15(spark, folder):
    return retrieval.overview(events(spark, folder))


@query(
    "l1_latency_stats",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, source, json_extract_string(data, '$.path') AS endpoint,
  count(*) AS count, sum(ms) AS sum, min(ms) AS min, max(ms) AS max,
  round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99
FROM (SELECT *, CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) AS ms FROM ev) GROUP BY ALL"""
    ),
)
def l1(spark, folder):
    stats = rollup.latency_stats(events(spark, folder))
    for name in ("p50", "p95", "p99"):
        stats = stats.withColumn(name, r6(name))
    return stats


SKETCH_SQL = """timed AS (SELECT "timestamp", source, json_extract_string(data, '$.path') AS endpoint,
  CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) AS ms FROM ev)"""


def stored_sketches(spark, folder):
    path = work_folder(spark, "sketches")
    write_by_day(sketches.latency_sketches(events(spark, folder)), path, "bucket", sort=("source", "bucket"))
    return spark.read.parquet(path)


@query(
    "l1_merged_sketches",
    ev_sql(
        """SELECT date_trunc('hour', "timestamp") AS bucket, source, endpoint, count(*) AS count, sum(ms) AS sum, min(ms) AS min, max(ms) AS max,
  quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM timed GROUP BY ALL""",
        SKETCH_SQL,
    ),
)
def l1_sketches(spark, folder):
    """Sketches of minutes, stored, and merged to hours; hours of so few events are exact."""
    hours = sketches.merge_sketches(stored_sketches(spark, folder), "1 hour")
    return sketches.sketch_percentiles(hours)


@query(
    "l1_weekly_sketches",
    ev_sql(
        """SELECT source, date_trunc('week', "timestamp") AS bucket, count(*) AS count, sum(ms) AS sum, min(ms) AS min, max(ms) AS max, count(*) AS held
FROM timed GROUP BY ALL""",
        SKETCH_SQL,
    ),
)
def l1_weeks(spark, folder):
    """The same sketches merged to weeks of a source: exact counts, sums and extremes, and every event held."""
    days = stored_sketches(spark, folder).withColumn("bucket", F.date_trunc("week", "bucket").cast("timestamp_ntz"))
    weeks = sketches.merge_sketches(days, keys=["source", "bucket"])
    return weeks.select("*", F.kll_sketch_get_n_double("sketch").alias("held")).drop("sketch")


@query(
    "l1_fractional_latency",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, 'all' AS source, '/' || event_type AS endpoint, count(*) AS count,
  round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY ALL"""
    ),
)
def l1_fractions(spark, folder):
    timed = F.to_json(F.struct(F.concat(F.lit("/"), "event_type").alias("path"), F.col("value").alias("duration_ms")))
    ev = events(spark, folder).withColumns({"data": timed, "source": F.lit("all")})
    stats = rollup.latency_stats(ev)
    for name in ("sum", "p50", "p95", "p99"):
        stats = stats.withColumn(name, r6(name))
    return stats


@query(
    "l2_error_rates",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, source, count(*) AS total,
  count(*) FILTER (severity IN ('error','fatal')) AS errors, round(errors / total, 6) AS error_rate FROM ev GROUP BY ALL"""
    ),
)
def l2(spark, folder):
    return rollup.error_rates(minutes(spark, folder)).withColumn("error_rate", r6("error_rate"))


@query("l3_fresh_counts", ev_sql("SELECT * FROM counts", "counts"))
def l3(spark, folder):
    ev = events(spark, folder)
    return rollup.fresh_counts(rollup.minute_counts(ev), ev, rolled_until="2024-01-20 10:07:00")


DAYS_SQL = """days AS (SELECT CAST("timestamp" AS DATE) AS event_date, count(*) AS rows FROM ev GROUP BY 1)"""


def _days(spark, folder):
    return events(spark, folder).groupBy(F.to_date("timestamp").alias("event_date")).agg(
        F.count("*").alias("rows")
    )


@query(
    "l4_retention",
    ev_sql(
        """SELECT event_date, rows, t AS table_name, DATE '2024-02-10' - event_date AS age_days,
  DATE '2024-02-10' - event_date <= k AS keep
FROM days, (VALUES ('events', 30), ('event_counts_1m', 30), ('event_counts_1h', 365)) p(t, k)""",
        DAYS_SQL,
    ),
)
def l4(spark, folder):
    return rollup.retention(_days(spark, folder), as_of="2024-02-10 03:00:00")


@query(
    "l5_richer_filters",
    ev_sql(
        """SELECT event_id, severity FROM ev WHERE severity IN ('error', 'fatal', 'warn') AND list_contains(tags, 'us-east-1')
AND CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) > 100 AND CAST(json_extract_string(data, '$.status') AS DOUBLE) <= 502"""
    ),
)
def l5(spark, folder):
    found = retrieval.matching(
        events(spark, folder), severities=("error", "fatal", "warn"), tags=("us-east-1",),
        numbers={"$.duration_ms": (">", 100), "$.status": ("<=", 502)},
    )
    return found.select("event_id", "severity")


PERIOD_SQL = """periods AS (SELECT source,
  count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-24') AS this_total,
  count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-24' AND severity IN ('error','fatal')) AS this_errors,
  count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-24') AS last_total,
  count(*) FILTER ("timestamp" < TIMESTAMP '2024-01-24' AND severity IN ('error','fatal')) AS last_errors,
  CASE WHEN this_total > 0 THEN this_errors / this_total ELSE 0 END AS this_rate,
  CASE WHEN last_total > 0 THEN last_errors / last_total ELSE 0 END AS last_rate
  FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-17' AND "timestamp" < TIMESTAMP '2024-01-31' GROUP BY 1)"""


@query(
    "l13_health_report",
    ev_sql(
        """SELECT source, this_total, this_errors, round(this_rate, 6) AS this_rate, round(last_rate, 6) AS last_rate,
  CASE WHEN this_rate > last_rate * 1.1 THEN 'degrading' WHEN this_rate < last_rate * 0.9 THEN 'improving' ELSE 'stable' END AS trend,
  round(1 - this_rate, 6) AS availability, 1 - this_rate >= 0.99 AS sla_met,
  round(1 - this_errors / (this_total * 0.01), 6) AS budget_left FROM periods""",
        PERIOD_SQL,
    ),
)
def l13(spark, folder):
    report = analytics.health_report(minutes(spark, folder, "2024-01-17", AS_OF), as_of=AS_OF)
    for name in ("this_rate", "last_rate", "availability", "budget_left"):
        report = report.withColumn(name, r6(name))
    return report


@query(
    "l14_hourly_pattern",
    ev_sql(
        """SELECT source, CAST(hour AS INTEGER) AS hour, round(avg(errors), 6) AS mean_errors, round(any_value(m), 6) AS source_mean,
  any_value(m) > 0 AND avg(errors) >= any_value(m) * 1.5 AS recurring
FROM (SELECT *, avg(errors) OVER (PARTITION BY source) AS m FROM (
  SELECT source, date_trunc('hour', "timestamp") AS h, hour(h) AS hour,
    count(*) FILTER (severity IN ('error','fatal')) AS errors FROM ev GROUP BY ALL)) GROUP BY source, hour"""
    ),
)
def l14(spark, folder):
    hours = rollup.counts_of(events(spark, folder), "1 hour")
    found = analytics.hourly_pattern(hours, factor=1.5)
    return found.withColumn("mean_errors", r6("mean_errors")).withColumn(
        "source_mean", r6("source_mean")
    )


@query(
    "l15_source_profiles",
    ev_sql(
        """SELECT source, count(*) AS events, count(DISTINCT event_type) AS event_types,
  any_value(k) AS json_keys, any_value(k) > 0 AS has_latency
FROM (SELECT *, (SELECT count(DISTINCT key) FROM (SELECT unnest(json_keys(data)) AS key)) AS k FROM ev) GROUP BY 1"""
    ),
)
def l15(spark, folder):
    return analytics.source_profiles(events(spark, folder))


@query(
    "l16_top_endpoints",
    ev_sql(
        """SELECT json_extract_string(data, '$.path') AS endpoint, count(*) AS requests,
  round(avg(CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE)), 6) AS mean_ms
FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
    ),
)
def l16(spark, folder):
    return analytics.top_endpoints(events(spark, folder)).withColumn("mean_ms", r6("mean_ms"))


@query(
    "l17_facets",
    ev_sql(
        """SELECT CASE WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(severity) = 0 THEN 'severity' ELSE 'event_type' END AS facet,
  coalesce(source, severity, event_type) AS value, count(*) AS count
FROM ev GROUP BY GROUPING SETS ((source), (severity), (event_type))"""
    ),
)
def l17(spark, folder):
    return analytics.facets(events(spark, folder))


@query(
    "l18_aggregate",
    ev_sql(
        """SELECT json_extract_string(data, '$.method') AS method, severity, time_bucket(INTERVAL 1 DAY, "timestamp") AS bucket,
  round(avg(CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE)), 6) AS value FROM ev GROUP BY ALL"""
    ),
)
def l18(spark, folder):
    out = analytics.aggregate(
        events(spark, folder), function="avg", metric="duration_ms",
        group_by=("method", "severity"), window="1 day",
    )
    return out.withColumn("value", r6("value"))


@query(
    "l18_count_by_field",
    ev_sql("SELECT json_extract_string(metadata, '$.host') AS host, count(*) AS value FROM ev GROUP BY 1"),
)
def l18_count(spark, folder):
    return analytics.aggregate(events(spark, folder), group_by=("host",))


@query(
    "l22_known_at",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, source, event_type, severity, count(*) AS count FROM dup
WHERE received_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL""",
        "dup",
    ),
)
def l22(spark, folder):
    seen = rollup.known_at(redelivered(events(spark, folder)), "2024-01-20 12:00:00")
    return rollup.minute_counts(seen)


@query(
    "l23_storage_tier",
    ev_sql(
        """SELECT event_date, rows, CASE WHEN DATE '2024-02-10' - event_date <= 7 THEN 'hot'
  WHEN DATE '2024-02-10' - event_date <= 30 THEN 'warm' WHEN DATE '2024-02-10' - event_date <= 365 THEN 'cold' ELSE 'delete' END AS tier
FROM days""",
        DAYS_SQL,
    ),
)
def l23(spark, folder):
    return rollup.storage_tier(_days(spark, folder), as_of="2024-02-10 03:00:00")


@query("l28_two_level_counts", ev_sql("SELECT * FROM counts", "counts"))
def l28(spark, folder):
    at_edge = events(spark, folder).withColumn("edge", F.element_at("tags", 2))
    return rollup.merge_partials(rollup.partial_counts(at_edge))


@query(
    "l32_period_compare",
    ev_sql(
        "SELECT * REPLACE (round(this_rate, 6) AS this_rate, round(last_rate, 6) AS last_rate) FROM periods",
        PERIOD_SQL,
    ),
)
def l32(spark, folder):
    found = analytics.compare_periods(minutes(spark, folder, "2024-01-17", AS_OF), as_of=AS_OF)
    return found.withColumn("this_rate", r6("this_rate")).withColumn("last_rate", r6("last_rate"))


@query(
    "l33_duration_buckets",
    ev_sql(
        """SELECT CASE WHEN ms < 10 THEN '<10ms' WHEN ms < 100 THEN '10-100ms' WHEN ms < 1000 THEN '100ms-1s' ELSE '>=1s' END AS bucket,
  count(*) AS n FROM (SELECT CAST(json_extract_string(data, '$.duration_ms') AS DOUBLE) AS ms FROM ev) GROUP BY 1"""
    ),
)
def l33(spark, folder):
    classed = events(spark, folder).select(analytics.duration_bucket(duration_ms()).alias("bucket"))
    return classed.groupBy("bucket").agg(F.count("*").alias("n"))


def _failures(spark, folder):
    ev = retrieval.with_fields(events(spark, folder), "host")
    return ev.where(S.is_error(F.col("severity"))).select(
        "timestamp", "host", F.col("user_id").cast("string").alias("account")
    )


@query(
    "l30_login_burst_minutes",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, count(*) AS failures FROM ev
WHERE severity IN ('error','fatal') GROUP BY 1 HAVING count(*) > 1"""
    ),
)
def l30(spark, folder):
    return analytics.login_bursts(_failures(spark, folder), threshold=1)[0]


@query(
    "l30_login_burst_leaders",
    ev_sql(
        """SELECT * FROM (SELECT 'host' AS dimension, json_extract_string(metadata, '$.host') AS value, count(*) AS failures
  FROM ev WHERE severity IN ('error','fatal') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'account', CAST(user_id AS VARCHAR) AS v, count(*) AS n
  FROM ev WHERE severity IN ('error','fatal') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)"""
    ),
)
def l30_leaders(spark, folder):
    return analytics.login_bursts(_failures(spark, folder))[1]
