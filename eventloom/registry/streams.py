"""Streaming jobs run to the end of the shared tables and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventloom import schemas as S
from eventloom.operators.rollup import merge_days, minute_counts
from eventloom.registry import ev_sql, query, r6
from eventloom.session import prepare, work_folder
from eventloom.sources.canonical import RAW_EVENTS, alert_rules, events, redelivered, to_events
from eventloom.sources.store import write_by_day
from eventloom.streaming import jobs, lifecycle
from eventloom.streaming.tables import compact, create_tables, read_table, stored_counts, write_hours


def event_stream(spark, folder):
    """The shared events as a stream, in the stored schema (event time must have a zone)."""
    raw = (
        prepare(spark)
        .readStream.schema(RAW_EVENTS)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    return stored_form(to_events(raw))


def stored_form(ev):
    return ev.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.EVENT.fields)
    )


def _root(spark, name, *tables):
    root = work_folder(spark, name)
    create_tables(spark, root, tables)
    return root


def write_rules(rules, root):
    """Rules as a table, as each batch reads them again."""
    rules.write.parquet(f"{root}/rules")
    return rules.sparkSession.read.parquet(f"{root}/rules")


def _payload_stream(spark, folder):
    from eventloom.registry.ingest import _payload

    ev = event_stream(spark, folder)
    text = F.when(
        F.col("event_id").endswith("77"), F.concat(F.lit("x"), _payload())
    ).otherwise(_payload())
    source = F.when(F.col("event_id").endswith("33"), "").otherwise(F.col("source"))
    return ev.withColumn("source", source).select(text.alias("payload"), "received_at")


def data_clock(spark, folder):
    """The present moved back to the end of the shared events: an arrival that never falls, in their own time."""
    last = events(spark, folder).agg(F.max(F.unix_seconds(F.col("timestamp").cast("timestamp")))).first()[0] or 0
    ahead = int(dt.datetime.now(dt.timezone.utc).timestamp()) - last
    return F.current_timestamp() - F.make_dt_interval(secs=F.lit(ahead - 1))


@query("a11_stream_processing", ev_sql("SELECT * FROM counts", "counts"))
def a11(spark, folder):
    """Events of the last forty days: the state alone tells copies, no stored event is read."""
    root = _root(spark, "processing", "events", "counts")
    sent = redelivered(event_stream(spark, folder))
    clock = data_clock(spark, folder)
    jobs.start_processing(sent, root, f"{root}/checkpoint", horizon="40 days", arrived=clock).awaitTermination()
    return stored_counts(spark, root).drop("event_date")


@query("a11_old_events", ev_sql("SELECT * FROM counts", "counts"))
def a11_old(spark, folder):
    """Twice the same events, all older than the state reaches: the second time none is stored."""
    root = _root(spark, "old", "events", "counts")
    for run in range(2):
        sent = redelivered(event_stream(spark, folder))
        jobs.start_processing(sent, root, f"{root}/checkpoint-{run}").awaitTermination()
        compact(spark, root, "events", dt.date(2024, 2, 1))
    return stored_counts(spark, root).drop("event_date")


@query(
    "a11_stream_ingest",
    ev_sql(
        """SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN event_id LIKE '%77' THEN 'quarantine' WHEN event_id LIKE '%33' THEN 'rejected' ELSE 'events' END AS kind,
    CASE WHEN event_id LIKE '%77' THEN 1 ELSE 2 END AS copies FROM ev), LATERAL (SELECT unnest(range(copies)))
GROUP BY 1"""
    ),
)
def a11_ingest(spark, folder):
    root = _root(spark, "ingest", "events", "counts", "rejected", "quarantine")
    jobs.start_ingest(
        _payload_stream(spark, folder), root, f"{root}/checkpoint", F.col("received_at")
    ).awaitTermination()

    def size(name):
        return read_table(spark, root, name).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))

    return size("events").unionAll(size("rejected")).unionAll(size("quarantine"))


@query(
    "a11_ingest_contents",
    ev_sql(
        """SELECT CASE seq % 5 WHEN 1 THEN 'rejected' WHEN 2 THEN 'quarantine' WHEN 3 THEN 'quarantine' ELSE 'events' END AS kind,
  seq, CASE WHEN seq % 5 IN (0, 4) THEN severity END AS severity FROM ev
UNION ALL SELECT 'quarantine', -1 - seq, NULL FROM ev WHERE seq % 400 = 0"""
    ),
)
def a11_contents(spark, folder):
    """Batches of 1500 events and more, flawed in several ways: all that was sent comes back."""
    ev = events(spark, folder)
    seq = F.col("event_id").cast("bigint")
    wrong = F.when(seq % 5 == 3, F.floor(seq / 5) % 4)
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.when(seq % 5 != 2, F.concat(F.lit('"'), at, F.lit('"'))).otherwise(F.when(F.floor(seq / 5) % 2 == 0, '"nonsense"').otherwise("2024"))

    def named(name, kind, other):
        """A text field, of another JSON type in some events."""
        value = F.when(wrong == kind, F.lit(other)).otherwise(F.concat(F.lit('"'), F.col(name), F.lit('"')))
        return F.concat(F.lit(f'"{name}":'), value, F.lit(","))

    plain = F.concat(
        F.lit("{"), F.when(seq % 5 != 1, named("source", 1, '{"a":"b"}')).otherwise(""), named("event_type", 2, '["x"]'),
        named("severity", 3, "5"), F.lit('"timestamp":'), at, F.lit(',"data":{"n":'), seq,
        F.when(wrong == 0, F.lit('},"tags":')).otherwise('},"tags":["a","b"]}'),
        F.when(wrong == 0, F.when(F.floor(seq / 20) % 2 == 0, '"notalist"}').otherwise("[1,2]}")).otherwise(""),
    )
    batches = (
        ev.select(seq.alias("n"), plain.alias("one"))
        .groupBy(F.floor(F.col("n") / 1500))
        .agg(F.concat(F.lit('{"events":['), F.array_join(F.sort_array(F.collect_list("one")), ","), F.lit("]}")).alias("payload"))
        .select("payload")
    )
    empty = ev.where(seq % 400 == 0).select(F.concat(F.lit('{"foo":1,"n":'), -1 - seq, F.lit("}")).alias("payload"))
    root = _root(spark, "contents", "events", "counts", "rejected", "quarantine")
    batches.unionByName(empty).write.parquet(f"{root}/sent")
    stream = spark.readStream.schema("payload string").parquet(f"{root}/sent")
    received = F.lit("2024-02-01 00:00:00").cast("timestamp")
    jobs.start_ingest(stream, root, f"{root}/checkpoint", received).awaitTermination()

    def contents(name, text, severity):
        n = F.regexp_extract(text, r'"n":(-?[0-9]+)', 1).cast("bigint")
        return read_table(spark, root, name).select(F.lit(name).alias("kind"), n.alias("seq"), severity.alias("severity"))

    nothing = F.lit(None).cast("string")
    stored = contents("events", F.col("data"), F.col("severity"))
    return stored.unionAll(contents("rejected", F.col("payload"), nothing)).unionAll(
        contents("quarantine", F.col("payload"), nothing)
    )


@query("c1_stream_counts", ev_sql("SELECT * FROM counts", "counts"))
def c1_stream(spark, folder):
    root = _root(spark, "counts", "latest_counts")
    jobs.start_counts(event_stream(spark, folder), root, f"{root}/checkpoint").awaitTermination()
    return jobs.running_counts(spark, root)


def _by_days(spark, folder, root, run, days=5, late=None):
    """The shared events in the order of time, `days` of them a step; `run` drains the stream after each step.

    Events that are `late`, which must not be null, come a step after their day, so that a day lies in several batches.
    A step is written by as many tasks as its rows ask for, and read whole: tasks don't grow with the table.
    """
    ev = stored_form(events(spark, folder)).withColumn("day", F.to_date("timestamp"))
    ev.hint("rebalance", "day").write.partitionBy("day").parquet(f"{root}/by-day")
    stored = spark.read.parquet(f"{root}/by-day")
    found = sorted(r["day"] for r in stored.select("day").distinct().collect())
    steps = [found[i : i + days] for i in range(0, len(found), days)]
    last = [] if late is None else [[]]
    for now, before in zip([*steps, *last], [[], *steps]):
        due = F.col("day").isin(now)
        if late is not None:
            due = (due & ~late) | (F.col("day").isin(before) & late)
        part = stored.where(due).select(*S.EVENT_COLUMNS)
        part.write.mode("append").parquet(f"{root}/sent")
        run(spark.readStream.schema(S.EVENT).parquet(f"{root}/sent"))


@query("a11_compacted", ev_sql("SELECT *, 'events' AS part FROM counts UNION ALL SELECT *, 'counts' FROM counts", "counts"))
def a11_compacted(spark, folder):
    """Events in steps, late and redelivered ones among them, counted again from the tables after compaction."""
    root = _root(spark, "compacted", "events", "counts")

    def run(sent):
        jobs.start_processing(redelivered(sent), root, f"{root}/checkpoint").awaitTermination()

    _by_days(spark, folder, root, run, late=F.coalesce(F.col("event_id").endswith("7"), F.lit(False)))
    for name in ("events", "counts"):
        compact(spark, root, name, dt.date(2024, 1, 25))
    again = minute_counts(read_table(spark, root, "events")).withColumn("part", F.lit("events"))
    return again.unionByName(stored_counts(spark, root).drop("event_date").withColumn("part", F.lit("counts")))


@query(
    "c2_stored_hours",
    ev_sql(
        """SELECT date_trunc('hour', "timestamp") AS bucket, source, event_type, severity, count(*) AS count
FROM ev GROUP BY ALL"""
    ),
)
def c2_stored(spark, folder):
    """The hour table: written for the month, then once more for the days that late events touch."""
    root = _root(spark, "hours", "events", "counts", "hour_counts")
    ev = stored_form(events(spark, folder))
    late = (F.dayofmonth("timestamp") == 9) & (F.col("severity") == "info")
    jobs.replay(ev.where(~late), root, 0, "2024-01-01", "2024-02-01", days=31)
    write_hours(spark, root, "2024-01-01", "2024-02-01")
    jobs.replay(ev.where(late), root, 1, "2024-01-09", "2024-01-10")
    write_hours(spark, root, "2024-01-09 10:00:00", "2024-01-09 11:00:00")
    return read_table(spark, root, "hour_counts").drop("event_date")


@query("c4_merge_touched_days", ev_sql("SELECT * FROM counts", "counts"))
def c4_days(spark, folder):
    """A stored table of counts that lacks half of two days, which a delta adds; the other days stay as they lie."""
    path = work_folder(spark, "merged")
    ev = events(spark, folder)
    later = (F.col("seq") % 2 == 1) & F.dayofmonth("timestamp").isin(5, 9)
    write_by_day(minute_counts(ev.where(~later)), path, "bucket", sort=("source", "bucket"))
    stored = spark.read.parquet(path)
    write_by_day(merge_days(stored, minute_counts(ev.where(later))), path, "bucket", sort=("source", "bucket"))
    return spark.read.parquet(path).drop("event_date")


# Every rule at every minute of the month; then the chain of firings that cooldown leaves.
ALERT_MINUTES_SQL = """grid AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MINUTE)) AS tick FROM counts),
per AS (SELECT s.source, bucket, sum(count) AS n, coalesce(sum(count) FILTER (severity IN ('error','fatal')), 0) AS e
  FROM (SELECT unnest([source, '']) AS source, bucket, severity, count FROM counts) s GROUP BY 1, 2),
keyed AS (SELECT rule_id, metric, operator, threshold, cooldown_seconds, source,
    CASE "window" WHEN '1m' THEN 1 WHEN '15m' THEN 15 WHEN '1h' THEN 60 ELSE 5 END AS w FROM rules WHERE enabled),
dense AS (SELECT k.source, g.tick, coalesce(p.n, 0) AS n, coalesce(p.e, 0) AS e
  FROM (SELECT DISTINCT source FROM keyed) k CROSS JOIN grid g LEFT JOIN per p ON p.source = k.source AND p.bucket = g.tick),
upto AS (SELECT source, tick, sum(n) OVER u AS n, sum(e) OVER u AS e FROM dense
  WINDOW u AS (PARTITION BY source ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
measured AS (SELECT k.*, g.tick, coalesce(b.n, 0) - coalesce(a.n, 0) AS n, coalesce(b.e, 0) - coalesce(a.e, 0) AS e
  FROM keyed k CROSS JOIN grid g LEFT JOIN upto b ON b.source = k.source AND b.tick = g.tick - INTERVAL 1 MINUTE
  LEFT JOIN upto a ON a.source = k.source AND a.tick = g.tick - to_minutes(k.w + 1)),
valued AS (SELECT *, CASE metric WHEN 'event_count' THEN n::DOUBLE WHEN 'error_count' THEN e::DOUBLE
    WHEN 'error_rate' THEN CASE WHEN n > 0 THEN e / n ELSE 0.0 END END AS value FROM measured),
hot AS (SELECT rule_id, tick, value, cooldown_seconds FROM valued WHERE CASE operator WHEN '>' THEN value > threshold
  WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold ELSE false END),
j0 AS MATERIALIZED (SELECT rule_id, tick, min(tick) OVER (PARTITION BY rule_id ORDER BY tick
  RANGE BETWEEN INTERVAL 300 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM hot),
r0 AS MATERIALIZED (SELECT rule_id, min(tick) AS tick FROM hot GROUP BY 1)"""
# All rules rest 300 seconds, so a month holds fewer than 2^14 firings of one; jumps double.
CHAIN_SQL = ",\n".join(
    f"""r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} UNION
  SELECT r.rule_id, j.following FROM r{k} r JOIN j{k} j USING (rule_id, tick) WHERE j.following IS NOT NULL),
j{k + 1} AS MATERIALIZED (SELECT a.rule_id, a.tick, b.following FROM j{k} a JOIN j{k} b
  ON b.rule_id = a.rule_id AND b.tick = a.following)"""
    for k in range(14)
)


@query(
    "e10_stream_alerts",
    ev_sql(
        "SELECT rule_id, tick AS fired_at, round(value, 6) AS value FROM r14 JOIN hot USING (rule_id, tick)",
        "counts", "rules", ALERT_MINUTES_SQL, CHAIN_SQL,
    ),
)
def e10_stream(spark, folder):
    """Every full minute of the month evaluated, with cooldowns that span micro-batches."""
    root = _root(spark, "alerting", "events", "counts", "alert_events", "evaluations")
    rules = write_rules(alert_rules(events(spark, folder)), root)

    def run(sent):
        jobs.start_alerting(sent, rules, root, f"{root}/checkpoint").awaitTermination()

    _by_days(spark, folder, root, run, days=10)
    fired = read_table(spark, root, "alert_events")
    return fired.select("rule_id", "fired_at", r6("value").alias("value"))


# Spans of consecutive breaching hours; those that nothing after the watermark can prolong are resolved.
LIFECYCLE_SQL = """hours AS (SELECT source, date_trunc('hour', "timestamp") AS win, count(*) AS errors FROM ev
  WHERE severity IN ('error','fatal') GROUP BY ALL HAVING count(*) >= 2),
numbered AS (SELECT *, sum(st) OVER (PARTITION BY source ORDER BY win) AS span FROM (
  SELECT *, CASE WHEN lag(win) OVER (PARTITION BY source ORDER BY win) + INTERVAL 1 HOUR >= win THEN 0 ELSE 1 END AS st FROM hours)),
spans AS (SELECT source, min(win) AS fired_at, max(win) + INTERVAL 1 HOUR AS resolved_at, CAST(sum(errors) AS BIGINT) AS errors
  FROM numbered WHERE win + INTERVAL 1 HOUR <= (SELECT max("timestamp") - INTERVAL 10 MINUTE FROM ev) GROUP BY source, span),
settled AS (SELECT *, resolved_at + INTERVAL 1 HOUR <= (SELECT max("timestamp") - INTERVAL 10 MINUTE FROM ev) AS done FROM spans)"""


@query(
    "l11_stream_lifecycle",
    ev_sql(
        """SELECT source, fired_at, CASE WHEN done THEN 'resolved' ELSE 'firing' END AS status,
  CASE WHEN done THEN resolved_at END AS resolved_at, CASE WHEN done THEN errors END AS errors FROM settled""",
        LIFECYCLE_SQL,
    ),
)
def l11_stream(spark, folder):
    """Alerts on two errors an hour, fired and resolved by a keyed state over micro-batches and restarts."""
    root = _root(spark, "lifecycle", "lifecycle")

    def run(sent):
        lifecycle.start_lifecycle(sent, root, f"{root}/checkpoint", threshold=2).awaitTermination()

    _by_days(spark, folder, root, run)
    return lifecycle.lifecycle_spans(spark, root)


@query("b9_live_feed", ev_sql("""SELECT event_id, source, "timestamp" FROM ev WHERE severity = 'error'"""))
def b9(spark, folder):
    root = work_folder(spark, "feed")
    jobs.start_live_feed(
        event_stream(spark, folder), f"{root}/feed", f"{root}/checkpoint", severity="error"
    ).awaitTermination()
    feed = spark.read.schema(S.EVENT).parquet(f"{root}/feed")
    return feed.select("event_id", "source", "timestamp")


@query(
    "l19_replay",
    ev_sql("SELECT * FROM counts", "counts"),
)
def l19(spark, folder):
    root = _root(spark, "replay", "events", "counts")
    ev = stored_form(events(spark, folder))
    # Half the events first, then the whole month again: the overlap must not count twice.
    jobs.replay(ev.where(S.is_error(F.col("severity"))), root, 0, "2024-01-01", "2024-02-01")
    jobs.replay(ev, root, 1, "2024-01-01", "2024-02-01")
    return stored_counts(spark, root).drop("event_date")
