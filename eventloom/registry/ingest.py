"""Ingest and dead-letter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas as S
from eventloom.functions.timeops import ts_lit
from eventloom.operators import dlq, health, ingest
from eventloom.registry import ev_sql, query
from eventloom.session import work_folder
from eventloom.sources.canonical import events, flawed, redelivered
from eventloom.sources.store import with_day
from eventloom.streaming import jobs
from eventloom.streaming.tables import create_tables, read_table, write_batch


def _payload():
    """A two-event batch as sent: the event and an echo of it."""

    def one(kind):
        return F.concat(
            F.lit('{"source":"'), "source", F.lit('","event_type":"'), kind,
            F.lit('","severity":"'), "severity", F.lit('","timestamp":"'),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            F.lit('","data":'), "data", F.lit(',"tags":["'), F.array_join("tags", '","'),
            F.lit('"]}'),
        )

    return F.concat(F.lit('{"events":['), one(F.col("event_type")), F.lit(","), one(F.lit("echo")), F.lit("]}"))


@query(
    "a1_read_batches",
    ev_sql(
        """SELECT event_id AS batch, CAST(2 AS INTEGER) AS batch_events, CAST(i AS INTEGER) AS event_index, source,
  CASE WHEN i = 0 THEN event_type ELSE 'echo' END AS event_type, severity, "timestamp", data,
  array_to_string(tags, '|') AS tags
FROM ev, (VALUES (0), (1)) t(i)"""
    ),
)
def a1(spark, folder):
    sent = events(spark, folder).select(F.col("event_id").alias("batch"), _payload().alias("payload"))
    rows = ingest.parse_batches(sent, keep=("batch",))
    return rows.withColumn("tags", F.array_join("tags", "|")).drop("metadata")


@query(
    "a2_validate",
    ev_sql(
        """SELECT event_id, seq % 1500 AS "index", 'source' AS field, 'required' AS message FROM flawed WHERE source = ''
UNION ALL SELECT event_id, seq % 1500, 'severity', 'must be one of: debug, info, warn, error, fatal'
FROM flawed WHERE severity NOT IN ('debug','info','warn','error','fatal')
UNION ALL SELECT event_id, seq % 1500, 'tags', 'must have <= 50 tags' FROM flawed WHERE len(tags) > 50
UNION ALL SELECT event_id, seq % 1500, 'data', 'must be <= 110 bytes' FROM flawed WHERE strlen(data) > 110""",
        "flawed",
    ),
)
def a2(spark, folder):
    checked = ingest.validate(flawed(events(spark, folder)), F.col("seq") % 1500, max_bytes=110)
    return ingest.rejected(checked).select("event_id", "error.*")


@query(
    "a3_severity_domain",
    ev_sql(
        """SELECT severity, severity IN ('debug','info','warn','error','fatal') AS valid, count(*) AS n
FROM flawed GROUP BY ALL""",
        "flawed",
    ),
)
def a3(spark, folder):
    ev = flawed(events(spark, folder))
    return ev.groupBy("severity", S.is_severity(F.col("severity")).alias("valid")).agg(
        F.count("*").alias("n")
    )


BAD_SQL = "(source = '' OR severity = 'critical' OR len(tags) > 50)"


@query(
    "a4_accepted_rows",
    ev_sql(f"""SELECT event_id, source, severity FROM flawed WHERE NOT {BAD_SQL}""", "flawed"),
)
def a4_rows(spark, folder):
    checked = ingest.validate(flawed(events(spark, folder)))
    return ingest.accepted(checked).select("event_id", "source", "severity")


@query(
    "a4_batch_outcome",
    ev_sql(
        f"""SELECT seq // 1500 AS batch_id, count(*) FILTER (NOT {BAD_SQL}) AS accepted,
  count(*) FILTER ({BAD_SQL}) AS rejected, accepted = 0 AS failed FROM flawed GROUP BY 1""",
        "flawed",
    ),
)
def a4_outcome(spark, folder):
    ev = flawed(events(spark, folder)).withColumn("batch_id", F.expr("seq div 1500"))
    return ingest.batch_outcome(ingest.validate(ev), "batch_id")


@query(
    "a5_batch_limits",
    ev_sql(
        """SELECT event_id, seq // 1500 AS batch_id, n AS batch_events,
  CASE WHEN n > 1000 THEN 'too_large' ELSE 'ok' END AS verdict
FROM (SELECT *, count(*) OVER (PARTITION BY seq // 1500) AS n FROM ev)"""
    ),
)
def a5(spark, folder):
    ev = events(spark, folder).select("event_id", F.expr("seq div 1500").alias("batch_id"))
    return ingest.limit_batches(ev, "batch_id")


@query(
    "a6_defaults",
    ev_sql(
        """SELECT event_id, received_at, CASE WHEN seq % 7 = 0 THEN received_at ELSE "timestamp" END AS "timestamp",
  CASE WHEN severity IN ('debug', 'warn') THEN 'info' ELSE severity END AS severity,
  CASE WHEN seq % 5 = 0 THEN '{}' ELSE data END AS data,
  CASE WHEN seq % 3 = 0 THEN '' ELSE array_to_string(tags, '|') END AS tags, '{}' AS metadata FROM ev"""
    ),
)
def a6(spark, folder):
    seq = F.col("seq")
    gaps = events(spark, folder).select(
        "event_id",
        F.when(seq % 7 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(F.col("severity") == "debug", "")
        .when(F.col("severity") != "warn", F.col("severity"))
        .alias("severity"),
        F.when(seq % 5 != 0, F.col("data")).alias("data"),
        F.when(seq % 3 != 0, F.col("tags")).alias("tags"),
        F.lit(None).cast("string").alias("metadata"),
        F.col("received_at").alias("_received"),
    )
    full = ingest.fill_defaults(gaps, F.col("_received")).drop("_received")
    return full.withColumn("tags", F.array_join("tags", "|"))


@query(
    "a7_sortable_id",
    ev_sql(
        """SELECT event_id, printf('%012x', epoch_us(received_at) // 1000)
  || substr(sha256(source || chr(31) || event_type || chr(31) || data), 1, 16) AS sortable_id FROM ev"""
    ),
)
def a7(spark, folder):
    made = ingest.sortable_id(
        F.col("received_at"), F.col("source"), F.col("event_type"), F.col("data")
    )
    return events(spark, folder).select("event_id", made.alias("sortable_id"))


PARTITION_SQL = """CAST(list_reduce(list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT),
  lambda h, c: (h * 31 + c) % 4294967296) % 4 AS INTEGER)"""


@query(
    "a8_source_partition",
    ev_sql(
        f"""SELECT source, {PARTITION_SQL.format("source")} AS partition,
  'events:' || {PARTITION_SQL.format("source")} AS stream, count(*) AS n FROM ev GROUP BY ALL"""
    ),
)
def a8(spark, folder):
    counted = events(spark, folder).groupBy("source").agg(F.count("*").alias("n"))
    partition = ingest.source_partition(F.col("source"))
    return counted.select(
        "source", partition.alias("partition"), ingest.stream_name(partition).alias("stream"), "n"
    )


@query(
    "a9_append_new",
    ev_sql(
        """SELECT event_id, "timestamp", min(received_at) AS received_at, any_value(source) AS source
FROM dup WHERE "timestamp" >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""",
        "dup",
    ),
)
def a9(spark, folder):
    ev = events(spark, folder).select(*S.EVENT_KEY, "received_at", "source", "event_type")
    sent = redelivered(ev)
    stored = with_day(ev.where(F.col("timestamp") < ts_lit("2024-01-10 00:00:00")))
    return ingest.append_new(sent, ingest.on_touched_days(stored, sent)).drop("event_type")


@query(
    "a10_quarantine",
    ev_sql(
        """SELECT event_id, CASE WHEN seq % 11 = 0 THEN substr(data, 2) END AS corrupt,
  CASE WHEN seq % 11 = 0 THEN NULL ELSE json_extract_string(data, '$.status') END AS status FROM ev"""
    ),
)
def a10(spark, folder):
    ev = events(spark, folder)
    broken = F.when(F.col("seq") % 11 == 0, F.expr("substr(data, 2)")).otherwise(F.col("data"))
    parsed = ingest.quarantine(
        ev.select("event_id", broken.alias("payload")), "payload", S.T.StructType().add("status", "string")
    )
    return parsed.select("event_id", F.col("_corrupt_record").alias("corrupt"), "status")


LETTER_AT = "2024-02-02 00:00:00"


def _refused(spark, folder):
    """Work folder after ingest has taken one event a payload, of which a third are flawed."""
    ev = events(spark, folder)
    seq = F.col("seq")
    severity = F.when(seq % 6 == 0, "critical").otherwise(F.col("severity"))
    data = F.concat(F.lit('{"n":'), seq, F.lit("}"))
    fields = F.concat(
        F.lit('{"source":"'), F.when(seq % 12 == 0, "").otherwise(F.col("source")),
        F.lit('","event_type":"'), "event_type", F.lit('","severity":"'), severity,
        F.lit('","timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","data":'), data,
    )
    text = F.when(seq % 6 == 3, F.concat(fields, F.lit(',"tags":"none"}'))).otherwise(F.concat(fields, F.lit("}")))
    root = work_folder(spark, "letters")
    create_tables(spark, root, ("events", "counts", "rejected", "quarantine", "handled"))
    jobs.ingest_batch(ev.select(text.alias("payload"), "received_at"), root, 0, F.col("received_at"))
    return root


LETTERS_SQL = """letters AS (
  SELECT seq, CASE WHEN seq % 6 = 3 THEN 'quarantine' ELSE 'rejected' END AS stream,
    CASE WHEN seq % 6 = 3 THEN 'unreadable' ELSE 'severity must be one of: debug, info, warn, error, fatal'
      || CASE WHEN seq % 12 = 0 THEN '; source required' ELSE '' END END AS reasons, received_at
  FROM ev WHERE seq % 6 IN (0, 3))"""


def _numbered(letters):
    return letters.withColumn("seq", F.regexp_extract("payload", '"n":([0-9]+)', 1).cast("bigint"))


@query(
    "a12_retry_routing",
    ev_sql(
        """SELECT seq, stream, CASE WHEN received_at > TIMESTAMP '2024-01-30' - INTERVAL 30 SECOND THEN 'wait'
  WHEN seq % 24 = 0 THEN 'dlq' ELSE 'retry' END AS route FROM letters""",
        LETTERS_SQL,
    ),
)
def a12(spark, folder):
    root = _refused(spark, folder)
    # Some have been sent again three times, all before their last copy, and came back each time.
    tried = _numbered(jobs.open_letters(spark, root)).where("seq % 24 = 0")
    moments = F.explode(F.array(*(ts_lit(f"2023-12-31 00:0{m}:00").cast("timestamp") for m in range(3))))
    marks = tried.select("id", F.lit("retried").alias("action"), moments.alias("at"))
    write_batch(marks, root, "handled", -1, "at")
    letters = _numbered(jobs.open_letters(spark, root)).join(
        events(spark, folder).select("seq", F.col("received_at").alias("_sent")), "seq"
    )
    idle = F.unix_micros(ts_lit("2024-01-30").cast("timestamp")) - F.unix_micros(F.col("_sent").cast("timestamp"))
    return dlq.route_pending(letters.withColumn("idle_s", idle / 1e6)).select("seq", "stream", "route")


@query(
    "a13_dlq_stats",
    ev_sql(
        """SELECT coalesce(stream, 'total') AS stream, count(*) AS messages
FROM letters GROUP BY ROLLUP (stream)""",
        LETTERS_SQL,
    ),
)
def a13(spark, folder):
    return dlq.stats(jobs.open_letters(spark, _refused(spark, folder)))


@query(
    "a14_dlq_list",
    ev_sql("SELECT seq, stream, reasons, received_at, 1 AS copies FROM letters", LETTERS_SQL),
)
def a14(spark, folder):
    letters = _numbered(jobs.open_letters(spark, _refused(spark, folder)))
    return letters.select("seq", "stream", "reasons", "received_at", "copies")


@query(
    "a14_dlq_page",
    ev_sql(
        """SELECT seq, stream, reasons FROM letters WHERE stream = 'quarantine' ORDER BY received_at, seq LIMIT 50""",
        LETTERS_SQL,
    ),
)
def a14_page(spark, folder):
    letters = _numbered(jobs.open_letters(spark, _refused(spark, folder)))
    return dlq.list_letters(letters, "quarantine", 0, ("received_at", "seq")).select("seq", "stream", "reasons")


@query(
    "a15_dlq_retry",
    ev_sql(
        """SELECT seq, stream, CASE WHEN stream = 'rejected' THEN 1 ELSE 0 END AS attempts FROM letters
UNION ALL SELECT seq, 'events', 0 FROM ev WHERE seq % 6 NOT IN (0, 3)""",
        LETTERS_SQL,
    ),
)
def a15(spark, folder):
    """Rejected letters go through ingest again: as they have not changed, they are refused again."""
    root = _refused(spark, folder)
    chosen = jobs.open_letters(spark, root).where("stream = 'rejected'")
    jobs.handle_letters(chosen, root, -1, "retried", LETTER_AT)
    stored = _numbered(read_table(spark, root, "events").withColumnRenamed("data", "payload"))
    left = _numbered(jobs.open_letters(spark, root)).select("seq", "stream", "attempts")
    return left.unionByName(stored.select("seq", F.lit("events").alias("stream"), F.lit(0).cast("bigint").alias("attempts")))


@query(
    "a16_dlq_purge",
    ev_sql("SELECT seq, stream FROM letters WHERE stream <> 'quarantine'", LETTERS_SQL),
)
def a16(spark, folder):
    root = _refused(spark, folder)
    chosen = jobs.open_letters(spark, root).where("stream = 'quarantine'")
    jobs.handle_letters(chosen, root, -1, "purged", LETTER_AT)
    return _numbered(jobs.open_letters(spark, root)).select("seq", "stream")


@query(
    "a17_partition_calendar",
    ev_sql(
        """SELECT CAST(d.day AS DATE) AS event_date, count(ev.event_id) AS rows, count(ev.event_id) > 0 AS present
FROM generate_series(DATE '2024-01-24', DATE '2024-02-01', INTERVAL 1 DAY) d(day)
LEFT JOIN ev ON CAST(ev."timestamp" AS DATE) = CAST(d.day AS DATE) GROUP BY 1"""
    ),
)
def a17(spark, folder):
    return ingest.partition_calendar(events(spark, folder), "2024-01-25 09:30:00")


def _behind(spark, folder):
    """Events received, and those that were stored when the last third of the month was still to come."""
    ev = events(spark, folder)
    root = work_folder(spark, "backlog")
    create_tables(spark, root, ("events", "counts"))
    stored = ev.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.EVENT.fields))
    jobs.replay(stored, root, 0, "2024-01-01", "2024-01-21", days=30)
    return ingest.backlog(stored, read_table(spark, root, "events"), S.EVENT_KEY)


@query(
    "a18_backlog",
    ev_sql("""SELECT source, count(*) AS depth FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-21' GROUP BY 1"""),
)
def a18(spark, folder):
    return _behind(spark, folder)


@query(
    "a18_backpressure",
    ev_sql(
        """SELECT count(*) AS total, count(*) > 1000 AS reject FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-21'"""
    ),
)
def a18_limit(spark, folder):
    return ingest.backpressure(_behind(spark, folder), limit=1000)


@query(
    "a19_ingest_accounting",
    ev_sql(
        """SELECT source, count(*) AS events, CAST(sum(strlen(data)) AS BIGINT) AS data_bytes
FROM ev GROUP BY 1"""
    ),
)
def a19(spark, folder):
    return ingest.accounting(events(spark, folder))


@query(
    "a19_batch_size_histogram",
    ev_sql(
        """SELECT le, count(*) FILTER (n <= le) AS count
FROM (SELECT user_id, CAST("timestamp" AS DATE) AS day, count(*) AS n FROM ev GROUP BY ALL),
  (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000, 'Infinity'::DOUBLE]) AS le) GROUP BY 1"""
    ),
)
def a19_sizes(spark, folder):
    batches = (
        events(spark, folder)
        .groupBy("user_id", F.to_date("timestamp").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    return health.cumulative_histogram(batches, F.col("n"), S.BATCH_SIZE_BOUNDS)
