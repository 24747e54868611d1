"""Structured Streaming jobs: ingest, running counts, alerting, live feed and replay."""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom import schemas as S
from eventloom.functions.timeops import as_datetime, epoch_seconds, ts_lit
from eventloom.operators import alerts, dlq, ingest
from eventloom.operators.rollup import minute_counts
from eventloom.plans.pruning import between
from eventloom.streaming.state import batch_settings, keep_state, state_partitions
from eventloom.streaming.tables import (
    read_table,
    staged,
    store_events,
    stored_counts,
    write_batch,
)


def start_batches(
    stream: DataFrame, step, checkpoint: str, interval: str | None, mode: str = "append", partitions: int | None = None
) -> StreamingQuery:
    """Run `step(batch, id)` per micro-batch; without an interval, drain the input and stop."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with state_partitions(stream.sparkSession, partitions) as usual:

        def run(batch: DataFrame, batch_id: int) -> None:
            with batch_settings(batch.sparkSession, usual):
                step(batch, batch_id)

        return (
            stream.writeStream.outputMode(mode)
            .foreachBatch(run)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


def _received(events: DataFrame) -> DataFrame:
    """Fill in the receive time inside the stream, where a repeated batch keeps its clock."""
    return events.withColumn("received_at", F.coalesce("received_at", F.current_timestamp()))


def _completed(events: DataFrame) -> DataFrame:
    return ingest.fill_defaults(_received(events), F.col("received_at"))


def once_within(events: DataFrame, horizon: str, arrived: Column | None = None) -> DataFrame:
    """Each event key once within `horizon` of its arrival, by keyed state; adds `_arrived` and `_unsure`.

    The watermark runs on the arrival, by default the clock of the micro-batch, which a repeated batch
    keeps and which never falls: no event is late to it, whatever its own time, so none is dropped for that. An event that
    happened within `horizon` before this arrival cannot have come before the state reaches back to, and
    is new for sure. Older ones are `_unsure` and must be looked up among the stored events; so are those dated ahead
    of their arrival. A given `arrived` must not fall by more than `horizon` from batch to batch.
    """
    keep_state(events.sparkSession)
    arrived = F.current_timestamp() if arrived is None else arrived
    once = (
        events.withColumn("_arrived", arrived.cast("timestamp"))
        .withWatermark("_arrived", horizon)
        .dropDuplicatesWithinWatermark(S.EVENT_KEY)
    )
    reach = F.col("_arrived") - F.expr(f"interval {horizon}")
    recent = (F.col("timestamp") > reach) & (F.col("timestamp") <= F.col("_arrived"))
    return once.withColumn("_unsure", ~recent)


def start_processing(
    events: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = None,
    horizon: str = "1 hour",
    arrived: Column | None = None,
) -> StreamingQuery:
    """Complete, deduplicate, store and count a stream of events that already have ids.

    Copies that come within `horizon` are dropped by the query's state (`once_within`), and only older events are
    looked up in the days they belong to. The checkpoint takes the place of acknowledgements: a batch is
    done once its tables are written, and a batch that is run again replaces what it wrote. Checkpoint and tables
    belong together: with a new checkpoint start once with the horizon "0 seconds", so that every event is looked up.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store_events(batch, root, batch_id, F.col("_unsure"))

    return start_batches(once_within(_completed(events), horizon, arrived), step, checkpoint, interval)


def start_ingest(
    payloads: DataFrame,
    root: str,
    checkpoint: str,
    received_at: Column,
    interval: str | None = None,
) -> StreamingQuery:
    """JSON payloads (column `payload`) to stored events, rejected events and quarantine.

    Nothing that was sent is lost: batches of any size are taken, `rejected` keeps the JSON of
    each event that fails a check (once per problem), and `quarantine` payloads without events and events with
    fields of a wrong type.
    `received_at` must be a function of the input row, such as the file time, so that a
    repeated batch derives the same event ids.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, received_at)

    return start_batches(payloads, step, checkpoint, interval)


def ingest_batch(payloads: DataFrame, root: str, batch_id: int, received_at: Column) -> None:
    """One batch of `start_ingest`; run again under its id, it replaces what it wrote."""
    arrived = payloads.withColumn("_received", received_at.cast("timestamp"))
    typed = ingest.typed_events(ingest.split_payloads(arrived, keep=("_received",)))
    with staged(typed, root, "sent", batch_id) as events:
        readable = F.col("event_index").isNotNull() & (F.size("unreadable") == 0)
        checked = ingest.validate(events.where(readable), F.col("event_index"))
        full = ingest.fill_defaults(ingest.accepted(checked), F.col("_received"))
        identity = [
            F.col("source"), F.col("event_type"), F.col("severity"), F.col("timestamp").cast("string"),
            F.col("data"), F.to_json("tags"), F.col("metadata"), F.col("event_index").cast("string"),
        ]
        keyed = full.withColumn("event_id", ingest.sortable_id(F.col("received_at"), *identity))
        store_events(keyed, root, batch_id)
        bad = ingest.rejected(checked).select(
            "source", "event_type", F.col("_received").alias("received_at"), "error.*",
            F.col("sent").alias("payload"),
        )
        write_batch(bad, root, "rejected", batch_id, "received_at")
        broken = events.where(~readable).select(
            F.col("sent").alias("payload"), F.col("_received").alias("received_at")
        )
        write_batch(broken, root, "quarantine", batch_id, "received_at")


def open_letters(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters that were neither purged nor sent again since they last came."""
    names = ("rejected", "quarantine", "handled")
    return dlq.open_letters(*(read_table(spark, root, name) for name in names))


def handle_letters(letters: DataFrame, root: str, run_id: int, action: str, at: datetime | str) -> None:
    """Record that letters were `retried` or `purged`; a retry also takes their payloads in again.

    `run_id` names the run and must not be that of a batch; negative ones never are. What
    is refused once more comes back as the same letter with one more try.
    """
    if action not in ("retried", "purged"):
        raise ValueError(f"unknown action: {action}")
    moment = ts_lit(at).cast("timestamp")
    # Put down first, as ingest changes the tables that open letters are read from.
    chosen = f"{root}/_handling/run={run_id}"
    letters.select("id", "payload").write.mode("overwrite").parquet(chosen)
    done = letters.sparkSession.read.schema("id string, payload string").parquet(chosen)
    # Marked last: a run that breaks off leaves them open and, run again, replaces itself.
    if action == "retried":
        ingest_batch(done.select("payload"), root, run_id, moment)
    marks = done.select("id", F.lit(action).alias("action"), moment.alias("at"))
    write_batch(marks, root, "handled", run_id, "at")


def start_counts(
    events: DataFrame, root: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Running minute counts: each batch writes what it adds to its windows.

    No state is kept, so an event counts however late it comes.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(minute_counts(batch), root, "latest_counts", batch_id, "bucket")

    return start_batches(events, step, checkpoint, interval)


def running_counts(spark: SparkSession, root: str) -> DataFrame:
    """The total of each window over what `start_counts` has written."""
    added = read_table(spark, root, "latest_counts")
    return added.groupBy(*S.COUNT_KEY).agg(F.sum("count").alias("count"))


def evaluate_once(
    rules: DataFrame, counts: DataFrame, root: str, run_id: int, as_of: datetime | str
) -> None:
    """Evaluate all rules at one moment and store what fires under the run's own partition."""
    past = _recent_alerts(rules, root, run_id, as_of)
    fired = alerts.evaluate_rules(rules, counts, past, as_of=as_of)
    write_batch(fired, root, "alert_events", run_id, "fired_at")


def start_alerting(
    events: DataFrame,
    rules: DataFrame,
    root: str,
    checkpoint: str,
    interval: str | None = None,
    horizon: str = "1 hour",
    arrived: Column | None = None,
) -> StreamingQuery:
    """Store each batch of events, then evaluate the rules at every full minute up to its newest.

    Events are deduplicated as by `start_processing`. Minutes follow on those evaluated before; late events do not
    change what was decided then.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store_events(batch, root, batch_id, F.col("_unsure"))
        spark = batch.sparkSession
        mine = read_table(spark, root, "counts").where(F.col("batch_id") == batch_id)
        seconds = epoch_seconds(F.col("bucket"))
        span = mine.agg(F.min(seconds).alias("oldest"), F.max(seconds).alias("newest")).first()
        if span.newest is not None:
            evaluate_until(rules, root, batch_id, _moment(span.newest), since=_moment(span.oldest))

    return start_batches(once_within(_completed(events), horizon, arrived), step, checkpoint, interval)


def _moment(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def _recent_alerts(rules: DataFrame, root: str, run_id: int, as_of: datetime | str) -> DataFrame:
    """Alerts of other runs, as far back as the longest cooldown reaches."""
    longest = rules.agg(F.max("cooldown_seconds")).first()[0] or 0
    past = read_table(rules.sparkSession, root, "alert_events").where(F.col("batch_id") != run_id)
    return between(past, as_datetime(as_of) - timedelta(seconds=int(longest)), None, "fired_at")


def evaluate_until(
    rules: DataFrame, root: str, run_id: int, until: datetime | str, since: datetime | str | None = None
) -> None:
    """Evaluate the rules at each full minute after the last one that was, up to `until`.

    `since` is where the very first run begins. The run's alerts and its last minute are
    stored under `run_id`, so a repeated run replaces itself.
    """
    spark = rules.sparkSession
    others = read_table(spark, root, "evaluations").where(F.col("batch_id") != run_id)
    done = others.agg(F.max(epoch_seconds(F.col("until")))).first()[0]
    last = as_datetime(until).replace(second=0, microsecond=0)
    if done is not None:
        first = _moment(done) + timedelta(minutes=1)
    else:
        first = as_datetime(since or last).replace(second=0, microsecond=0)
    if first > last:
        return
    past = _recent_alerts(rules, root, run_id, first)
    fired = alerts.evaluate_minutes(rules, stored_counts(spark, root), past, first=first, last=last)
    write_batch(fired, root, "alert_events", run_id, "fired_at")
    mark = spark.range(1).select(ts_lit(last).cast("timestamp").alias("until"))
    write_batch(mark, root, "evaluations", run_id, "until")


def start_alert_clock(
    rules: DataFrame,
    root: str,
    checkpoint: str,
    ticks: DataFrame | None = None,
    interval: str | None = "1 minute",
) -> StreamingQuery:
    """Evaluate the rules up to the present minute, also when no events come.

    `ticks` is a stream with a `timestamp`, by default one row a second. Let either this or
    `start_alerting` evaluate, not both at a time; with this, store events by
    `start_processing` or `start_ingest`.
    """
    spark = rules.sparkSession
    if ticks is None:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max(epoch_seconds(F.col("timestamp")))).first()[0]
        if now is not None:
            evaluate_until(rules, root, -1 - batch_id, _moment(now))

    return start_batches(ticks, step, checkpoint, interval)


def start_live_feed(
    events: DataFrame,
    target: str,
    checkpoint: str,
    severity: str | None = None,
    source: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Matching events as they arrive, to a Parquet folder subscribers read."""
    if severity:
        events = events.where(F.col("severity") == severity)
    if source:
        events = events.where(F.col("source") == source)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        events.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def replay(
    events: DataFrame,
    root: str,
    batch_id: int,
    start: datetime | str,
    end: datetime | str,
    days: int = 7,
) -> None:
    """Send a time range through storing and counting again; stored events stay single.

    `batch_id` names the replay, so running it twice is the same as once. `days` at a time are
    taken, whole days each, so that a long range needs no more room than a short one.
    """
    begin, end = as_datetime(start), as_datetime(end)
    while begin < end:
        upto = min(end, datetime.combine(begin, time()) + timedelta(days=days))
        store_events(between(events, begin, upto), root, batch_id)
        begin = upto

