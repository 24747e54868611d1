"""Streaming jobs: repeats, late rows, bad payloads and retried batches."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from eventloom.schemas import EVENT
from eventloom.streaming import jobs, lifecycle, tables
from eventloom.streaming.tables import compact, create_tables, expire, read_table, store_events, stored_counts

NOW = dt.datetime(2024, 1, 2, 12)


@pytest.fixture
def root(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    create_tables(spark, path)
    return path


def event_frame(spark, rows):
    full = [(i, "s", "t", v, at, NOW, "{}", [], "{}") for i, v, at in rows]
    return spark.createDataFrame(full, EVENT)


def totals(spark, root):
    return {r.severity: r.n for r in stored_counts(spark, root).groupBy("severity").agg(F.sum("count").alias("n")).collect()}


def test_retried_batch_and_redelivery_count_once(spark, root):
    first = event_frame(spark, [("a", "info", NOW), ("b", "error", NOW)])
    store_events(first, root, 0)
    store_events(first, root, 0)
    store_events(first.unionByName(event_frame(spark, [("c", "info", NOW)])), root, 1)
    assert totals(spark, root) == {"info": 2, "error": 1}
    assert read_table(spark, root, "events").count() == 3


def test_late_events_count_whenever_they_come(spark, root):
    store_events(event_frame(spark, [("a", "info", NOW)]), root, 0)
    store_events(event_frame(spark, [("b", "info", NOW - dt.timedelta(days=40))]), root, 1)
    assert totals(spark, root) == {"info": 2}


def test_files_arriving_in_steps(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    for step in range(3):
        rows = [(f"{step}-{i}", "info", NOW + dt.timedelta(minutes=i)) for i in range(20)] + [("same", "error", NOW)]
        event_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.start_processing(stream, root, f"{tmp_path}/checkpoint").awaitTermination()
    assert totals(spark, root) == {"info": 60, "error": 1}


def test_json_ingest_keeps_every_outcome(spark, root, tmp_path):
    folder = tmp_path / "json"
    os.makedirs(folder)
    good = {"source": "s", "event_type": "t", "timestamp": "2024-01-02T12:00:00Z", "data": {"x": 1}}
    lines = [
        json.dumps({"events": [good, {**good, "severity": "error"}]}),
        json.dumps(good),
        json.dumps({"events": [{**good, "source": ""}]}),
        json.dumps({"events": []}),
        json.dumps({"events": [good] * 1001}),
        '{"events": [{"source"',
        '{"foo": 1}',
        '{"events": "x"}',
        json.dumps([{**good, "timestamp": "nonsense"}, {**good, "tags": "notalist"}]),
    ]
    (folder / "a.txt").write_text("\n".join(lines))
    stream = spark.readStream.schema("value string").text(str(folder)).select(F.col("value").alias("payload"))
    jobs.start_ingest(
        stream, root, f"{tmp_path}/checkpoint", F.lit("2024-01-02 12:00:05").cast("timestamp")
    ).awaitTermination()
    # The single object and the first event of the large batch repeat that of the first batch.
    assert totals(spark, root) == {"info": 1001, "error": 1}
    refused = [(r.field, r.message, json.loads(r.payload)) for r in read_table(spark, root, "rejected").collect()]
    assert refused == [("source", "required", {**good, "source": ""})]
    quarantined = {r.payload for r in read_table(spark, root, "quarantine").collect()}
    assert quarantined == {*lines[3:4], *lines[5:8], json.dumps({**good, "timestamp": "nonsense"}, separators=(",", ":")), json.dumps({**good, "tags": "notalist"}, separators=(",", ":"))}


def test_running_counts_follow_updates(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    for step in range(2):
        event_frame(spark, [(f"{step}", "info", NOW - dt.timedelta(days=0)), (f"{step}l", "info", NOW - dt.timedelta(days=9))]).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENT).parquet(folder)
        jobs.start_counts(stream, root, f"{tmp_path}/checkpoint").awaitTermination()
    assert [r["count"] for r in jobs.running_counts(spark, root).collect()] == [2, 2]


def test_alert_runs_respect_cooldown(spark, root):
    from tests.test_monitoring import RULE, counts_frame, rule

    counts = counts_frame(spark, [(NOW + dt.timedelta(minutes=i), "a", "error", 2) for i in range(-2, 12)])
    rules = spark.createDataFrame([rule("r", window="1m")], RULE)
    for run in range(10):
        at = NOW + dt.timedelta(minutes=run)
        jobs.evaluate_once(rules, counts, root, run, at)
        jobs.evaluate_once(rules, counts, root, run, at)
    fired = sorted(r.fired_at for r in read_table(spark, root, "alert_events").collect())
    assert fired == [NOW, NOW + dt.timedelta(minutes=5)]


def test_missing_times_come_from_the_stream(spark, root, tmp_path):
    folder = f"{tmp_path}/in"
    rows = spark.createDataFrame([("a", "s", "t", None, None, None, None, None, None)], EVENT)
    rows.write.parquet(folder)
    stream = spark.readStream.schema(EVENT).parquet(folder)
    jobs.start_processing(stream, root, f"{tmp_path}/checkpoint").awaitTermination()
    stored = read_table(spark, root, "events").first()
    assert stored.received_at == stored.timestamp and stored.received_at is not None
    assert (stored.severity, stored.data, stored.tags) == ("info", "{}", [])


def test_minutes_in_one_job_equal_single_evaluations(spark, root):
    from tests.test_monitoring import RULE, counts_frame, rule

    first = NOW - dt.timedelta(minutes=3)
    counts = counts_frame(spark, [(NOW + dt.timedelta(minutes=i), "ab"[i % 2], ["error", "info"][i % 3 == 0], 1 + i % 4) for i in range(-2, 9, 2)])
    kinds = [rule("r", window="1m"), rule("s", window="5m", metric="event_count", operator="<=", threshold=1.0), rule("u", window="15m", metric="nonsense")]
    rules = spark.createDataFrame(kinds, RULE)
    create_tables(spark, f"{root}-one")
    for run in range(14):
        jobs.evaluate_once(rules, counts, f"{root}-one", run, first + dt.timedelta(minutes=run))
    none = read_table(spark, root, "alert_events")
    from eventloom.operators import alerts

    got = alerts.evaluate_minutes(rules, counts, none, first=first, last=first + dt.timedelta(minutes=13))
    columns = ["alert_event_id", "rule_id", "fired_at", "value", "context"]
    want = read_table(spark, f"{root}-one", "alert_events")
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()) != []


def test_rules_on_silence_fire_by_the_clock(spark, root, tmp_path):
    from tests.test_monitoring import RULE, rule

    silent = [rule("quiet", window="1m", metric="event_count", operator="<=", threshold=0.0)]
    rules = spark.createDataFrame(silent, RULE)
    folder = f"{tmp_path}/ticks"
    for minute in (0, 7):
        tick = spark.createDataFrame([(NOW + dt.timedelta(minutes=minute, seconds=30),)], "timestamp timestamp")
        tick.write.mode("append").parquet(folder)
        ticks = spark.readStream.schema("timestamp timestamp").parquet(folder)
        jobs.start_alert_clock(rules, root, f"{tmp_path}/checkpoint", ticks, interval=None).awaitTermination()
    fired = sorted(r.fired_at for r in read_table(spark, root, "alert_events").collect())
    assert fired == [NOW, NOW + dt.timedelta(minutes=5)]


def test_compaction_keeps_rows_and_late_batches(spark, root):
    for batch in range(3):
        store_events(event_frame(spark, [(f"{batch}", "info", NOW), (f"{batch}n", "error", NOW + dt.timedelta(days=1))]), root, batch)
    for name in ("events", "counts"):
        compact(spark, root, name, dt.date(2024, 1, 3))
    folders = lambda day: len(os.listdir(f"{root.removeprefix('file://')}/events/event_date={day}"))
    assert (folders("2024-01-02"), folders("2024-01-03")) == (1, 3)
    assert totals(spark, root) == {"info": 3, "error": 3}
    # A batch that is run again and a late one: neither counts twice nor is lost.
    store_events(event_frame(spark, [("2", "info", NOW), ("2n", "error", NOW + dt.timedelta(days=1))]), root, 2)
    store_events(event_frame(spark, [("late", "info", NOW)]), root, 3)
    compact(spark, root, "events", dt.date(2024, 1, 3))
    assert totals(spark, root) == {"info": 4, "error": 3}
    assert read_table(spark, root, "events").count() == 7
    assert expire(spark, root, "events", "2024-02-02") == [dt.date(2024, 1, 2)]
    assert read_table(spark, root, "events").count() == 3


def test_letters_are_retried_and_purged(spark, root):
    good = '{"source":"s","event_type":"t","timestamp":"2024-01-02T00:00:00Z"}'
    sent = [(good,), ('{"source":"","event_type":"t"}',), ("oops",), ("oops",), ('{"foo":1}',)]
    payloads = spark.createDataFrame(sent, "payload string")
    jobs.ingest_batch(payloads, root, 0, F.lit(str(NOW)))
    letters = jobs.open_letters(spark, root)
    assert sorted((r.stream, r.copies, r.attempts) for r in letters.collect()) == [
        ("quarantine", 1, 0), ("quarantine", 2, 0), ("rejected", 1, 0),
    ]
    later = NOW + dt.timedelta(hours=1)
    jobs.handle_letters(jobs.open_letters(spark, root).where("stream = 'quarantine'"), root, -1, "purged", later)
    jobs.handle_letters(jobs.open_letters(spark, root), root, -2, "retried", later)
    assert [(r.stream, r.attempts) for r in jobs.open_letters(spark, root).collect()] == [("rejected", 1)]
    with pytest.raises(ValueError, match="unknown action"):
        jobs.handle_letters(letters, root, -3, "lost", later)


def _drain(stream, root, checkpoint, **how):
    jobs.start_processing(stream, root, checkpoint, **how).awaitTermination()


def test_recent_events_are_deduplicated_without_reading_stored_ones(spark, root, tmp_path, monkeypatch):
    """Live events: copies within a batch, across batches and across restarts; no stored day is looked at."""
    looked = []
    monkeypatch.setattr(tables, "read_days", lambda s, r, n, days, read=tables.read_days: read(s, r, n, looked.append(list(days)) or looked[-1]))
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    folder = f"{tmp_path}/live"
    for step in range(3):
        rows = [(f"{step}-{i}", "info", now - dt.timedelta(seconds=i)) for i in range(20)]
        rows += [("again", "error", now - dt.timedelta(minutes=3)), *rows[:4]]
        event_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        _drain(spark.readStream.schema(EVENT).parquet(folder), root, f"{tmp_path}/cp")
    assert totals(spark, root) == {"info": 60, "error": 1}
    assert looked and not any(looked)


def test_old_and_future_events_are_looked_up_on_their_days_alone(spark, root, tmp_path, monkeypatch):
    """An event of 1970 costs the folder of that day; nothing is lost or doubled, with a fresh state either."""
    looked = []
    monkeypatch.setattr(tables, "read_days", lambda s, r, n, days, read=tables.read_days: read(s, r, n, looked.append(sorted(days)) or looked[-1]))
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    old, ahead = dt.datetime(1970, 1, 1, 5), now + dt.timedelta(days=3)
    rows = [("a", "info", now), ("b", "info", old), ("c", "warn", NOW), ("d", "warn", ahead), ("e", "fatal", now)]
    event_frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    for run, horizon in enumerate(["1 hour", "0 seconds", "0 seconds"]):
        _drain(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/cp{run}", horizon=horizon)
    assert totals(spark, root) == {"info": 2, "warn": 2, "fatal": 1}
    assert looked[0] == sorted({old.date(), NOW.date(), ahead.date()})
    assert all(set(days) == {old.date(), NOW.date(), ahead.date(), now.date()} for days in looked[1:])


def test_a_batch_that_runs_again_keeps_sure_and_unsure_rows(spark, root):
    rows = event_frame(spark, [("a", "info", NOW), ("b", "error", NOW)])
    for _ in range(2):
        store_events(rows, root, 5, F.col("event_id") == "a")
    store_events(event_frame(spark, [("a", "info", NOW), ("x", "warn", NOW)]), root, 6, F.lit(True))
    assert totals(spark, root) == {"info": 1, "error": 1, "warn": 1}
    store_events(rows.limit(0), root, 7)
    assert read_table(spark, root, "events").count() == 3


def test_lifecycle_resolves_on_silence_and_across_restarts(spark, root, tmp_path):
    """Fires when a window breaches, goes on over breaching windows, resolves by timer, late rows don't reopen it."""
    hour = dt.timedelta(hours=1)
    steps = [
        [(0, "error"), (1, "fatal"), (2, "info")],  # a breach in the first hour
        [(60, "error"), (61, "error"), (62, "info")],  # which the second prolongs
        [(250, "info")],  # only calm events move the watermark on
        [(3, "error"), (4, "error"), (300, "error"), (301, "error")],  # two too late; a new breach
        [(315, "info")],
    ]
    seen = []
    for k, step in enumerate(steps):
        rows = [(f"{k}-{i}", severity, NOW + dt.timedelta(minutes=m)) for i, (m, severity) in enumerate(step)]
        event_frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        lifecycle.start_lifecycle(stream, root, f"{tmp_path}/cp", threshold=2, delay="5 minutes").awaitTermination()
        seen.append(sorted((r["fired_at"], r["status"], r["resolved_at"], r["errors"]) for r in lifecycle.lifecycle_spans(spark, root).collect()))
    assert seen[0] == []
    assert seen[1] == [] or seen[1][0][:2] == (NOW, "firing")
    assert seen[2] == [(NOW, "resolved", NOW + 2 * hour, 4)]
    assert seen[3] == seen[2]
    event_frame(spark, [("z", "info", NOW + dt.timedelta(minutes=366))]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    lifecycle.start_lifecycle(stream, root, f"{tmp_path}/cp", threshold=2, delay="5 minutes").awaitTermination()
    got = lifecycle.lifecycle_spans(spark, root).collect()
    assert sorted(r["status"] for r in got) == ["firing", "resolved"]
    assert max(r["fired_at"] for r in got) == NOW + 5 * hour


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield 40
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _states(checkpoint):
    return [len([d for d in os.listdir(f"{checkpoint}/state/{op}") if d.isdigit()]) for op in os.listdir(f"{checkpoint}/state")]


def test_state_partitions_follow_cores_not_shuffles(spark, root, tmp_path, many_partitions):
    rows = [(str(i), "error", NOW + dt.timedelta(minutes=i)) for i in range(30)]
    event_frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
    _drain(stream(), root, f"{tmp_path}/cp")
    lifecycle.start_lifecycle(stream(), root, f"{tmp_path}/cp-alerts", threshold=2).awaitTermination()
    jobs.start_batches(jobs.once_within(stream(), "1 hour"), lambda batch, _: batch.collect(), f"{tmp_path}/cp-3", None, partitions=3).awaitTermination()
    assert _states(f"{tmp_path}/cp") == [8]
    assert _states(f"{tmp_path}/cp-alerts") == [8, 8]
    assert _states(f"{tmp_path}/cp-3") == [3]
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(many_partitions)
    assert totals(spark, root) == {"error": 30}


def test_batches_are_written_by_size(spark, root, tmp_path, monkeypatch, many_partitions):
    """In a stream as in a replay, rows to be written lie in as many parts as they fill, not one per shuffle partition."""
    seen = []

    def spy(df, at, name, *args, write=tables.write_batch, **how):
        seen.append((df.sparkSession.conf.get("spark.sql.adaptive.enabled"), df.rdd.getNumPartitions()))
        write(df, at, name, *args, **how)

    monkeypatch.setattr(tables, "write_batch", spy)
    rows = event_frame(spark, [(str(i), "info", NOW + dt.timedelta(hours=i)) for i in range(72)])
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.replay(rows, root, 0, "2024-01-01", "2024-01-04")
    _drain(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), root, f"{tmp_path}/cp")
    assert len(seen) == 4 and all(adaptive == "true" and parts <= 8 for adaptive, parts in seen)
    assert totals(spark, root) == {"info": 72}


def test_compacted_days_come_in_several_batches(spark, tmp_path, monkeypatch):
    """The query that counts again after compaction has something to compact on every day."""
    from eventloom.registry import streams
    from eventloom.sources.canonical import RAW_EVENTS

    found = {}

    def spy(session, root, name, before, compact=tables.compact):
        batches = lambda: {d: len(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("event_date=")}
        path = f"{root}/{name}".removeprefix("file://")
        many = batches()
        compact(session, root, name, before)
        found[name] = many, batches()

    monkeypatch.setattr(streams, "compact", spy)
    kinds = ("click", "purchase", "error")
    rows = [(i, dt.datetime(2024, 1, 1 + i // 20, i % 20), i % 9, kinds[i % 3], 1.0, "{}") for i in range(30 * 20)]
    spark.createDataFrame(rows, RAW_EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = streams.a11_compacted(spark, str(tmp_path)).groupBy("part").agg(F.sum("count").alias("n")).collect()
    assert {r["part"]: r["n"] for r in got} == {"events": 600, "counts": 600}
    for many, after in found.values():
        assert len(many) == 30 and set(many.values()) == {2}
        assert {d: n for d, n in after.items() if d < "event_date=2024-01-25"} == dict.fromkeys(sorted(many)[:24], 1)


def test_batches_are_not_held_in_memory(spark, root, tmp_path, monkeypatch):
    """Rows that several steps read lie in files while the batch lasts, in ingest as in a stream; nothing is cached."""
    held, folder = [], f"{root.removeprefix('file://')}/_staged"

    def spy(df, at, name, *args, write=tables.write_batch, **how):
        held.append((name, df.sparkSession._jsc.sc().getPersistentRDDs().size(), sorted(os.listdir(folder))))
        write(df, at, name, *args, **how)

    before = spark._jsc.sc().getPersistentRDDs().size()
    monkeypatch.setattr(tables, "write_batch", spy)
    monkeypatch.setattr(jobs, "write_batch", spy)
    good = '{"source":"s","event_type":"t","timestamp":"2024-01-02T00:00:00Z","data":{"n":%d}}'
    sent = spark.createDataFrame([(good % i,) for i in range(9)] + [('{"source":""}',), ("oops",)], "payload string")
    event_frame(spark, [("left", "info", NOW)]).write.parquet(f"{root}/_staged/sent-4")  # of a run that broke off
    for _ in range(2):
        jobs.ingest_batch(sent, root, 4, F.lit(str(NOW)))
    assert [h for h in held[:4]] == [
        ("events", before, ["fresh-4", "rows-4", "sent-4"]), ("counts", before, ["fresh-4", "rows-4", "sent-4"]),
        ("rejected", before, ["sent-4"]), ("quarantine", before, ["sent-4"]),
    ]
    assert held[4:] == held[:4] and os.listdir(folder) == []
    sizes = {name: read_table(spark, root, name).count() for name in ("events", "rejected", "quarantine")}
    assert sizes == {"events": 9, "rejected": 2, "quarantine": 1}
