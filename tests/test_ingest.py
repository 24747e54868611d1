import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import dlq, ingest
from eventloom.schemas import is_severity

FIELDS = "source string, event_type string, severity string, data string, tags array<string>"


def problems(spark, *row, max_bytes=1_048_576):
    df = spark.createDataFrame([row], FIELDS)
    found = ingest.rejected(ingest.validate(df, max_bytes=max_bytes)).select("error.field").collect()
    return [r.field for r in found]


def test_validation_cases(spark):
    assert problems(spark, "s", "t", "error", "{}", ["a"]) == []
    assert problems(spark, "s", "t", None, None, None) == []
    assert problems(spark, "s", "t", "", "{}", []) == []
    assert problems(spark, "", "t", "error", "{}", []) == ["source"]
    assert problems(spark, None, "t", "error", "{}", []) == ["source"]
    assert problems(spark, "s", "", "error", "{}", []) == ["event_type"]
    assert problems(spark, "s", "t", "critical", "{}", []) == ["severity"]
    assert problems(spark, "s", "t", "error", "x" * 100, [], max_bytes=50) == ["data"]
    assert problems(spark, "s", "t", "error", "{}", ["t"] * 51) == ["tags"]
    assert problems(spark, "s", "t", "error", "{}", ["t"] * 50) == []
    assert problems(spark, "", "", "bad", "{}", ["t"] * 51) == [
        "source", "event_type", "severity", "tags",
    ]


def test_name_length_counts_bytes(spark):
    assert problems(spark, "é" * 128, "t", "info", "{}", []) == []
    assert problems(spark, "é" * 129, "t", "info", "{}", []) == ["source"]


def test_severity_domain(spark):
    values = ["debug", "info", "warn", "error", "fatal", "critical", "unknown", "", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.ok for r in df.select(is_severity(F.col("s")).alias("ok")).collect()]
    assert got == [True] * 5 + [False] * 4


def payload_rows(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    return ingest.decode_batches(df, keep=("payload",))


def test_payload_shapes(spark):
    one = '{"source":"a","event_type":"t","data":{"x":1}}'
    texts = [one, f"[{one},{one}]", f'{{"events":[{one}]}}', '{"events":[]}', "{oops", "{}"]
    batches = payload_rows(spark, *texts)
    assert [r.batch_events for r in batches.collect()] == [1, 2, 1, 0, 0, 0]
    rows = ingest.explode_batches(batches).collect()
    assert [(r.event_index, r.source, r.data) for r in rows] == [
        (0, "a", '{"x":1}'), (0, "a", '{"x":1}'), (1, "a", '{"x":1}'), (0, "a", '{"x":1}'),
    ]


def test_batch_verdicts(spark):
    df = spark.createDataFrame([(0,), (None,), (1,), (1000,), (1001,)], "n int")
    got = [r.verdict for r in ingest.batch_verdicts(df, F.col("n")).collect()]
    assert got == ["empty", "empty", "ok", "ok", "too_large"]


def test_hot_batch_is_too_large_for_every_row(spark):
    df = spark.range(3000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("b")
    )
    got = ingest.limit_batches(df, "b").groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"too_large": 1500, "ok": 1500}


def test_outcome_fails_only_when_nothing_passes(spark):
    rows = [(1, "", "t"), (1, "s", "t"), (2, "", "t"), (2, "s", "")]
    df = spark.createDataFrame(rows, "b int, source string, event_type string")
    full = df.selectExpr("*", "'info' severity", "'{}' data", "array('x') tags")
    got = {r.b: (r.accepted, r.rejected, r.failed) for r in ingest.batch_outcome(ingest.validate(full), "b").collect()}
    assert got == {1: (1, 1, False), 2: (0, 2, True)}


def reference_hash(text, n):
    value = 0
    for c in text:
        value = (value * 31 + ord(c)) & 0xFFFFFFFF
    return value % n


def test_source_partition(spark):
    names = ["", "a", "payment-service", "é", "日本語", "user😀x", "x" * 200]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for n in (1, 4, 7):
        got = [r.p for r in df.select(ingest.source_partition(F.col("s"), n).alias("p")).collect()]
        assert got == [reference_hash(name, n) for name in names]


def test_sortable_ids_sort_by_time_and_repeat(spark):
    times = [dt.datetime(2024, 1, 1, 0, 0, 0, 1000 * i) for i in range(3)]
    df = spark.createDataFrame([(t, "s") for t in times] * 2, "at timestamp, c string")
    ids = [r.i for r in df.select(ingest.sortable_id(F.col("at"), F.col("c")).alias("i")).collect()]
    assert ids[:3] == ids[3:] == sorted(ids[:3]) and {len(i) for i in ids} == {28}


def test_append_skips_stored_and_repeated(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "event_id string, timestamp timestamp, received_at timestamp, v int"
    stored = spark.createDataFrame([("a", t, t, 0)], schema)
    later = t + dt.timedelta(seconds=9)
    sent = spark.createDataFrame(
        [("a", t, later, 1), ("a", later, later, 2), ("b", t, later, 3), ("b", t, t, 4)], schema
    )
    got = sorted((r.event_id, r.v) for r in ingest.append_new(sent, stored).collect())
    assert got == [("a", 2), ("b", 4)]


def test_defaults(spark):
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    df = spark.createDataFrame(
        [(None, None, None, None, None), (dt.datetime(2024, 1, 1), "warn", "{}", ["x"], "{}")],
        "timestamp timestamp, severity string, data string, tags array<string>, metadata string",
    )
    first, second = ingest.fill_defaults(df, now).collect()
    assert (first.severity, first.data, first.tags, first.metadata) == ("info", "{}", [], "{}")
    assert first.timestamp == first.received_at == dt.datetime(2024, 5, 1, 10)
    assert second.severity == "warn" and second.timestamp == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("attempts", "idle", "route"),
    [(0, 29, "wait"), (9, 29, "wait"), (2, 30, "retry"), (3, 30, "dlq"), (0, 30, "retry")],
)
def test_retry_routing(spark, attempts, idle, route):
    df = spark.createDataFrame([(attempts, idle)], "attempts int, idle_s int")
    assert dlq.route_pending(df).first().route == route


def test_backpressure_on_empty_queue(spark):
    depth = spark.createDataFrame([], "source string, depth bigint")
    assert ingest.backpressure(depth).first() == (0, False)


@pytest.mark.parametrize(
    "field,value",
    [(f, v) for f in ("source", "event_type", "severity", "timestamp") for v in (5, 1.5, True, ["x"], {"a": "b"}, [])]
    + [("tags", v) for v in (5, "x", {"a": "b"}, [1], ["a", 1], [["a"]], [None, 2])] + [("timestamp", "nonsense")],
)
def test_fields_of_a_wrong_type_are_unreadable(spark, field, value):
    good = {"source": "s", "event_type": "t", "severity": "info", "timestamp": "2024-01-02T12:00:00Z", "tags": ["a"]}
    rows = [json.dumps({**good, field: value}), json.dumps(good), json.dumps({**good, field: None})]
    rows += [json.dumps({k: v for k, v in good.items() if k != field}), json.dumps({**good, "data": [1], "metadata": 7, "tags": []})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "event_index int, sent string")
    got = {r["event_index"]: r["unreadable"] for r in ingest.typed_events(df).collect()}
    assert got == {0: [field], 1: [], 2: [], 3: [], 4: []}
