import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import alerts, anomaly

NOW = dt.datetime(2024, 1, 2)
MINUTE = dt.timedelta(minutes=1)


def counts_frame(spark, rows):
    return spark.createDataFrame(
        [(t, s, "t", v, n) for t, s, v, n in rows],
        "bucket timestamp, source string, event_type string, severity string, count bigint",
    )


def steady(source, total, errors=0, jitter=0):
    """Traffic in every 5-minute baseline window."""
    rows = []
    for i in range(2, 200):
        at = NOW - 5 * MINUTE * i
        rows.append((at, source, "info", total - errors + (i % 2) * jitter))
        if errors:
            rows.append((at, source, "error", errors + (i % 2)))
    return rows


def test_zero_deviation_is_never_anomalous(spark):
    counts = counts_frame(spark, steady("flat", 10) + [(NOW - MINUTE, "flat", "error", 500)])
    assert anomaly.detect_anomalies(counts, as_of=NOW).count() == 0


def test_spike_and_silence_are_flagged(spark):
    rows = steady("loud", 100, jitter=2) + [(NOW - MINUTE, "loud", "info", 500)]
    rows += steady("quiet", 100, jitter=2)
    rows += steady("calm", 100, jitter=4) + [(NOW - MINUTE, "calm", "info", 102)]
    found = anomaly.detect_anomalies(counts_frame(spark, rows), as_of=NOW).collect()
    assert {(r.source, r.metric, r.z_score > 0) for r in found} == {
        ("loud", "event_count", True), ("quiet", "event_count", False),
    }


def test_error_rate_is_flagged_upwards_only(spark):
    rows = steady("bad", 100, errors=5) + [(NOW - MINUTE, "bad", "error", 100)]
    rows += steady("good", 100, errors=5) + [(NOW - MINUTE, "good", "info", 104)]
    found = anomaly.detect_anomalies(counts_frame(spark, rows), as_of=NOW).collect()
    assert ("bad", "error_rate") in {(r.source, r.metric) for r in found}
    assert ("good", "error_rate") not in {(r.source, r.metric) for r in found}


def test_facts_text(spark):
    df = spark.createDataFrame(
        [("s", "error_rate", 0.5, 0.1, 0.05, 8.0)],
        "source string, metric string, value double, mean double, stddev double, z_score double",
    )
    facts = anomaly.describe(df).first().facts
    assert facts.splitlines()[2:] == [
        "- Current value: 0.5000", "- 24h baseline mean: 0.1000",
        "- 24h baseline std dev: 0.0500", "- Z-score: 8.00 (threshold: 3.0)",
    ]


RULE = (
    "rule_id string, name string, metric string, operator string, threshold double, window string,"
    " source string, severity string, channels string, enabled boolean, cooldown_seconds int"
)


def rule(rule_id, metric="event_count", operator=">", threshold=0.0, window="5m", source="", enabled=True, cooldown=300, channels="[]"):
    return (rule_id, f"n-{rule_id}", metric, operator, threshold, window, source, "warning", channels, enabled, cooldown)


def past_events(spark, *fired):
    rows = [(f"e{i}", r, at) for i, (r, at) in enumerate(fired)]
    return spark.createDataFrame(rows, "alert_event_id string, rule_id string, fired_at timestamp")


def test_metrics_windows_and_silence(spark):
    counts = counts_frame(
        spark,
        [
            (NOW - MINUTE, "a", "error", 2), (NOW - 5 * MINUTE, "a", "info", 6),
            (NOW - 6 * MINUTE, "a", "fatal", 1), (NOW, "a", "info", 99), (NOW - MINUTE, "b", "info", 4),
        ],
    )
    rules = [
        rule("all1", window="1m"), rule("all5"), rule("a5", source="a"), rule("odd", window="9w", source="a"),
        rule("err", metric="error_count", window="15m"), rule("rate", metric="error_rate", source="a"),
        rule("none", source="zzz"), rule("norate", metric="error_rate", source="zzz"), rule("bad", metric="p42"),
    ]
    got = alerts.rule_metrics(spark.createDataFrame(rules, RULE), counts, as_of=NOW).collect()
    values = {r.rule_id: r.value for r in got}
    assert values == {
        "all1": 6.0, "all5": 12.0, "a5": 8.0, "odd": 8.0, "err": 3.0, "rate": 0.25,
        "none": 0.0, "norate": 0.0, "bad": None,
    }
    assert {r.rule_id: r.error for r in got if r.error} == {"bad": "unknown metric: p42"}


def test_firing_cooldown_and_silence(spark):
    counts = counts_frame(spark, [(NOW - MINUTE, "a", "error", 2)])
    rules = [
        rule("fires"), rule("off", enabled=False), rule("cooling"), rule("rested"), rule("false", threshold=5.0),
        rule("below", metric="error_rate", operator="<", threshold=0.1, source="silent"),
        rule("broken", metric="p42"), rule("oddop", operator="~"), rule("equal", operator="==", threshold=2.0),
    ]
    past = past_events(
        spark,
        ("cooling", NOW - dt.timedelta(seconds=299)), ("cooling", NOW - dt.timedelta(days=1)),
        ("rested", NOW - dt.timedelta(seconds=300)),
    )
    fired = alerts.evaluate_rules(spark.createDataFrame(rules, RULE), counts, past, as_of=NOW).collect()
    assert {r.rule_id for r in fired} == {"fires", "rested", "below", "equal"}
    context = json.loads(next(r.context for r in fired if r.rule_id == "fires"))
    assert context == {"metric": "event_count", "value": 2.0, "threshold": 0.0, "source": "", "window": "5m"}
    assert len({r.alert_event_id for r in fired}) == 4


def test_notifications_keep_webhooks_only(spark):
    channels = '[{"type":"webhook","url":"u1"},{"type":"email","url":"x"},{"type":"webhook","url":"u2"}]'
    counts = counts_frame(spark, [(NOW - MINUTE, "a", "error", 2)])
    rules = spark.createDataFrame([rule("r", channels=channels), rule("s"), rule("t", channels="oops")], RULE)
    fired = alerts.evaluate_rules(rules, counts, past_events(spark), as_of=NOW)
    sent = alerts.notifications(fired).collect()
    assert sorted(r.url for r in sent) == ["u1", "u2"]
    body = json.loads(sent[0].payload)
    assert (body["alert"], body["status"], body["fired_at"]) == ("n-r", "firing", "2024-01-02T00:00:00Z")


def test_condition_json(spark):
    df = spark.createDataFrame([("r", '{"metric":"event_count","operator":">","threshold":3,"window":"1m"}')], "rule_id string, condition string")
    row = alerts.unpack_condition(df).first()
    assert (row.metric, row.threshold, row.window, row.source) == ("event_count", 3.0, "1m", "")


CHANGE = "rule_id string, changed_at timestamp, seq bigint, op string, name string, severity string, enabled boolean, cooldown_seconds int, channels string"


def test_rule_log(spark):
    def at(n):
        return NOW + MINUTE * n

    log = [
        ("a", at(0), 0, "create", "first", None, None, None, None),
        ("a", at(1), 1, "update", "", "critical", False, None, None),
        ("b", at(2), 2, "create", "second", "info", None, 60, "[1]"),
        ("b", at(3), 3, "delete", None, None, None, None, None),
        ("c", at(4), 4, "create", "third", "info", True, 60, "[1]"),
        ("c", at(5), 5, "delete", None, None, None, None, None),
        ("c", at(6), 6, "create", "again", None, None, None, None),
    ]
    got = alerts.current_rules(spark.createDataFrame(log, CHANGE)).collect()
    assert [tuple(r)[:6] for r in got] == [
        ("c", "again", "warning", True, 300, "[]"), ("a", "first", "critical", False, 300, "[]"),
    ]


def test_breach_spans_across_midnight(spark):
    hour = dt.timedelta(hours=1)
    rows = [(NOW + hour * h, "a", "error", 2) for h in (-2, -1, 0, 2)]
    spans = alerts.breach_spans(counts_frame(spark, rows), threshold=2).orderBy("span").collect()
    assert [(r.fired_at, r.resolved_at, r.errors) for r in spans] == [
        (NOW - 2 * hour, NOW + hour, 6), (NOW + 2 * hour, NOW + 3 * hour, 2),
    ]


def test_alert_groups_split_on_the_gap(spark):
    second = dt.timedelta(seconds=1)
    past = past_events(spark, ("r", NOW - 100 * second), ("r", NOW + 200 * second), ("r", NOW + 501 * second))
    got = alerts.group_alerts(past).orderBy("alert_group").collect()
    assert [r.alerts for r in got] == [2, 1]


def test_deployment_must_be_recent_and_earlier(spark):
    hour = dt.timedelta(hours=1)
    deploys = spark.createDataFrame(
        [("d1", "a", NOW - 7 * hour), ("d2", "a", NOW - 6 * hour), ("d3", "a", NOW + hour), ("d4", "b", NOW)],
        "event_id string, source string, timestamp timestamp",
    )
    marks = spark.createDataFrame([("a", NOW), ("a", NOW + hour / 2), ("b", NOW - hour), ("b", NOW)], "source string, timestamp timestamp")
    got = {(r.source, r.timestamp): r.deployment_id for r in anomaly.preceding_deployment(marks, deploys).collect()}
    assert got == {("a", NOW): "d2", ("a", NOW + hour / 2): None, ("b", NOW - hour): None, ("b", NOW): "d4"}


def test_mark_notified_with_many_deliveries(spark):
    past = past_events(spark, ("r", NOW), ("s", NOW)).withColumn("notified", F.lit(False))
    log = spark.createDataFrame([("e0",)] * 20, "alert_event_id string")
    got = {r.alert_event_id: r.notified for r in alerts.mark_notified(past, log).collect()}
    assert got == {"e0": True, "e1": False}


@pytest.mark.parametrize("zero_fill", [False, True])
def test_sparse_source_baseline(spark, zero_fill):
    rows = [(NOW - 5 * MINUTE * i, "s", "info", 1) for i in range(2, 20)]
    row = anomaly.source_baselines(counts_frame(spark, rows), as_of=NOW, zero_fill=zero_fill).first()
    assert row.event_count_mean == pytest.approx(18 / 287 if zero_fill else 1.0)
    assert (row.event_count_stddev > 0) is zero_fill
