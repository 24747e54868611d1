"""Alert rules: metrics, firing with cooldown, history, notification and lifecycle.

Rules have rule_id, name, metric, operator, threshold, window, source ('' for all),
severity, channels (JSON), enabled and cooldown_seconds.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.fields import duration_ms
from eventloom.functions.quantiles import exact_percentiles
from eventloom.functions.timeops import (
    ALERT_WINDOWS,
    alert_window,
    as_datetime,
    epoch_seconds,
    floor_to,
    ts_lit,
)
from eventloom.operators.retrieval import compare
from eventloom.plans.pruning import between
from eventloom.plans.skew import running_sums, salted_join
from eventloom.schemas import CHANNELS, CONDITION, is_error, page_size

# Known metrics and the defaults of a new rule.
METRICS = ("error_rate", "event_count", "error_count")
RULE_DEFAULTS = {"enabled": True, "severity": "warning", "cooldown_seconds": 300, "channels": "[]"}


def unpack_condition(rules: DataFrame, condition: str = "condition") -> DataFrame:
    """Condition JSON to the rule's metric, operator, threshold, window and source columns."""
    parsed = rules.withColumn("_c", F.from_json(condition, CONDITION))
    return parsed.select(
        *[c for c in rules.columns if c != condition], "_c.metric", "_c.operator", "_c.threshold",
        "_c.window", F.coalesce("_c.source", F.lit("")).alias("source"),
    )


def window_metrics(counts: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Totals and errors per (window name, source) up to `as_of`; source '' is all of them.

    Rules then look their window up by an equi-join, so their number costs nothing here
    and no rule is paired with counts it does not need.
    """
    now = as_datetime(as_of)
    longest = max(ALERT_WINDOWS.values())
    recent = between(counts, now - timedelta(seconds=longest), now, "bucket")
    sums = []
    for name, seconds in ALERT_WINDOWS.items():
        inside = F.col("bucket") >= ts_lit(now - timedelta(seconds=seconds))
        failed = inside & is_error(F.col("severity"))
        sums.append(F.sum(F.when(inside, F.col("count"))).alias(f"_t{name}"))
        sums.append(F.sum(F.when(failed, F.col("count"))).alias(f"_e{name}"))
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("window"),
                F.coalesce(f"_t{name}", F.lit(0)).alias("total"),
                F.coalesce(f"_e{name}", F.lit(0)).alias("errors"),
            )
            for name in ALERT_WINDOWS
        )
    )
    long = (
        recent.groupBy("source").agg(*sums).select("source", F.explode(cells).alias("_w"))
    ).select("source", "_w.*")
    scoped = long.select(
        F.explode(F.array("source", F.lit(""))).alias("source"), "window", "total", "errors"
    )
    return scoped.groupBy("window", "source").agg(
        F.sum("total").alias("total"), F.sum("errors").alias("errors")
    )


def rule_metrics(rules: DataFrame, counts: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """Rules with the value of their metric; an unknown metric gives null and an `error`.

    Rules over silent windows get 0, as does the error rate of an empty window.
    """
    measured = window_metrics(counts, as_of=as_of).withColumnRenamed("window", "_window")
    keyed = rules.withColumn("_window", alert_window(F.col("window")))
    joined = salted_join(keyed, measured, ["_window", "source"], ["rule_id"], "left")
    total = F.coalesce("total", F.lit(0))
    errors = F.coalesce("errors", F.lit(0))
    value = (
        F.when(F.col("metric") == "event_count", total.cast("double"))
        .when(F.col("metric") == "error_count", errors.cast("double"))
        .when(
            F.col("metric") == "error_rate", F.when(total > 0, errors / total).otherwise(0.0)
        )
    )
    unknown = ~F.coalesce(F.col("metric").isin(*METRICS), F.lit(False))
    problem = F.when(unknown, F.concat(F.lit("unknown metric: "), F.coalesce("metric", F.lit(""))))
    return joined.select(*rules.columns, value.alias("value"), problem.alias("error"))


def latency_metrics(rules: DataFrame, ev: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """The `latency_p99` rules with their value, one exact percentile per window and source."""
    now = as_datetime(as_of)
    longest = max(ALERT_WINDOWS.values())
    # The narrowest window an event is in decides the others: count per event class first.
    steps = sorted(ALERT_WINDOWS.items(), key=lambda item: item[1])
    narrowest = F.coalesce(
        *(
            F.when(F.col("timestamp") >= ts_lit(now - timedelta(seconds=s)), F.lit(i))
            for i, (_, s) in enumerate(steps)
        )
    )
    counted = (
        between(ev, now - timedelta(seconds=longest), now)
        .groupBy("source", narrowest.alias("_narrowest"), duration_ms().alias("ms"))
        .agg(F.count("*").alias("_times"))
    )
    names = F.array(*(F.lit(name) for name, _ in steps))
    timed = counted.select(
        F.explode(F.array("source", F.lit(""))).alias("source"), "_narrowest", "ms", "_times"
    ).select(
        "source", F.explode(F.slice(names, F.col("_narrowest") + 1, len(steps))).alias("_window"),
        "ms", "_times",
    )
    tails = exact_percentiles(timed, ["_window", "source"], "ms", {"value": 0.99}, weight="_times")
    keyed = rules.where(F.col("metric") == "latency_p99").withColumn(
        "_window", alert_window(F.col("window"))
    )
    joined = salted_join(keyed, tails, ["_window", "source"], ["rule_id"], "left")
    return joined.drop("_window")


def last_firing(alert_events: DataFrame) -> DataFrame:
    return alert_events.groupBy("rule_id").agg(F.max("fired_at").alias("last_fired"))


def triggered(value: Column, operator: Column, threshold: Column) -> Column:
    return F.coalesce(compare(value, operator, threshold), F.lit(False))


def fire(measured: DataFrame, alert_events: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """New alert events: enabled rules out of cooldown whose comparison holds.

    The id hashes rule and time, so evaluating the same moment twice gives the same rows.
    """
    now = ts_lit(as_of)
    ready = measured.where("enabled").join(last_firing(alert_events), "rule_id", "left")
    rested = F.col("last_fired").isNull() | (
        epoch_seconds(now) - epoch_seconds(F.col("last_fired")) >= F.col("cooldown_seconds")
    )
    hot = triggered(F.col("value"), F.col("operator"), F.col("threshold"))
    return alert_rows(ready.where(rested & hot), now)


def alert_rows(firing: DataFrame, moment: Column) -> DataFrame:
    """Alert events of rules with their `value`, fired at `moment`."""
    context = F.to_json(
        F.struct("metric", "value", "threshold", F.col("source"), F.col("window"))
    )
    second = F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    return firing.select(
        F.sha2(F.concat_ws("|", "rule_id", second), 256).alias("alert_event_id"),
        "rule_id", "name",
        F.lit("firing").alias("status"), moment.alias("fired_at"), "value",
        context.alias("context"), F.lit(False).alias("notified"), "severity", "channels",
    )


def evaluate_rules(
    rules: DataFrame, counts: DataFrame, alert_events: DataFrame, *, as_of: datetime | str
) -> DataFrame:
    """Evaluate every rule at once and return the alerts that fire."""
    return fire(rule_metrics(rules, counts, as_of=as_of), alert_events, as_of=as_of)


def minute_totals(
    rules: DataFrame, counts: DataFrame, first: datetime | str, last: datetime | str
) -> DataFrame:
    """(_window, source, minute, total, errors) at every full minute of `[first, last]`.

    Only windows and sources that rules name are looked at; `minute` counts from the epoch and
    silent minutes are there with zeros. A count enters the running sum of a window when it
    comes into it and leaves it afterwards, so the cost does not grow with window lengths.
    """
    begin, end = (F.lit(_minute(m)).cast("bigint") for m in (first, last))
    scopes = rules.select(alert_window(F.col("window")).alias("_window"), "source").distinct()
    oldest = as_datetime(first) - timedelta(seconds=max(ALERT_WINDOWS.values()))
    errors = F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))
    recent = between(counts, oldest, last, "bucket")
    per_source = recent.groupBy("bucket", "source").agg(F.sum("count").alias("total"), errors.alias("errors"))
    scoped = per_source.select(
        F.expr("unix_timestamp(cast(bucket as timestamp)) div 60").alias("_at"), "total", "errors",
        F.explode(F.array("source", F.lit(""))).alias("source"),
    ).groupBy("_at", "source").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"))
    reach = F.coalesce(*(F.when(F.col("_window") == w, F.lit(s // 60)) for w, s in ALERT_WINDOWS.items()))
    moves = F.array(
        F.struct((F.col("_at") + 1).alias("t"), F.lit(1).alias("sign")),
        F.struct((F.col("_at") + 1 + reach).alias("t"), F.lit(-1).alias("sign")),
    )
    steps = scoped.join(scopes, "source").select("_window", "source", "total", "errors", F.explode(moves).alias("m"))
    steps = steps.select(
        "_window", "source", F.greatest(F.col("m.t"), begin).alias("minute"),
        *((F.col(c) * F.col("m.sign")).alias(c) for c in ("total", "errors")),
    ).where(F.col("minute") <= end)
    zero = F.lit(0).cast("bigint")
    grid = scopes.select("*", F.explode(F.sequence(begin, end)).alias("minute"), zero.alias("total"), zero.alias("errors"))
    changes = steps.unionByName(grid).groupBy("_window", "source", "minute").agg(
        F.sum("total").alias("_total"), F.sum("errors").alias("_errors")
    )
    return running_sums(
        changes, ["_window", "source"], F.expr("minute div 1440"), ["minute"],
        {"total": "_total", "errors": "_errors"},
    ).select("_window", "source", "minute", "total", "errors")


def _minute(moment: datetime | str) -> int:
    return int(as_datetime(moment).replace(tzinfo=timezone.utc).timestamp()) // 60


def _out_of_cooldown(found: pd.DataFrame) -> pd.DataFrame:
    """The minutes of one rule at which it fires: each the first one that the firing before allows."""
    found = found.sort_values("minute")
    seconds = found["minute"].to_numpy() * 60
    wait = int(found["cooldown_seconds"].iloc[0])
    at = int(np.searchsorted(seconds, found["ready"].iloc[0]))
    fires = []
    while at < len(seconds):
        fires.append(at)
        at = max(at + 1, int(np.searchsorted(seconds, seconds[at] + wait)))
    return found.iloc[fires][["rule_id", "minute", "value"]]


def evaluate_minutes(
    rules: DataFrame,
    counts: DataFrame,
    alert_events: DataFrame,
    *,
    first: datetime | str,
    last: datetime | str,
) -> DataFrame:
    """What fires if every rule is evaluated at each full minute of `[first, last]` in turn.

    The same as `evaluate_rules` minute by minute, each run seeing the alerts of those before,
    but in one job. One task sees the minutes of one rule at which its comparison holds:
    at most 1440 a day, whatever the events are.
    """
    known = rules.where(F.col("enabled") & F.col("metric").isin(*METRICS))
    totals = minute_totals(known, counts, first, last)
    keyed = known.select(
        "rule_id", "metric", "operator", "threshold", "cooldown_seconds", "source",
        alert_window(F.col("window")).alias("_window"),
    )
    total, errors = F.col("total"), F.col("errors")
    value = (
        F.when(F.col("metric") == "event_count", total.cast("double"))
        .when(F.col("metric") == "error_count", errors.cast("double"))
        .otherwise(F.when(total > 0, errors / total).otherwise(0.0))
    )
    measured = salted_join(totals, keyed, ["_window", "source"], ["minute"]).withColumn("value", value)
    hot = measured.where(triggered(F.col("value"), F.col("operator"), F.col("threshold")))
    rested = epoch_seconds(F.col("last_fired")) + F.col("cooldown_seconds")
    waiting = hot.join(last_firing(alert_events), "rule_id", "left").select(
        "rule_id", "minute", "value", F.col("cooldown_seconds").cast("bigint").alias("cooldown_seconds"),
        F.coalesce(rested, F.lit(0)).cast("bigint").alias("ready"),
    )
    fires = waiting.groupBy("rule_id").applyInPandas(_out_of_cooldown, "rule_id string, minute bigint, value double")
    moment = F.timestamp_seconds(F.col("minute") * 60)
    return alert_rows(fires.join(known, "rule_id"), moment)


def alert_history(alert_events: DataFrame, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest alert events with their rule's name; events of unknown rules are left out."""
    named = rules.select("rule_id", F.col("name").alias("rule_name"))
    joined = salted_join(alert_events, named, ["rule_id"], ["alert_event_id"])
    return joined.orderBy(F.desc("fired_at"), F.desc("alert_event_id")).limit(
        page_size(limit, 50, 2**31 - 1)
    )


RULE_FIELDS = ("name", "severity", "enabled", "cooldown_seconds", "channels")


def current_rules(changes: DataFrame) -> DataFrame:
    """Rule table from its change log (rule_id, changed_at, op, RULE_FIELDS), newest first.

    A patch leaves empty fields as they were; the last value of each field is an aggregate
    with partial results, so a rule changed very often is no hot group. A rule whose last
    change deletes it is gone; changes before its latest creation do not count.
    """
    created = F.max(F.when(F.col("op") == "create", F.struct("changed_at", "seq")))
    born = changes.groupBy("rule_id").agg(created.alias("_born"))
    alive = salted_join(changes, born, ["rule_id"], ["seq"]).where(
        F.struct("changed_at", "seq") >= F.col("_born")
    )

    def newest(name: str) -> Column:
        value = F.col(name)
        filled = value.isNotNull()
        if dict(changes.dtypes)[name] == "string":
            filled = filled & (value != "")
        at = F.when(filled, F.struct("changed_at", "seq"))
        return F.max_by(value, at).alias(name)

    folded = alive.groupBy("rule_id").agg(
        F.max_by("op", F.struct("changed_at", "seq")).alias("_op"),
        F.max(F.when(F.col("op") == "create", F.col("changed_at"))).alias("created_at"),
        F.max("changed_at").alias("updated_at"),
        *(newest(name) for name in RULE_FIELDS),
    )
    with_defaults = [
        F.coalesce(name, F.lit(RULE_DEFAULTS[name])).alias(name) if name in RULE_DEFAULTS else name
        for name in RULE_FIELDS
    ]
    return (
        folded.where(F.col("_op") != "delete")
        .select("rule_id", *with_defaults, "created_at", "updated_at")
        .orderBy(F.desc("created_at"), "rule_id")
    )


def notifications(alerts: DataFrame) -> DataFrame:
    """One webhook payload per alert and webhook channel; other channel types are skipped."""
    payload = F.to_json(
        F.struct(
            F.col("name").alias("alert"), "severity", "status", "value",
            F.date_format("fired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fired_at"),
            "rule_id", "context",
        )
    )
    fanned = alerts.withColumn("_channel", F.explode_outer(F.from_json("channels", CHANNELS)))
    return fanned.where(F.col("_channel.type") == "webhook").select(
        "alert_event_id", F.col("_channel.url").alias("url"), payload.alias("payload")
    )


def mark_notified(alert_events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Sets `notified` from the delivery log, which may hold many tries per alert."""
    done = deliveries.select("alert_event_id").distinct().withColumn("_done", F.lit(True))
    return (
        alert_events.drop("notified")
        .join(done, "alert_event_id", "left")
        .withColumn("notified", F.coalesce("_done", F.lit(False)))
        .drop("_done")
    )


def breach_spans(counts: DataFrame, *, threshold: float, width: str = "1 hour") -> DataFrame:
    """Fire and resolve times per source of `error count >= threshold` on consecutive windows.

    A window breaches or not; a span starts where a breach follows a calm or silent window
    and resolves at the end of its last breaching window. A source has one row per window by then, however many
    events it sends, so its spans are found in one pass: 24 rows a day for hours.
    """
    errors = F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))
    seconds = F.expr(f"interval {width}")
    breaching = (
        counts.groupBy("source", floor_to(F.col("bucket"), width).alias("window"))
        .agg(errors.alias("errors"))
        .where(F.col("errors") >= threshold)
    )
    order = W.partitionBy("source").orderBy("window")
    before = F.lag("window").over(order)
    edged = breaching.withColumn("_start", (before.isNull() | (before + seconds < F.col("window"))).cast("bigint"))
    numbered = edged.withColumn("span", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("source", "span").agg(
        F.min("window").alias("fired_at"),
        (F.max("window") + seconds).alias("resolved_at"),
        F.sum("errors").alias("errors"),
    )


def group_alerts(alert_events: DataFrame, metric: str = "rule_id", gap: int = 300) -> DataFrame:
    """Groups of alerts with the same metric whose neighbours are at most `gap` seconds apart.

    Alerts of one stretch of `gap` seconds are in one group anyway, so they are counted together first. A metric, however
    many alerts it has, then has 86400 / `gap` rows a day, whose neighbours are found in one pass.
    """
    second = epoch_seconds(F.col("fired_at"))
    stretches = alert_events.groupBy(metric, F.floor(second / max(gap, 1)).alias("_at")).agg(
        F.count("*").alias("alerts"), F.min("fired_at").alias("first_fired"), F.max("fired_at").alias("last_fired")
    )
    order = W.partitionBy(metric).orderBy("_at")
    before = F.lag("last_fired").over(order)
    apart = epoch_seconds(F.col("first_fired")) - epoch_seconds(before)
    edged = stretches.withColumn("_start", (before.isNull() | (apart > gap)).cast("bigint"))
    numbered = edged.withColumn("alert_group", F.sum("_start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(metric, "alert_group").agg(
        F.sum("alerts").alias("alerts"),
        F.min("first_fired").alias("first_fired"),
        F.max("last_fired").alias("last_fired"),
    )
