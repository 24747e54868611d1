"""Minute and hour counts and how they are merged into tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.fields import duration_ms, field
from eventloom.functions.quantiles import exact_percentiles
from eventloom.functions.timeops import as_datetime, floor_to, truncate_hour
from eventloom.operators.ingest import on_touched_days
from eventloom.plans.pruning import between
from eventloom.schemas import COUNT_KEY, is_error

WIDTHS = {"1m": "1 minute", "1h": "1 hour"}
REST = COUNT_KEY[1:]


def _next_minute(value: datetime | str | None) -> datetime | None:
    if value is None:
        return None
    moment = as_datetime(value)
    floor = moment.replace(second=0, microsecond=0)
    return floor if floor == moment else floor + timedelta(minutes=1)


def minute_counts(
    ev: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """Events per minute, source, type and severity. Give it deduplicated events.

    With bounds, only buckets of `[start, end)`: stated on the event time, where they
    prune files, since a bound on the computed bucket would not reach the scan.
    """
    return counts_of(between(ev, _next_minute(start), _next_minute(end)), "1 minute")


def counts_of(ev: DataFrame, width: str) -> DataFrame:
    """Counts at any width straight from events, for ranges that no rollup covers yet."""
    return ev.groupBy(floor_to(F.col("timestamp"), width).alias("bucket"), *REST).agg(
        F.count("*").alias("count")
    )


def coarser(counts: DataFrame, width: str) -> DataFrame:
    return counts.groupBy(floor_to(F.col("bucket"), width).alias("bucket"), *REST).agg(
        F.sum("count").alias("count")
    )


def roll_hour(minutes: DataFrame, hour: datetime | str) -> DataFrame:
    """Hour counts of the hour that holds `hour`."""
    start = truncate_hour(hour)
    return coarser(between(minutes, start, start + timedelta(hours=1), "bucket"), "1 hour")


def roll_pending(minutes: DataFrame, *, as_of: datetime | str, hours: int = 2) -> DataFrame:
    """Hour counts of the last complete hours, in one job, so late minutes are picked up."""
    end = truncate_hour(as_of)
    return coarser(between(minutes, end - timedelta(hours=hours), end, "bucket"), "1 hour")


def add_counts(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts plus a delta, key by key."""
    both = stored.select(*COUNT_KEY, "count").unionByName(delta.select(*COUNT_KEY, "count"))
    return both.groupBy(*COUNT_KEY).agg(F.sum("count").alias("count"))


def merge_days(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts (with event_date) plus a delta, for the days that the delta touches alone.

    Written by `write_by_day`, the result replaces those days; the others are neither read
    nor written.
    """
    touched = delta.select(F.col("bucket").alias("timestamp"))
    return add_counts(on_touched_days(stored, touched), delta)


def replace_counts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored counts with fresh ones taking over their keys, in one aggregation."""
    old = stored.select(*COUNT_KEY, "count").withColumn("_age", F.lit(1))
    new = fresh.select(*COUNT_KEY, "count").withColumn("_age", F.lit(0))
    return old.unionByName(new).groupBy(*COUNT_KEY).agg(F.min_by("count", "_age").alias("count"))


def latency_stats(ev: DataFrame) -> DataFrame:
    """Count, sum, extremes and exact percentiles of durations per minute, source, endpoint."""
    keys = ["bucket", "source", "endpoint"]
    timed = ev.select(
        floor_to(F.col("timestamp"), "1 minute").alias("bucket"),
        "source",
        field("path").alias("endpoint"),
        duration_ms().alias("ms"),
    ).where(F.col("ms").isNotNull())
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return exact_percentiles(timed, keys, "ms", fractions, stats=True)


def error_rates(counts: DataFrame) -> DataFrame:
    """Errors and error rate per minute and source."""
    total = F.sum("count")
    errors = F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))
    return counts.groupBy("bucket", "source").agg(
        total.alias("total"), errors.alias("errors"), (errors / total).alias("error_rate")
    )


def fresh_counts(stored: DataFrame, ev: DataFrame, *, rolled_until: datetime | str) -> DataFrame:
    """Rolled-up minutes before `rolled_until` and raw events from there on."""
    return add_counts(
        between(stored, None, rolled_until, "bucket"), minute_counts(between(ev, rolled_until))
    )


# How many days each table keeps its partitions.
RETENTION_DAYS = {"events": 30, "event_counts_1m": 30, "event_counts_1h": 365}


def retention(days: DataFrame, *, as_of: datetime | str, day: str = "event_date") -> DataFrame:
    """Keep or drop, per table and day partition."""
    today = F.lit(as_datetime(as_of).date())
    policy = F.array(
        *(F.struct(F.lit(t).alias("table"), F.lit(d).alias("keep")) for t, d in RETENTION_DAYS.items())
    )
    aged = days.select("*", F.explode(policy).alias("_p")).select(
        *days.columns, F.col("_p.table").alias("table_name"),
        F.date_diff(today, F.col(day)).cast("bigint").alias("age_days"), F.col("_p.keep").alias("_keep"),
    )
    return aged.withColumn("keep", F.col("age_days") <= F.col("_keep")).drop("_keep")


def storage_tier(days: DataFrame, *, as_of: datetime | str, day: str = "event_date") -> DataFrame:
    """Hot up to 7 days, warm up to 30, cold up to 365, then delete."""
    age = F.date_diff(F.lit(as_datetime(as_of).date()), F.col(day))
    tier = F.when(age <= 7, "hot").when(age <= 30, "warm").when(age <= 365, "cold")
    return days.withColumn("tier", tier.otherwise("delete"))


def partial_counts(ev: DataFrame, edge: str = "edge") -> DataFrame:
    """First level: counts per collecting edge and minute key."""
    bucket = floor_to(F.col("timestamp"), "1 minute").alias("bucket")
    return ev.groupBy(edge, bucket, *REST).agg(F.count("*").alias("count"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Second level: partial counts of all edges summed per minute key."""
    return partials.groupBy(*COUNT_KEY).agg(F.sum("count").alias("count"))


def known_at(ev: DataFrame, moment: datetime | str) -> DataFrame:
    """Events that had been received by a moment."""
    from eventloom.functions.timeops import ts_lit

    return ev.where(F.col("received_at") <= ts_lit(moment))
