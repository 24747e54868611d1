"""Dashboards' aggregates over minute or hour counts (columns of COUNT_KEY plus `count`)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.fields import duration_ms, field
from eventloom.functions.timeops import as_datetime, floor_to, resolution_for, time_bounds, ts_lit
from eventloom.plans.pruning import between
from eventloom.schemas import SEVERITIES, is_error, page_size

# Dimensions a request may group by.
SERIES_DIMENSIONS = ("source", "severity")
TOP_DIMENSIONS = ("source", "event_type")
DEFAULT_TOP, MAX_TOP = 10, 100


def _errors() -> Column:
    return F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))


def pick_table(minutes: DataFrame, hours: DataFrame, resolution: str) -> DataFrame:
    return hours if resolution == "1h" else minutes


def time_series(
    counts: DataFrame,
    start: datetime | str,
    end: datetime | str,
    *,
    source: str | None = None,
    severity: str | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Counts per bucket and, if asked, per source or severity, in bucket order."""
    counts = between(counts, start, end, "bucket")
    if source:
        counts = counts.where(F.col("source") == source)
    if severity:
        counts = counts.where(F.col("severity") == severity)
    keys = ["bucket", *([group_by] if group_by in SERIES_DIMENSIONS else [])]
    return counts.groupBy(*keys).agg(F.sum("count").alias("count")).orderBy(*keys)


def series_of(
    minutes: DataFrame,
    hours: DataFrame,
    *,
    as_of: datetime | str,
    shorthand: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    resolution: str | None = None,
    **options: object,
) -> DataFrame:
    """The series a request names: its range from `time_bounds`, its table from `resolution_for`."""
    first, last = time_bounds(as_of, shorthand, start, end)
    counts = pick_table(minutes, hours, resolution_for(resolution, first, last))
    return time_series(counts, first, last, **options)


def summary_totals(counts: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """Events, errors, error rate and distinct sources in one pass; zeros when empty."""
    return totals(between(counts, start, end, "bucket"))


def totals(counts: DataFrame) -> DataFrame:
    """The summary of all given counts."""
    total = F.coalesce(F.sum("count"), F.lit(0))
    return counts.agg(
        total.alias("total_events"),
        _errors().alias("error_count"),
        F.when(total > 0, _errors() / total).otherwise(0.0).alias("error_rate"),
        F.count_distinct("source").alias("active_sources"),
    )


def active_sources(
    counts: DataFrame, start: datetime | str, end: datetime | str, approximate: bool = False
) -> DataFrame:
    """Number of distinct sources; the approximate form needs no shuffle of the names."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return between(counts, start, end, "bucket").agg(distinct("source").alias("active_sources"))


def ranked(counts: DataFrame, key: str, limit: int | None) -> DataFrame:
    totals = counts.groupBy(F.col(key).alias("key")).agg(F.sum("count").alias("count"))
    totals = totals.orderBy(F.desc("count"), "key")
    return totals if limit is None else totals.limit(limit)


def top_n(
    counts: DataFrame,
    start: datetime | str,
    end: datetime | str,
    *,
    group_by: str = "source",
    limit: int | None = None,
) -> DataFrame:
    """Largest sources or event types; any other dimension counts as source."""
    key = group_by if group_by in TOP_DIMENSIONS else "source"
    return ranked(between(counts, start, end, "bucket"), key, page_size(limit, DEFAULT_TOP, MAX_TOP))


def by_severity(counts: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return ranked(between(counts, start, end, "bucket"), "severity", None)


def pivot_severity(counts: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """One row per bucket with a column per severity; the fixed list spares a first pass."""
    pivoted = (
        between(counts, start, end, "bucket")
        .groupBy("bucket")
        .pivot("severity", list(SEVERITIES))
        .agg(F.sum("count"))
    )
    return pivoted.fillna(0, list(SEVERITIES)).orderBy("bucket")


def volume_chart(
    counts: DataFrame, *, as_of: datetime | str, minutes: int = 5, buckets: int = 13
) -> DataFrame:
    """The last hour in 5-minute buckets, empty ones included, folded to three levels."""
    end = as_datetime(as_of)
    last = end - timedelta(
        minutes=end.minute % minutes, seconds=end.second, microseconds=end.microsecond
    )
    first = last - timedelta(minutes=minutes * (buckets - 1))
    calendar = counts.sparkSession.range(1).select(
        F.explode(
            F.sequence(ts_lit(first), ts_lit(last), F.expr(f"interval {minutes} minutes"))
        ).alias("bucket")
    )
    level = (
        F.when(is_error(F.col("severity")), "error")
        .when(F.col("severity") == "warn", "warn")
        .otherwise("info")
    )
    recent = between(counts, first, last + timedelta(minutes=minutes), "bucket")
    held = _levels(recent, minutes, level)
    return calendar.join(held, "bucket", "left").fillna(0).orderBy("bucket")


def _levels(counts: DataFrame, minutes: int, level: Column) -> DataFrame:
    return counts.groupBy(floor_to(F.col("bucket"), f"{minutes} minutes").alias("bucket")).agg(
        *(
            F.sum(F.when(level == name, F.col("count")).otherwise(0)).alias(name)
            for name in ("info", "warn", "error")
        )
    )


def _span_totals(at: Column, start: datetime, end: datetime, prefix: str) -> list[Column]:
    inside = (at >= ts_lit(start)) & (at < ts_lit(end))
    failed = inside & is_error(F.col("severity"))
    return [
        F.coalesce(F.sum(F.when(inside, F.col("count"))), F.lit(0)).alias(f"{prefix}_total"),
        F.coalesce(F.sum(F.when(failed, F.col("count"))), F.lit(0)).alias(f"{prefix}_errors"),
    ]


def _rate(errors: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(errors) / F.col(total)).otherwise(0.0)


def compare_periods(
    counts: DataFrame, *, as_of: datetime | str, days: int = 7, key: str = "source"
) -> DataFrame:
    """Totals, errors and error rates of the last period next to the one before it."""
    end = as_datetime(as_of)
    middle, start = end - timedelta(days=days), end - timedelta(days=2 * days)
    at = F.col("bucket")
    totals = (
        between(counts, start, end, "bucket")
        .groupBy(key)
        .agg(*_span_totals(at, middle, end, "this"), *_span_totals(at, start, middle, "last"))
    )
    return totals.withColumn("this_rate", _rate("this_errors", "this_total")).withColumn(
        "last_rate", _rate("last_errors", "last_total")
    )


def health_report(
    counts: DataFrame, *, as_of: datetime | str, band: float = 0.1, slo: float = 0.99
) -> DataFrame:
    """Per source: this week, the trend against last week, SLA and remaining error budget.

    A rate within `band` of last week's is stable. The budget left is the share of the
    errors allowed by `slo` that is still unused.
    """
    this, last = F.col("this_rate"), F.col("last_rate")
    trend = (
        F.when(this > last * (1 + band), "degrading")
        .when(this < last * (1 - band), "improving")
        .otherwise("stable")
    )
    allowed = F.col("this_total") * (1 - slo)
    return compare_periods(counts, as_of=as_of).select(
        "source", "this_total", "this_errors", "this_rate", "last_rate",
        trend.alias("trend"),
        (1 - this).alias("availability"),
        (1 - this >= slo).alias("sla_met"),
        F.when(allowed > 0, 1 - F.col("this_errors") / allowed).alias("budget_left"),
    )


def hourly_pattern(hours: DataFrame, factor: float = 3.0) -> DataFrame:
    """Mean errors by source and hour of day, flagged at `factor` times the source's mean.

    Means are over hours with traffic.
    """
    per_hour = hours.groupBy("source", "bucket").agg(_errors().alias("errors"))
    by_hour = per_hour.groupBy("source", F.hour("bucket").alias("hour")).agg(
        F.sum("errors").alias("_errors"), F.count("*").alias("_n")
    )
    overall = by_hour.groupBy("source").agg((F.sum("_errors") / F.sum("_n")).alias("source_mean"))
    mean = F.col("_errors") / F.col("_n")
    return by_hour.join(overall, "source").select(
        "source",
        "hour",
        mean.alias("mean_errors"),
        "source_mean",
        ((F.col("source_mean") > 0) & (mean >= F.col("source_mean") * factor)).alias("recurring"),
    )


def source_profiles(ev: DataFrame) -> DataFrame:
    """What each source sends: number of types, JSON keys and whether it carries latency.

    Types and keys are first reduced to distinct pairs, so no list grows with the events.
    """
    shapes = ev.groupBy("source", "event_type", F.json_object_keys("data").alias("_keys")).agg(
        F.count("*").alias("_n")
    )
    totals = shapes.groupBy("source").agg(
        F.sum("_n").alias("events"), F.count_distinct("event_type").alias("event_types")
    )
    keys = (
        shapes.select("source", F.explode("_keys").alias("key"))
        .distinct()
        .groupBy("source")
        .agg(
            F.count("*").alias("json_keys"),
            F.bool_or(F.col("key") == "duration_ms").alias("has_latency"),
        )
    )
    return totals.join(keys, "source", "left").select(
        "source", "events", "event_types",
        F.coalesce("json_keys", F.lit(0)).alias("json_keys"),
        F.coalesce("has_latency", F.lit(False)).alias("has_latency"),
    )


def top_endpoints(ev: DataFrame, limit: int = 10) -> DataFrame:
    """Most requested paths with their mean latency."""
    return (
        ev.groupBy(field("path").alias("endpoint"))
        .agg(F.count("*").alias("requests"), F.avg(duration_ms()).alias("mean_ms"))
        .orderBy(F.desc("requests"), "endpoint")
        .limit(limit)
    )


FACETS = ("source", "severity", "event_type")


def facets(found: DataFrame) -> DataFrame:
    """Counts per source, per severity and per type of a result, in one aggregation."""
    keys = [F.col(f) for f in FACETS]
    sets = found.groupingSets([[k] for k in keys], *keys).agg(
        F.count("*").alias("count"), F.grouping_id().alias("_set")
    )
    name = F.when(F.col("_set") == 3, "source").when(F.col("_set") == 5, "severity")
    return sets.select(
        name.otherwise("event_type").alias("facet"), F.coalesce(*keys).alias("value"), "count"
    )


# Functions an aggregate request may name.
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(
    ev: DataFrame,
    *,
    function: str = "count",
    metric: str = "*",
    group_by: Sequence[str] = (),
    window: str | None = None,
    sort: str = "desc",
) -> DataFrame:
    """`function(metric)` by allowed fields and an optional time window, sorted by value."""
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function}")
    if metric not in ("*", "duration_ms", "status"):
        raise ValueError(f"unknown metric: {metric}")
    if metric == "*" and function != "count":
        raise ValueError("only count works without a metric")
    value = F.lit(1) if metric == "*" else F.get_json_object("data", f"$.{metric}").try_cast("double")
    keys = [field(name).alias(name) for name in group_by]
    names = list(group_by)
    if window:
        keys.append(floor_to(F.col("timestamp"), window).alias("bucket"))
        names.append("bucket")
    result = ev.groupBy(*keys).agg(AGGREGATES[function](value).alias("value"))
    order = F.asc("value") if sort == "asc" else F.desc("value")
    return result.orderBy(order, *names)


def duration_bucket(milliseconds: Column) -> Column:
    """Named latency class of a duration."""
    return (
        F.when(milliseconds.isNull(), "unknown")
        .when(milliseconds < 10, "<10ms")
        .when(milliseconds < 100, "10-100ms")
        .when(milliseconds < 1000, "100ms-1s")
        .otherwise(">=1s")
    )


def login_bursts(
    failures: DataFrame, *, threshold: int = 100, top: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Minutes with more than `threshold` failed logins, and the busiest hosts and accounts.

    `failures` has timestamp, host and account columns.
    """
    minutes = (
        failures.groupBy(floor_to(F.col("timestamp"), "1 minute").alias("bucket"))
        .agg(F.count("*").alias("failures"))
        .where(F.col("failures") > threshold)
    )

    def leaders(column: str) -> DataFrame:
        counted = failures.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("failures"))
        best = counted.orderBy(F.desc("failures"), "value").limit(top)
        return best.select(F.lit(column).alias("dimension"), "value", "failures")

    return minutes, leaders("host").unionByName(leaders("account"))
