"""Anomalies in rates, volumes, latencies, seasons, users and gauges."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.fields import duration_ms
from eventloom.functions.quantiles import exact_percentiles
from eventloom.functions.timeops import as_datetime, epoch_seconds, floor_to, ts_lit
from eventloom.plans.pruning import between
from eventloom.plans.skew import salted_join, trailing_sums, with_lookback
from eventloom.schemas import is_error

# Baseline length, current window and z-score threshold.
BASELINE = timedelta(hours=24)
CURRENT = timedelta(minutes=5)
THRESHOLD = 3.0

# Fixed value: the lines that state an anomaly.
FACTS = """- Source: %s
- Metric: %s
- Current value: %.4f
- 24h baseline mean: %.4f
- 24h baseline std dev: %.4f
- Z-score: %.2f (threshold: %.1f)"""


def _error_count() -> Column:
    return F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))


def _stats(value: Column, name: str) -> list[Column]:
    return [
        F.coalesce(F.avg(value), F.lit(0.0)).alias(f"{name}_mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{name}_stddev"),
    ]


def sources_between(counts: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    return between(counts, start, end, "bucket").select("source").distinct()


def source_baselines(
    counts: DataFrame, *, as_of: datetime | str, zero_fill: bool = False
) -> DataFrame:
    """Per source: mean and deviation of error rate and volume, and the current values.

    All sources in one job: 5-minute windows of the day before `as_of`, then one row per
    source. Baseline windows are those with traffic; `zero_fill` also counts the silent
    ones towards volume, without building them.
    """
    now = as_datetime(as_of)
    split = now - CURRENT
    is_current = F.col("bucket") >= ts_lit(split)
    windows = (
        between(counts, now - BASELINE, now, "bucket")
        .groupBy(
            "source",
            is_current.alias("current"),
            floor_to(F.col("bucket"), "5 minutes").alias("window"),
        )
        .agg(F.sum("count").alias("total"), _error_count().alias("errors"))
    )
    past = ~F.col("current")
    rate = F.when(past, F.col("errors") / F.col("total"))
    volume = F.when(past, F.col("total")).cast("double")
    out = windows.groupBy("source").agg(
        *_stats(rate, "error_rate"),
        *_stats(volume, "event_count"),
        F.count(volume).alias("windows"),
        F.coalesce(F.sum(F.when(~past, F.col("total"))), F.lit(0)).alias("current_total"),
        F.coalesce(F.sum(F.when(~past, F.col("errors"))), F.lit(0)).alias("current_errors"),
        F.coalesce(F.sum(volume), F.lit(0.0)).alias("_sum"),
        F.coalesce(F.sum(volume * volume), F.lit(0.0)).alias("_squares"),
    )
    if zero_fill:
        n = F.lit(float((BASELINE - CURRENT) / CURRENT))
        mean = F.col("_sum") / n
        spread = (F.col("_squares") - n * mean * mean) / (n - 1)
        out = out.withColumn(
            "event_count_stddev", F.sqrt(F.greatest(spread, F.lit(0.0)))
        ).withColumn("event_count_mean", mean)
    current_rate = F.when(
        F.col("current_total") > 0, F.col("current_errors") / F.col("current_total")
    ).otherwise(0.0)
    return out.drop("_sum", "_squares").withColumn("current_error_rate", current_rate)


def z_scores(baselines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per source and metric with its z-score and verdict.

    Error rates are flagged upwards only, volumes both ways, nothing on zero deviation.
    """

    def reading(metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            F.col(f"{metric}_mean").alias("mean"),
            F.col(f"{metric}_stddev").alias("stddev"),
        )

    readings = F.array(
        reading("error_rate", F.col("current_error_rate")),
        reading("event_count", F.col("current_total")),
    )
    rows = baselines.select("source", F.explode(readings).alias("_r")).select("source", "_r.*")
    scored = rows.withColumn(
        "z_score", F.when(F.col("stddev") > 0, (F.col("value") - F.col("mean")) / F.col("stddev"))
    )
    height = F.when(F.col("metric") == "error_rate", F.col("z_score")).otherwise(F.abs("z_score"))
    return scored.withColumn("anomalous", F.coalesce(height > threshold, F.lit(False)))


def detect_anomalies(
    counts: DataFrame,
    *,
    as_of: datetime | str,
    threshold: float = THRESHOLD,
    zero_fill: bool = False,
) -> DataFrame:
    scored = z_scores(source_baselines(counts, as_of=as_of, zero_fill=zero_fill), threshold)
    return scored.where("anomalous").drop("anomalous")


def describe(anomalies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `facts`, the fixed-format lines about each anomaly."""
    facts = F.format_string(
        FACTS, "source", "metric", "value", "mean", "stddev", "z_score", F.lit(threshold)
    )
    return anomalies.withColumn("facts", facts)


def iqr_outliers(counts: DataFrame, width: str = "1 hour", factor: float = 1.5) -> DataFrame:
    """Windows whose volume lies beyond `factor` interquartile ranges, per source."""
    volumes = counts.groupBy("source", floor_to(F.col("bucket"), width).alias("window")).agg(
        F.sum("count").alias("total")
    )
    quartiles = exact_percentiles(volumes, ["source"], "total", {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * factor
    outside = (F.col("total") < F.col("q1") - reach) | (F.col("total") > F.col("q3") + reach)
    return salted_join(volumes, quartiles, ["source"], ["window"]).where(outside)


def rolling_outliers(counts: DataFrame, sigmas: float = THRESHOLD) -> DataFrame:
    """Source minutes above the mean of the 24 hours before by `sigmas` deviations.

    A minute looks back over minutes with traffic. Mean and deviation come from exact
    integer sums, in time linear in the number of minutes.
    """
    day = int(BASELINE.total_seconds())
    per_minute = (
        counts.groupBy("source", "bucket")
        .agg(F.sum("count").alias("total"))
        .withColumn("_second", epoch_seconds(F.col("bucket")))
    )
    total = F.col("total")
    sums = {"n": F.lit(1).cast("bigint"), "x": total, "xx": total * total}
    rolled = trailing_sums(per_minute, ["source"], "_second", sums, (day, 1), day)
    mean = F.col("x") / F.col("n")
    spread = (F.col("xx") - F.col("x") * mean) / (F.col("n") - 1)
    scored = rolled.where(F.col("n") > 1).select(
        "source", "bucket", "total", mean.alias("mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("stddev"),
    )
    return scored.where((F.col("stddev") > 0) & (total > F.col("mean") + sigmas * F.col("stddev")))


def latency_outliers(
    ev: DataFrame, *, width: str = "1 hour", sigmas: float = THRESHOLD
) -> DataFrame:
    """Windows whose exact p99 latency exceeds the source's mean p99 by `sigmas` deviations."""
    timed = ev.select(
        "source", floor_to(F.col("timestamp"), width).alias("window"), duration_ms().alias("ms")
    )
    tails = exact_percentiles(timed, ["source", "window"], "ms", {"p99": 0.99})
    usual = tails.groupBy("source").agg(
        F.avg("p99").alias("mean"), F.stddev_samp("p99").alias("stddev")
    )
    joined = salted_join(tails, usual, ["source"], ["window"])
    return joined.where(
        (F.col("stddev") > 0) & (F.col("p99") > F.col("mean") + sigmas * F.col("stddev"))
    )


def seasonal_thresholds(hours: DataFrame, sigmas: float = THRESHOLD) -> DataFrame:
    """Alert threshold per source, weekday (Monday = 0) and hour: mean + `sigmas` deviations."""
    volumes = hours.groupBy("source", "bucket").agg(F.sum("count").alias("total"))
    season = volumes.groupBy(
        "source", F.weekday("bucket").alias("weekday"), F.hour("bucket").alias("hour")
    ).agg(
        F.avg("total").alias("mean"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("stddev"),
        F.count("*").alias("samples"),
    )
    return season.withColumn("threshold", F.col("mean") + sigmas * F.col("stddev"))


def above_season(hours: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Source hours whose volume exceeds the threshold of their weekday and hour."""
    keyed = (
        hours.groupBy("source", "bucket")
        .agg(F.sum("count").alias("total"))
        .withColumn("weekday", F.weekday("bucket"))
        .withColumn("hour", F.hour("bucket"))
    )
    joined = keyed.join(thresholds, ["source", "weekday", "hour"])
    return joined.where(F.col("total") > F.col("threshold")).select(
        "source", "bucket", "total", "threshold"
    )


def user_velocity(
    ev: DataFrame, *, window: int = 120, slot: int = 3600, sigmas: float = THRESHOLD
) -> DataFrame:
    """Seconds in which a user's trailing `window` seconds hold unusually many events.

    Events are first counted per user and second. Each second is copied into the stretches of at least `slot` seconds
    that look back at it, so that a stretch is summed on its own, after one exchange and over at most `window` rows a
    second; the user's own mean and deviation come back by a salted join.
    """
    seconds = (
        ev.withColumn("at_second", epoch_seconds(F.col("timestamp")))
        .groupBy("user_id", "at_second")
        .agg(F.count("*").alias("_n"))
    )
    copied = with_lookback(seconds, F.col("at_second"), max(slot, 2 * window), window)
    trailing = W.partitionBy("user_id", "_slot").orderBy("at_second").rangeBetween(-window, 0)
    speeds = copied.withColumn("recent", F.sum("_n").over(trailing)).where("_own").select("user_id", "at_second", "recent")
    usual = speeds.groupBy("user_id").agg(
        F.avg("recent").alias("mean"), F.stddev_samp("recent").alias("stddev")
    )
    z = (F.col("recent") - F.col("mean")) / F.col("stddev")
    joined = salted_join(speeds, usual, ["user_id"], ["at_second"])
    return joined.where(F.col("stddev") > 0).withColumn("z_score", z).where(
        F.col("z_score") > sigmas
    )


def growth(
    gauges: DataFrame,
    *,
    limit: float,
    value: str = "value",
    column: str = "timestamp",
) -> DataFrame:
    """Linear trend of a gauge per source and the hours until it reaches `limit`.

    Time is measured in hours since the start of 2024 to keep the sums small.
    """
    hours = (epoch_seconds(F.col(column)) - F.lit(1_704_067_200)) / F.lit(3600.0)
    rows = gauges.select("source", F.col(value).alias("_y"), hours.alias("_x"))
    trend = rows.groupBy("source").agg(
        F.regr_slope("_y", "_x").alias("slope_per_hour"),
        F.regr_intercept("_y", "_x").alias("_start"),
        F.max("_x").alias("_last"),
    )
    level = F.col("_start") + F.col("slope_per_hour") * F.col("_last")
    return trend.select(
        "source",
        "slope_per_hour",
        level.alias("level"),
        F.when(
            F.col("slope_per_hour") > 0,
            F.greatest((F.lit(limit) - level) / F.col("slope_per_hour"), F.lit(0.0)),
        ).alias("hours_to_limit"),
    )


def preceding_deployment(
    anomalies: DataFrame, deployments: DataFrame, *, hours: int = 6
) -> DataFrame:
    """Latest deployment of the same source in the hours before each anomaly, if any.

    Both sides have source and timestamp; deployments also have event_id. One sorted pass
    per source and time slot carries the last deployment forward; no pairs are built.
    """
    reach = hours * 3600
    marks = anomalies.select(
        "source", "timestamp", F.lit(None).cast("string").alias("_id"), F.lit(1).alias("_kind")
    )
    deploys = deployments.select(
        "source", "timestamp", F.col("event_id").alias("_id"), F.lit(0).alias("_kind")
    )
    both = deploys.unionByName(marks).withColumn("_at", epoch_seconds(F.col("timestamp")))
    upto = (
        W.partitionBy("source", "_slot")
        .orderBy("timestamp", "_kind", "_id")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    deployed = F.when(F.col("_kind") == 0, F.struct("timestamp", "_id"))
    # Anomalies stay in their own slot; only deployments are looked back at.
    carried = (
        with_lookback(both, F.col("_at"), reach, reach)
        .where((F.col("_kind") == 0) | F.col("_own"))
        .withColumn("_last", F.last(deployed, ignorenulls=True).over(upto))
        .where(F.col("_kind") == 1)
    )
    recent = F.col("_last.timestamp") >= F.col("timestamp") - F.make_dt_interval(
        hours=F.lit(hours)
    )
    return carried.select(
        "source",
        "timestamp",
        F.when(recent, F.col("_last._id")).alias("deployment_id"),
        F.when(recent, F.col("_last.timestamp")).alias("deployed_at"),
    )
