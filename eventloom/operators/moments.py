"""Stored moments of windows, merged to baselines instead of counting the same day again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.timeops import as_datetime, floor_to, truncate_hour, ts_lit
from eventloom.operators.anomaly import BASELINE, CURRENT
from eventloom.plans.pruning import between
from eventloom.schemas import is_error

METRICS = ("error_rate", "event_count")
HOUR = timedelta(hours=1)


def _windows(counts: DataFrame, width: str) -> DataFrame:
    errors = F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))
    return counts.groupBy("source", floor_to(F.col("bucket"), width).alias("window")).agg(
        F.sum("count").alias("total"), errors.alias("errors")
    )


def _moments(value: Column, name: str) -> list[Column]:
    return [
        F.avg(value).alias(f"{name}_mean"),
        (F.coalesce(F.var_pop(value), F.lit(0.0)) * F.count(value)).alias(f"{name}_m2"),
    ]


def _summed(windows: DataFrame, *keys: Column | str) -> DataFrame:
    rate, volume = F.col("errors") / F.col("total"), F.col("total").cast("double")
    return windows.groupBy("source", *keys).agg(
        F.count("*").alias("n"), *_moments(rate, "error_rate"), *_moments(volume, "event_count")
    )


def hour_moments(counts: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Per source and hour: n, mean and M2 (sum of squared deviations) of error rate and volume of its windows with traffic.

    Written by day, a day's rows are made once, when it is over, and dropped with `expire`.
    """
    return _summed(_windows(counts, width), floor_to(F.col("window"), "1 hour").alias("bucket"))


def merge_moments(moments: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Moments of all rows of a key together, by the pairwise update.

    M2 of a union is the sum of the parts' M2 and of n times the squared distance of each part's mean from the
    common one. Deviations are taken from that mean, so no large numbers cancel out. A key has a row per hour.
    """
    whole = W.partitionBy(*keys)
    n = F.sum("n").over(whole)
    shifted = moments
    for m in METRICS:
        shifted = shifted.withColumn(f"_{m}", F.sum(F.col("n") * F.col(f"{m}_mean")).over(whole) / n)
    out = []
    for m in METRICS:
        apart = F.col(f"{m}_mean") - F.col(f"_{m}")
        out += [F.first(f"_{m}").alias(f"{m}_mean"), F.sum(F.col(f"{m}_m2") + F.col("n") * apart * apart).alias(f"{m}_m2")]
    return shifted.groupBy(*keys).agg(F.sum("n").alias("n"), *out)


def stored_baselines(moments: DataFrame, counts: DataFrame, *, as_of: datetime | str) -> DataFrame:
    """`anomaly.source_baselines` from stored hours: the same columns and values.

    Full hours of the day before `as_of` come from `moments`; of the minute counts only the two hours at the ends
    are read, and the current five minutes. `as_of` must lie on a full window of five minutes, as those of the
    moments do.
    """
    now = as_datetime(as_of)
    if now != now.replace(second=0, microsecond=0) or now.minute % 5:
        raise ValueError("as_of must lie on a window of five minutes")
    begin, split = now - BASELINE, now - CURRENT
    head = begin if begin == truncate_hour(begin) else truncate_hour(begin) + HOUR
    tail = truncate_hour(split)
    stored = between(moments, head, tail, "bucket").drop("bucket", "event_date")
    edges = between(counts, begin, head, "bucket").unionByName(between(counts, tail, now, "bucket"))
    windows = _windows(edges, "5 minutes")
    past = _summed(windows.where(F.col("window") < ts_lit(split)))
    merged = merge_moments(stored.select(past.columns).unionByName(past))
    current = windows.where(F.col("window") >= ts_lit(split)).groupBy("source").agg(
        F.sum("total").alias("current_total"), F.sum("errors").alias("current_errors")
    )

    def known(name: str, other: float = 0.0) -> Column:
        return F.coalesce(name, F.lit(other))

    stats = []
    for m in METRICS:
        spread = F.when(F.col("n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col("n") - 1)))
        stats += [known(f"{m}_mean").alias(f"{m}_mean"), F.coalesce(spread, F.lit(0.0)).alias(f"{m}_stddev")]
    total, errors = known("current_total", 0).cast("bigint"), known("current_errors", 0).cast("bigint")
    rate = F.when(total > 0, errors / total).otherwise(0.0)
    return merged.join(current, "source", "full").select(
        "source", *stats, known("n", 0).cast("bigint").alias("windows"), total.alias("current_total"),
        errors.alias("current_errors"), rate.alias("current_error_rate"),
    )


def stored_seasons(moments: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Thresholds per source, weekday and hour on five-minute volumes, merged from the same stored hours."""
    keyed = moments.withColumns({"weekday": F.weekday("bucket"), "hour": F.hour("bucket")})
    merged = merge_moments(keyed, ["source", "weekday", "hour"])
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("event_count_m2") / (F.col("n") - 1)))
    stddev = F.coalesce(spread, F.lit(0.0))
    return merged.select(
        "source", "weekday", "hour", F.col("event_count_mean").alias("mean"), stddev.alias("stddev"),
        F.col("n").alias("samples"), (F.col("event_count_mean") + sigmas * stddev).alias("threshold"),
    )
