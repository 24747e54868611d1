"""Rates, increases, histograms and quantiles over counters and timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.timeops import floor_to
from eventloom.plans.skew import previous


def per_second_rate(
    df: DataFrame, keys: Sequence[str], width: str, seconds: int, column: str = "timestamp"
) -> DataFrame:
    """Events per second by key in each window of `seconds`."""
    return df.groupBy(floor_to(F.col(column), width).alias("bucket"), *keys).agg(
        (F.count("*") / F.lit(seconds)).alias("rate")
    )


def increase(
    samples: DataFrame,
    keys: Sequence[str],
    width: str = "1 hour",
    column: str = "timestamp",
    value: str = "value",
) -> DataFrame:
    """Growth of a counter inside each window, taking a drop as a restart from zero.

    Neighbours are found minute by minute, so a densely sampled counter is split.
    """
    windowed = samples.select(*keys, column, value).withColumn(
        "bucket", floor_to(F.col(column), width)
    )
    order = [column, value]
    stepped = previous(
        windowed, [*keys, "bucket"], F.date_trunc("minute", column), order, [value], "_last"
    )
    before = F.col("_last")[value]
    zero = F.lit(0).cast(samples.schema[value].dataType)
    step = (
        F.when(F.col("_last").isNull(), zero)
        .when(F.col(value) < before, F.col(value))
        .otherwise(F.col(value) - before)
    )
    return stepped.groupBy("bucket", *keys).agg(F.sum(step).alias("increase"))


def _le(bound: float) -> Column:
    return F.lit(float(bound))


def cumulative_histogram(
    df: DataFrame, value: Column, bounds: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Rows (keys, le, count) with all values up to each bound; the last bound is infinite.

    One conditional count per bound in a single partial aggregate, then one row per bound.
    """
    measured = df.withColumn("_v", value)
    counts = [F.count_if(F.col("_v") <= _le(b)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = measured.groupBy(*keys).agg(*counts, F.count("_v").alias("_binf"))
    steps = [
        F.struct(_le(b).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)
    ]
    steps.append(F.struct(_le(float("inf")).alias("le"), F.col("_binf").alias("count")))
    return wide.select(*keys, F.explode(F.array(*steps)).alias("_s")).select(*keys, "_s.*")


def histogram_quantile(
    histogram: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches each quantile's rank.

    A rank in the infinite bucket gives the largest finite bound.
    """
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ordered = by_key.orderBy("le")
    infinite = F.col("le") == _le(float("inf"))
    spread = (
        histogram.withColumn("_from", F.coalesce(F.lag("le").over(ordered), F.lit(0.0)))
        .withColumn("_below", F.coalesce(F.lag("count").over(ordered), F.lit(0)))
        .withColumn("_all", F.max("count").over(by_key))
        .withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
        .withColumn("_rank", F.col("quantile") * F.col("_all"))
    )
    # A rank of zero belongs to the first bucket, which has nothing below it.
    reached = (F.col("count") >= F.col("_rank")) & (
        (F.col("_below") < F.col("_rank")) | ((F.col("_rank") == 0) & (F.col("_from") == 0))
    )
    share = (F.col("_rank") - F.col("_below")) / F.nullif(F.col("count") - F.col("_below"), F.lit(0))
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * share
    return spread.where(reached & (F.col("_all") > 0)).select(
        *keys, "quantile", F.when(infinite, F.col("_from")).otherwise(inside).alias("value")
    )


def outcomes(df: DataFrame, column: str) -> DataFrame:
    """Count per status or per failing stage."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("total"))
