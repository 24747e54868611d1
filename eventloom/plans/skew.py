"""Joins, ranks and neighbours that stay balanced when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = (16, 256)


def salts_of(df: DataFrame) -> int:
    """Groups for the rows of a hot key: a quarter of the shuffle partitions, within `SALTS`."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(SALTS[0], partitions // 4), SALTS[1])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join of a left side with hot keys to a right side with few rows per key.

    Left rows spread over `salts` groups (by default `salts_of`) by a hash of `salt_by` (columns that differ
    within a hot key; a hash, not a random number, so a retried task repeats itself).
    Each right row is repeated once per group. No side is hinted: adaptive execution
    broadcasts the right side only when its measured size is below the threshold.
    """
    salts = salts or salts_of(left)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    spread = left.withColumn("_salt", salt)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def keep_one(df: DataFrame, keys: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """One row per key, the least by `first_by` and then by the other columns.

    An aggregate, not a ranking: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [*first_by, *(c for c in rest if c not in first_by)]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_row"))
        .select(*keys, *(F.col("_row")[c].alias(c) for c in rest))
        .select(*df.columns)
    )


def _same(keys: Sequence[str]) -> list[str]:
    return [*keys, "_slot"]


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    slot: Column,
    order: Sequence[str],
    values: Mapping[str, str],
) -> DataFrame:
    """Inclusive running sums per key, named by the keys of `values`, slot by slot.

    `slot` must grow with `order`. Each (key, slot) is summed on its own, starting from
    the totals of the slots before it, so a hot key never runs through a single task.
    """
    cut = df.withColumn("_slot", slot)
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*_same(keys)).agg(*(F.sum(column).alias(column) for column in set(values.values())))
    # The total before a slot joins the slot as its first row; nulls make keys like any other.
    offsets = totals.select(
        *_same(keys),
        F.lit(0).alias("_row"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in set(values.values())),
    )
    upto = (
        W.partitionBy(*_same(keys))
        .orderBy("_row", *order)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    stitched = cut.withColumn("_row", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    kept = [c for c in df.columns if c not in values]
    return stitched.select(
        *kept, "_row", *(F.sum(column).over(upto).alias(name) for name, column in values.items())
    ).where(F.col("_row") == 1).drop("_row")


def running_sum(
    df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str], value: str, name: str
) -> DataFrame:
    return running_sums(df, keys, slot, order, {name: value})


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Mapping[str, Column],
    reach: tuple[int, int],
    width: int,
) -> DataFrame:
    """Sums over the key's rows from `at - reach[0]` to `at - reach[1]`, both included.

    Each row enters a running sum when it comes into reach and leaves it afterwards, which
    costs three rows per row whatever the frame holds. `at` is integral, and values should
    be too, as sums are taken back by subtraction.
    """
    back, gap = reach
    moments = F.array(
        F.struct((F.col(at) + gap).alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("sign")),
        F.struct((F.col(at) + back + 1).alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
    )
    steps = df.withColumn("_m", F.explode(moments)).select(
        *df.columns,
        F.col("_m.t").alias("_at"),
        F.col("_m.kind").alias("_kind"),
        *((value * F.col("_m.sign")).alias(f"_{name}") for name, value in values.items()),
    )
    summed = running_sums(
        steps, keys, F.floor(F.col("_at") / width), ["_at", "_kind"], {n: f"_{n}" for n in values}
    )
    return summed.where(F.col("_kind") == 1).select(*df.columns, *values)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    slot: Column,
    order: Sequence[str],
    columns: Sequence[str],
    name: str,
) -> DataFrame:
    """Struct of `columns` of the row before, per key; null for a key's first row.

    Neighbours are found inside (key, slot); only the last row of each slot crosses into
    the next one. `slot` must grow with `order`, and `order` must be unique per key.
    """
    cut = df.withColumn("_slot", slot).withColumn("_value", F.struct(*columns))
    across = W.partitionBy(*keys).orderBy("_slot")
    edges = (
        cut.groupBy(*_same(keys))
        .agg(F.max_by("_value", F.struct(*order)).alias("_last"))
        .select(*_same(keys), F.lit(0).alias("_row"), F.lag("_last").over(across).alias("_value"))
    )
    inner = W.partitionBy(*_same(keys)).orderBy("_row", *order)
    stitched = cut.withColumn("_row", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    return (
        stitched.withColumn(name, F.lag("_value").over(inner))
        .where(F.col("_row") == 1)
        .drop("_slot", "_value", "_row")
    )


def with_lookback(df: DataFrame, seconds: Column, width: int, lookback: int) -> DataFrame:
    """Copy each row into its own time slot and those that look back at it.

    Adds `_slot` and `_own`. A trailing frame of at most `lookback` seconds can then be
    partitioned by (key, `_slot`); keep `_own` rows afterwards. Rows grow by a factor of
    at most `1 + ceil(lookback / width)`.
    """
    own = F.floor(seconds / width)
    reach = F.floor((seconds + lookback) / width)
    return (
        df.withColumn("_home", own)
        .withColumn("_slot", F.explode(F.sequence(own, reach)))
        .withColumn("_own", F.col("_slot") == F.col("_home"))
        .drop("_home")
    )
