"""Mergeable exact distinct counts: values get numbers, hours keep bitmaps of them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions.timeops import floor_to
from eventloom.plans.pruning import between

SLOTS = 1024


def number_values(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(value, number) of each different value, numbers from 0 on without gaps; those of `known` keep theirs.

    New values are numbered inside slots of their hash, and only the sizes of the slots meet in one task. Write the
    result before it is used: numbers follow from the values alone, so a repeated run gives the same.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    first = F.lit(0)
    if known is not None:
        values = values.join(known.select("value"), "value", "left_anti")
        top = known.agg((F.coalesce(F.max("number"), F.lit(-1)) + 1).alias("first")).first()["first"]
        first = F.lit(top)
    slotted = values.withColumn("slot", F.pmod(F.xxhash64("value"), F.lit(SLOTS)))
    sizes = slotted.groupBy("slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("slot", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("slot").orderBy("value"))
    fresh = slotted.withColumn("place", place).join(offsets, "slot")
    numbered = fresh.select("value", (first + F.col("before") + F.col("place") - 1).cast("bigint").alias("number"))
    return numbered if known is None else known.select("value", "number").unionByName(numbered)


def hour_bitmaps(ev: DataFrame, column: str, numbers: DataFrame, keys: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """Per window, `keys` and part of the numbers: a bitmap of the values seen, 4 KB for each 32 768 numbers.

    Values are looked up once per window and value. A null value is not counted.
    """
    seen = ev.select(floor_to(F.col("timestamp"), width).alias("bucket"), *keys, F.col(column).alias("value")).distinct()
    numbered = seen.join(numbers, "value")
    return numbered.groupBy("bucket", *keys, F.bitmap_bucket_number("number").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )


def distinct_between(
    bitmaps: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    keys: Sequence[str] = (),
    width: str | None = None,
) -> DataFrame:
    """Exact number of distinct values over `[start, end)`, in total or per `keys` and window, from bitmaps alone.

    Bounds are those of the stored windows. Bitmaps of a part are combined before the shuffle; parts are then added up.
    """
    window = [floor_to(F.col("bucket"), width).alias("bucket")] if width else []
    names = [*(["bucket"] if width else []), *keys]
    merged = between(bitmaps, start, end, "bucket").groupBy(*window, *keys, "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    counted = merged.select(*names, F.bitmap_count("bitmap").alias("n"))
    return counted.groupBy(*names).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_values"))
