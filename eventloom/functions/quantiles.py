"""Exact interpolated percentiles of groups too large for one aggregation buffer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_WIDTH = 1024


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    stats: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per key with a column per wanted fraction, interpolated like `percentile`.

    Rows are first counted per (key, value), which spreads a hot key over its values, then
    ranked by running counts per (key, value slot of width `SLOT_WIDTH`). Per key only slots
    meet, a few numbers each: their running count is the first row of a slot. No row holds an
    array. `stats` adds count, sum, min and max; `weight` names a column with the number of
    times a row counts.
    """
    slot = F.floor(F.col(value) / SLOT_WIDTH)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, slot.alias("_slot"), F.col(value).alias("_v"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    )
    slots = counted.groupBy(*keys, "_slot").agg(F.sum("_n").alias("_held"))
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = slots.select(
        *keys,
        "_slot",
        F.lit(0).alias("_row"),
        F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_n"),
        F.sum("_held").over(whole).alias("_size"),
    )
    stitched = counted.withColumn("_row", F.lit(1)).unionByName(offsets, allowMissingColumns=True)
    upto = W.partitionBy(*keys, "_slot").orderBy("_row", "_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = stitched.select(
        *keys, "_v", "_n", "_row", F.sum("_n").over(upto).alias("_upto"), F.max("_size").over(upto).alias("_rows")
    ).where("_row = 1")

    def at(index: Column) -> Column:
        """The value that stands at a rank of its group."""
        here = (index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto"))
        return F.max(F.when(here, F.col("_v")))

    picks, out = [], []
    for name, fraction in wanted.items():
        position = F.lit(fraction) * (F.col("_rows") - 1)
        picks += [at(F.floor(position)).alias(f"_{name}_low"), at(F.ceil(position)).alias(f"_{name}_high")]
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        share = F.lit(fraction) * (F.col("count") - 1)
        out.append((low + (high - low) * (share - F.floor(share))).alias(name))
    if stats:
        picks += [
            F.sum(F.col("_v") * F.col("_n")).alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("_rows").alias("count"), *picks)
    return picked.select(*keys, *(["count", "sum", "min", "max"] if stats else []), *out)
