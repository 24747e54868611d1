"""Placement of documents on shards by a permutation-filled lookup table.

Each shard walks the slots of a prime-sized table in an order of its own, and the shards take turns in
claiming their next free slot. All shards own nearly equally many slots, and when a
shard comes or goes few slots change hands. The table has `slots` entries whatever the data
hold; it is broadcast, and a document finds its shard by one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import unused

SLOTS = 8191
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of each slot. `slots` must be a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime above the number of shards, of which there must be one")
    # With a prime size every skip visits all slots.
    walks = [(_number(f"offset|{s}") % slots, _number(f"skip|{s}") % (slots - 1) + 1) for s in shards]
    table: list[str | None] = [None] * slots
    step = [0] * len(shards)
    free = slots
    while True:
        for i, (offset, skip) in enumerate(walks):
            while table[at := (offset + step[i] * skip) % slots] is not None:
                step[i] += 1
            table[at] = shards[i]
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard); as many rows as slots."""
    rows = list(enumerate(lookup_table(shards, slots)))
    return spark.createDataFrame(rows, "slot int, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key's text; 60 bits of its MD5."""
    digits = F.substring(F.md5(key.cast("string")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What places a row: its id, or its text where it has none."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("text|"), F.col(f"`{text}`")), F.lit("text|"))


def assign_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """One row per document: doc_id, slot, shard.

    Rows that share an id share a shard. Rows without an id are placed by their text, so that
    they do not all meet on one shard; a null text counts as empty. Other columns are not read,
    and an empty table gives an empty result. Documents are not shuffled.
    """
    key = key_of(doc_id, text)
    placed = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), slot_of(key, slots).alias("slot"))
    table = table_frame(docs.sparkSession, shards, slots)
    # The table has a fixed number of rows, under 200 kB with the default size.
    return placed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str) -> None:
    """Write whole documents as Parquet below `path`, one folder per shard, as `assign_shards` places them.

    A shard is written by as many tasks as its size asks for. Of the documents' columns only `shard` gives way to that
    of the folders.
    """
    slot, shard = unused(docs.columns, "slot", "to_shard")
    table = table_frame(docs.sparkSession).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    rows = docs.withColumn(slot, slot_of(key_of())).join(F.broadcast(table), slot).drop(slot, "shard")
    rows.withColumnRenamed(shard, "shard").hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
