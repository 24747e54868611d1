"""Where streaming queries keep their state, and the settings that their batches are worked on with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ADAPTIVE = "spark.sql.adaptive.enabled"


def keep_state(spark: SparkSession) -> None:
    """Let queries started from now on keep their state in RocksDB, off the heap; a provider chosen before stays."""
    chosen = spark.conf.get(_PROVIDER, None)
    if chosen is None or chosen.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, ROCKSDB)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None = None) -> Iterator[int]:
    """Queries started inside cut their state into `partitions`, by default one per core; yields the usual number.

    Every partition is a RocksDB that each micro-batch opens and commits, however little it holds, so their number goes
    by the cores and not by the shuffle partitions, which are set for the largest shuffle. It is fixed by the
    first start with a checkpoint: give one that shall hold far more than the cores' share of disk more partitions.
    """
    usual = int(spark.conf.get(_PARTITIONS))
    if partitions is None:
        partitions = min(usual, max(spark.sparkContext.defaultParallelism, 8))
    with _set(spark, {_PARTITIONS: str(partitions)}):
        yield usual


def batch_settings(spark: SparkSession, partitions: int):
    """Adaptive execution inside a micro-batch, where Spark turns it off for the sake of the state's partitions.

    What a batch is written from is planned anew, after the state, and may follow the batch's size. The settings go
    back before the next micro-batch is planned.
    """
    return _set(spark, {_ADAPTIVE: "true", _PARTITIONS: str(partitions)})
