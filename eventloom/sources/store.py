"""JSON and Parquet sources and sinks of the event tables, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.schemas import EVENT, EVENT_INPUT

# Timestamps of a batch arrive as text; a value that is no timestamp quarantines its event.
BATCH = T.StructType(
    [
        T.StructField("events", T.ArrayType(EVENT_INPUT)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batches `{"events": [...]}`, one per line, malformed lines in `_corrupt_record`."""
    return spark.read.schema(BATCH).json(path)


def stream_event_batches(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same as a stream; `max_files` bounds what one micro-batch takes (backpressure)."""
    return spark.readStream.schema(BATCH).option("maxFilesPerTrigger", max_files).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The day-partitioned event table; `event_date` prunes folders."""
    schema = T.StructType([*EVENT.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def with_day(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn("event_date", F.to_date(column))


def write_by_day(
    df: DataFrame,
    path: str,
    column: str = "timestamp",
    extra: Sequence[str] = (),
    sort: Sequence[str] = ("source", "timestamp"),
    ids: Sequence[str] = (),
    dealt: bool = False,
) -> None:
    """Replace the day partitions that `df` touches and leave the others alone.

    The rebalance hint lets adaptive execution split a hot day over several writers and
    merge thin days; rows are sorted inside files so that Parquet statistics prune. Of the columns in `ids`
    each row group keeps a bloom filter, so that a look-up by id reads only the row groups that can hold it. Rows that
    are `dealt` by day already are written from where they lie.
    """
    parts = ["event_date", *extra]
    blooms = {"parquet.bloom.filter.adaptive.enabled": "true"}
    for c in ids:
        # Unique values: a dictionary of them would only cost room, and would be written in place of the filter.
        blooms |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.enable.dictionary#{c}": "false"}
    df = with_day(df, column)
    (
        (df if dealt else df.hint("rebalance", *parts))
        .sortWithinPartitions(*parts, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**blooms)
        .partitionBy(*parts)
        .parquet(path)
    )
