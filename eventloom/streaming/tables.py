"""Tables that streaming jobs write batch by batch, so that a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.timeops import as_datetime
from eventloom.operators.ingest import append_new
from eventloom.operators.rollup import RETENTION_DAYS, coarser, minute_counts
from eventloom.plans.pruning import between
from eventloom.schemas import COUNT_KEY, EVENT, EVENT_COLUMNS
from eventloom.sources.store import with_day, write_by_day

_PARTS = [T.StructField("event_date", T.DateType()), T.StructField("batch_id", T.LongType())]
_COUNTS = [
    T.StructField("bucket", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("count", T.LongType()),
]
_ALERTS = [
    T.StructField("alert_event_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("fired_at", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("context", T.StringType()),
    T.StructField("notified", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("channels", T.StringType()),
]
_REJECTED = [
    T.StructField("source", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("payload", T.StringType()),
]
_QUARANTINE = [
    T.StructField("payload", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
]
_HANDLED = [
    T.StructField("id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("at", T.TimestampType()),
]
_LIFECYCLE = [
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("fired_at", T.TimestampType()),
    T.StructField("resolved_at", T.TimestampType()),
    T.StructField("errors", T.LongType()),
]
SCHEMAS = {
    "events": T.StructType([*EVENT.fields, *_PARTS]),
    "counts": T.StructType([*_COUNTS, *_PARTS]),
    "latest_counts": T.StructType([*_COUNTS, *_PARTS]),
    "alert_events": T.StructType([*_ALERTS, *_PARTS]),
    "rejected": T.StructType([*_REJECTED, *_PARTS]),
    "quarantine": T.StructType([*_QUARANTINE, *_PARTS]),
    "handled": T.StructType([*_HANDLED, *_PARTS]),
    "lifecycle": T.StructType([*_LIFECYCLE, *_PARTS]),
    "evaluations": T.StructType([T.StructField("until", T.TimestampType()), *_PARTS]),
    # Whole days replace each other here, so there are no batches.
    "hour_counts": T.StructType([*_COUNTS, _PARTS[0]]),
}
# The batch id of what compaction has merged: below those of batches and runs.
COMPACTED = -(1 << 40)
# Which rule of `RETENTION_DAYS` holds for a table.
KEPT_LIKE = {"events": "events", "counts": "event_counts_1m", "hour_counts": "event_counts_1h"}


def create_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(SCHEMAS)) -> None:
    """Empty tables where there are none yet."""
    for name in names:
        empty = spark.createDataFrame([], SCHEMAS[name])
        parts = [p.name for p in _PARTS if p.name in empty.columns]
        empty.write.mode("ignore").partitionBy(*parts).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_batch(df: DataFrame, root: str, name: str, batch_id: int, column: str, dealt: bool = False) -> None:
    """Write one batch's rows under its own partitions; a retry overwrites exactly those. `dealt` as in `write_by_day`."""
    tagged = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    columns = [c for c in SCHEMAS[name].fieldNames() if c != "event_date"]
    sort = [c for c in ("source", column) if c in columns]
    ids = ["event_id"] if name == "events" else []
    write_by_day(tagged.select(*columns), f"{root}/{name}", column, ["batch_id"], sort, ids, dealt)


def read_days(spark: SparkSession, root: str, name: str, days: Iterable[date]) -> DataFrame:
    """A table's rows of the given days. Only the folders of these days are listed and read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{root}/{name}/event_date={day}" for day in sorted(set(days))]
    there = [f for f in folders if fs.exists(path(f))]
    if not there:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).option("basePath", f"{root}/{name}").parquet(*there)


# The row groups of staged rows: neither a writer nor a reader holds more than one.
_STAGED = {"parquet.block.size": str(16 << 20)}


@contextmanager
def staged(rows: DataFrame, root: str, name: str, batch_id: int) -> Iterator[DataFrame]:
    """A batch's rows, put down beside the tables for as long as several steps read them.

    They are not persisted, as a batch may be of any size: to write cached rows to disk, Spark holds on to the last hundred
    column batches, up to 400 MB a task that it doesn't account for. A batch that is run again replaces what was left.
    """
    spark = rows.sparkSession
    place = f"{root}/_staged/{name}-{batch_id}"
    try:
        rows.write.mode("overwrite").options(**_STAGED).parquet(place)
        yield spark.read.schema(rows.schema).parquet(place)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store_events(rows: DataFrame, root: str, batch_id: int, unsure: Column | None = None) -> None:
    """Append the rows not stored by other batches, and count exactly those.

    Counting what is stored, not what arrived, keeps redelivered events from counting twice, and late
    ones count whenever they come: counts are per-batch deltas. Only the stored days of rows that are
    `unsure` (by default all) are looked at, day by day, so that one event of long ago costs one folder. The others
    must be known to be new, each once.
    """
    spark = rows.sparkSession
    unsure = F.lit(True) if unsure is None else unsure
    with staged(rows.select(*EVENT_COLUMNS, unsure.alias("_unsure")), root, "rows", batch_id) as rows:
        # Two rows per calendar day at most.
        found = rows.select("_unsure", F.to_date("timestamp").alias("day")).distinct().collect()
        if not found:
            return
        days = [r["day"] for r in found if r["_unsure"]]
        others = read_days(spark, root, "events", days).where(F.col("batch_id") != batch_id)
        checked = append_new(rows.where("_unsure").drop("_unsure"), others)
        if not days:
            fresh = rows.drop("_unsure")
        elif all(r["_unsure"] for r in found):
            fresh = checked
        else:
            fresh = rows.where("not _unsure").drop("_unsure").unionByName(checked)
        # Dealt by day once, in as many parts as the rows ask for; both tables are written from these.
        with staged(with_day(fresh).hint("rebalance", "event_date"), root, "fresh", batch_id) as fresh:
            write_batch(fresh, root, "events", batch_id, "timestamp", dealt=True)
            write_batch(minute_counts(fresh), root, "counts", batch_id, "bucket")


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """Minute counts over all batches."""
    deltas = read_table(spark, root, "counts")
    return deltas.groupBy(*COUNT_KEY, "event_date").agg(F.sum("count").alias("count"))


def _whole_days(start: datetime | str, end: datetime | str) -> tuple[datetime, datetime]:
    first, last = as_datetime(start), as_datetime(end) - timedelta(microseconds=1)
    return datetime.combine(first, time()), datetime.combine(last, time()) + timedelta(days=1)


def write_hours(spark: SparkSession, root: str, start: datetime | str, end: datetime | str) -> None:
    """Bring the hour table up to date for all days that `[start, end)` touches.

    Whole days are made again from the minute counts, so late events are in and a repeated
    run changes nothing.
    """
    minutes = between(stored_counts(spark, root), *_whole_days(start, end), "bucket")
    write_by_day(coarser(minutes, "1 hour"), f"{root}/hour_counts", "bucket", sort=("source", "bucket"))


def _folders(spark: SparkSession, path: str) -> tuple[object, list]:
    """The file system of a path and the partition folders below it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return fs, []
    return fs, [s.getPath() for s in fs.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()]


def _day_of(folder) -> date | None:
    text = folder.getName().partition("=")[2]
    return None if text.startswith("__") else date.fromisoformat(text)


def compact(spark: SparkSession, root: str, name: str, before: date) -> None:
    """Merge the batch folders of each day before `before` into one.

    Run it while nothing reads or writes the table. All days are first written beside it, then
    put into place one after the other; a run that was interrupted is finished by the next one.
    It needs a file system that renames folders as a whole. Late batches add new folders,
    which the next run merges.
    """
    staging = f"{root}/_compacting_{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, days = _folders(spark, f"{root}/{name}")
    if not fs.exists(path(f"{staging}/_SUCCESS")):
        many = [d for d in days if (day := _day_of(d)) and day < before and len(fs.listStatus(d)) > 1]
        if not many:
            return
        spread = F.col("event_date").isin([_day_of(d) for d in many])
        rows = read_table(spark, root, name).where(spread)
        if name in ("counts", "latest_counts"):
            rows = rows.groupBy(*COUNT_KEY, "event_date").agg(F.sum("count").alias("count"))
        columns = [c for c in SCHEMAS[name].fieldNames() if c != "batch_id"]
        sort = [c for c in ("source", "bucket", "timestamp") if c in columns]
        (
            rows.select(*columns, F.lit(COMPACTED).cast("bigint").alias("batch_id"))
            .hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", *sort)
            .write.mode("overwrite")
            .partitionBy("event_date", "batch_id")
            .parquet(staging)
        )
    for merged in _folders(spark, staging)[1]:
        target = path(f"{root}/{name}/{merged.getName()}")
        fs.delete(target, True)
        if not fs.rename(merged, target):
            raise OSError(f"cannot rename {merged} to {target}")
    fs.delete(path(staging), True)


def expire(spark: SparkSession, root: str, name: str, as_of: datetime | str) -> list[date]:
    """Delete the days of a table that are older than its retention; returns them."""
    oldest = as_datetime(as_of).date() - timedelta(days=RETENTION_DAYS[KEPT_LIKE[name]])
    fs, days = _folders(spark, f"{root}/{name}")
    old = [d for d in days if (day := _day_of(d)) and day < oldest]
    for folder in old:
        fs.delete(folder, True)
    return sorted(_day_of(d) for d in old)
