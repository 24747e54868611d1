"""Alert lifecycle as a stream: a source fires when a window breaches and resolves when a window passes calmly."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventloom.schemas import is_error
from eventloom.streaming.jobs import start_batches
from eventloom.streaming.state import keep_state
from eventloom.streaming.tables import read_table, write_batch

CHANGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("fired_at", T.TimestampType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("errors", T.LongType()),
    ]
)
_OPEN = T.StructType(
    [
        T.StructField("fired_at", T.LongType()),
        T.StructField("until", T.LongType()),
        T.StructField("errors", T.LongType()),
    ]
)


def _moment(micros: int) -> datetime:
    return pd.Timestamp(micros, unit="us").to_pydatetime()


class Lifecycle(StatefulProcessor):
    """Per source the open alert, and a timer at the end of the window that could still prolong it.

    Input are breaching windows that no event can change any more. A window's row and the timer of the
    alert it prolongs come due in the same batch, rows first, so a timer that goes off means silence.
    """

    def __init__(self, width_micros: int):
        self.width = width_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", _OPEN)

    def _resolved(self, source: str) -> tuple:
        fired_at, until, errors = self.alert.get()
        self.alert.clear()
        return source, "resolved", _moment(fired_at), _moment(until), errors

    def _timer(self, until: int) -> int:
        return (until + self.width) // 1000

    @staticmethod
    def _frame(changes: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(changes, columns=CHANGES.fieldNames())
        return frame.astype({"fired_at": "datetime64[us]", "resolved_at": "datetime64[us]", "errors": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = []
        windows = sorted(pair for part in rows for pair in zip(part["begin"].tolist(), part["errors"].tolist(), strict=True))
        for begin, errors in windows:
            if self.alert.exists():
                fired_at, until, so_far = self.alert.get()
                self.handle.deleteTimer(self._timer(until))
                if begin > until:
                    changes.append(self._resolved(key[0]))
            if self.alert.exists():
                self.alert.update((fired_at, begin + self.width, so_far + errors))
            else:
                changes.append((key[0], "firing", _moment(begin), None, None))
                self.alert.update((begin, begin + self.width, errors))
            self.handle.registerTimer(self._timer(begin + self.width))
        if changes:
            yield self._frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.alert.exists():
            yield self._frame([self._resolved(key[0])])

    def close(self) -> None:
        pass


def lifecycle_changes(events: DataFrame, *, threshold: int, width_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Streamed rows (source, status, fired_at, resolved_at, errors) of alerts on `error count >= threshold`.

    Windows are counted by Spark, so a source has one row per window here, however many events it sends.
    All events move the watermark, not only errors. A window is judged `delay` after its end; events
    that come later no longer count.
    """
    width = f"{width_seconds} seconds"
    counted = (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width), "source")
        .agg(F.count_if(is_error(F.col("severity"))).alias("errors"))
    )
    breaching = counted.where(F.col("errors") >= threshold).select(
        "source", F.unix_micros("window.start").alias("begin"), "errors", F.col("window.end").alias("until")
    )
    return breaching.groupBy("source").transformWithStateInPandas(
        Lifecycle(width_seconds * 1_000_000), CHANGES, "Append", "EventTime"
    )


def start_lifecycle(
    events: DataFrame,
    root: str,
    checkpoint: str,
    *,
    threshold: int,
    width_seconds: int = 3600,
    delay: str = "10 minutes",
    interval: str | None = None,
) -> StreamingQuery:
    """Write the changes of `lifecycle_changes` to the table `lifecycle`; a repeated batch replaces itself."""
    keep_state(events.sparkSession)
    changes = lifecycle_changes(events, threshold=threshold, width_seconds=width_seconds, delay=delay)

    def step(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, root, "lifecycle", batch_id, "fired_at")

    return start_batches(changes, step, checkpoint, interval)


def lifecycle_spans(spark: SparkSession, root: str) -> DataFrame:
    """One row per alert: source, status, fired_at, and once it is resolved, resolved_at and errors."""
    changes = read_table(spark, root, "lifecycle")
    return changes.groupBy("source", "fired_at").agg(
        F.when(F.max("resolved_at").isNull(), "firing").otherwise("resolved").alias("status"),
        F.max("resolved_at").alias("resolved_at"),
        F.max("errors").alias("errors"),
    )
