"""Time predicates that also prune day partitions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timeops import as_datetime, ts_lit


def between(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    column: str = "timestamp",
    day: str = "event_date",
) -> DataFrame:
    """Rows of `[start, end)`; the day column, where there is one, gets its own bounds."""
    has_day = day in df.columns
    if start is not None:
        df = df.where(F.col(column) >= ts_lit(start))
        if has_day:
            df = df.where(F.col(day) >= F.lit(as_datetime(start).date()))
    if end is not None:
        df = df.where(F.col(column) < ts_lit(end))
        if has_day:
            last = (as_datetime(end) - timedelta(microseconds=1)).date()
            df = df.where(F.col(day) <= F.lit(last))
    return df
