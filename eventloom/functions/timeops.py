"""Time literals, buckets and named ranges. Every operator takes its own `as_of`."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range shorthands and alert window names.
RANGES = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}
ALERT_WINDOWS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}
DEFAULT_ALERT_WINDOW = "5m"


def as_datetime(value: datetime | str) -> datetime:
    """Naive UTC datetime from a datetime or ISO text."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def ts_lit(value: datetime | str) -> Column:
    """A foldable literal that pushes down against TIMESTAMP and TIMESTAMP_NTZ columns."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def floor_to(column: Column, width: str) -> Column:
    """Start of the tumbling bucket of that width; keeps the column's timestamp type."""
    return F.window(column, width).getField("start")


def epoch_seconds(column: Column) -> Column:
    return F.unix_timestamp(column.cast("timestamp"))


def epoch_micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def truncate_hour(value: datetime | str) -> datetime:
    return as_datetime(value).replace(minute=0, second=0, microsecond=0)


def time_bounds(
    as_of: datetime | str,
    shorthand: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> tuple[datetime, datetime]:
    """Range of a request: last hour by default, a known shorthand counts back from the end."""
    upper = as_datetime(end) if end is not None else as_datetime(as_of)
    if shorthand in RANGES:
        return upper - RANGES[shorthand], upper
    if start is not None:
        return as_datetime(start), upper
    return as_datetime(as_of) - RANGES["1h"], upper


def resolution_for(resolution: str | None, start: datetime, end: datetime) -> str:
    """`1h` or `1m`; unset means hours for ranges beyond a day."""
    if not resolution:
        resolution = "1h" if end - start > RANGES["24h"] else "1m"
    return "1h" if resolution == "1h" else "1m"


def alert_window(column: Column) -> Column:
    """Normalised window name: unknown names count as five minutes."""
    return F.when(column.isin(*ALERT_WINDOWS), column).otherwise(DEFAULT_ALERT_WINDOW)
