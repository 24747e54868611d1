"""JSON fields of an event that filters and groupings may name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names users may filter on and where each one lives.
COLUMN_FIELDS = {
    "source": "source",
    "type": "event_type",
    "event_type": "event_type",
    "severity": "severity",
}
JSON_FIELDS = {
    "status": ("data", "$.status"),
    "method": ("data", "$.method"),
    "path": ("data", "$.path"),
    "host": ("metadata", "$.host"),
}


def is_field(name: str) -> bool:
    return name in COLUMN_FIELDS or name in JSON_FIELDS


def field(name: str) -> Column:
    """Text value of an allowed field; ValueError for any other name."""
    if name in COLUMN_FIELDS:
        return F.col(COLUMN_FIELDS[name])
    if name in JSON_FIELDS:
        column, path = JSON_FIELDS[name]
        return F.get_json_object(column, path)
    raise ValueError(f"unknown field: {name}")


def number(path: str, column: str = "data") -> Column:
    """JSON number as double; null where it is missing or no number."""
    return F.get_json_object(column, path).try_cast("double")


def duration_ms() -> Column:
    """Milliseconds as double; senders also report fractions."""
    return number("$.duration_ms")
