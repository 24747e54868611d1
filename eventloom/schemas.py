"""Table schemas, the severity domain and argument rules. Nothing here is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities, size limits and page sizes of the event model.
SEVERITIES = ("debug", "info", "warn", "error", "fatal")
ERROR_SEVERITIES = ("error", "fatal")
DEFAULT_SEVERITY = "info"
MAX_NAME_BYTES = 256
MAX_DATA_BYTES = 1_048_576
MAX_TAGS = 50
MAX_BATCH_EVENTS = 1000
MAX_QUEUED_EVENTS = 100_000
STREAM_PARTITIONS = 4
DEFAULT_PAGE = 50
MAX_PAGE = 1000
BATCH_SIZE_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)
HTTP_SECONDS_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
PROCESSING_SECONDS_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1)

EVENT_INPUT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("data", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("data", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
    ]
)

EVENT_COLUMNS = EVENT.fieldNames()
EVENT_KEY = ["event_id", "timestamp"]

COUNT_KEY = ["bucket", "source", "event_type", "severity"]

CONDITION = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("window", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

CHANNELS = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("url", T.StringType())])
)


def is_severity(column: Column) -> Column:
    """Whether a severity is one of the five known ones; null counts as unknown."""
    return F.coalesce(column.isin(*SEVERITIES), F.lit(False))


def is_error(column: Column) -> Column:
    return column.isin(*ERROR_SEVERITIES)


def page_size(limit: int | None, default: int = DEFAULT_PAGE, maximum: int = MAX_PAGE) -> int:
    """The limit, or the default where there is none. ValueError outside 1..maximum.

    Fewer rows than asked for would come back without a sign of it.
    """
    if limit is None:
        return default
    if not 1 <= limit <= maximum:
        raise ValueError(f"limit {limit} is not in 1..{maximum}")
    return limit
