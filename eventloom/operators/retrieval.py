"""Filtered, keyset-paged event retrieval."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.cursors import Cursor, cursor_column, decode_cursor
from eventloom.functions.fields import JSON_FIELDS, field, number
from eventloom.functions.timeops import as_datetime, ts_lit
from eventloom.plans.pruning import between
from eventloom.plans.skew import keep_one
from eventloom.schemas import is_error, page_size



def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("event_id")]


def filter_events(
    ev: DataFrame,
    *,
    as_of: datetime | str,
    source: str | None = None,
    event_type: str | None = None,
    severity: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Equality filters and `[start, end)`; without a start, the last 24 hours."""
    if start is None:
        start = as_datetime(as_of) - timedelta(hours=24)
    wanted = {"source": source, "event_type": event_type, "severity": severity}
    for column, value in wanted.items():
        if value:
            ev = ev.where(F.col(column) == value)
    return between(ev, start, end)


def after_cursor(ev: DataFrame, cursor: Cursor | str) -> DataFrame:
    """Rows older than the cursor; the plain bound on time is the part that pushes down."""
    at = decode_cursor(cursor) if isinstance(cursor, str) else cursor
    moment = ts_lit(at.timestamp)
    earlier = F.col("timestamp") < moment
    tie = (F.col("timestamp") == moment) & (F.col("event_id") < at.event_id)
    return ev.where((F.col("timestamp") <= moment) & (earlier | tie))


def query_events(
    ev: DataFrame, *, as_of: datetime | str, limit: int | None = None, **filters: object
) -> DataFrame:
    """Newest matching events, one page."""
    found = filter_events(ev, as_of=as_of, **filters)
    return found.orderBy(*newest_first()).limit(page_size(limit))


def event_page(
    ev: DataFrame,
    *,
    as_of: datetime | str,
    cursor: Cursor | str | None = None,
    limit: int | None = None,
    **filters: object,
) -> DataFrame:
    """A page as rows with `position`, `has_more` and, on the last row, `next_cursor`.

    Takes limit + 1 rows to learn whether more follow; everything after that top-k works
    on one page.
    """
    size = page_size(limit)
    found = filter_events(ev, as_of=as_of, **filters)
    if cursor is not None:
        found = after_cursor(found, cursor)
    return cut_page(found, newest_first(), size)


def cut_page(
    found: DataFrame, order: Sequence[Column], size: int, rank: Column | None = None
) -> DataFrame:
    whole = W.partitionBy(F.lit(0))
    taken = found.orderBy(*order).limit(size + 1)
    numbered = taken.withColumn(
        "position", F.row_number().over(whole.orderBy(*order)).cast("bigint")
    ).withColumn("has_more", F.count("*").over(whole) > size)
    last = F.col("has_more") & (F.col("position") == size)
    return numbered.where(F.col("position") <= size).withColumn(
        "next_cursor", F.when(last, cursor_column(F.col("timestamp"), F.col("event_id"), rank))
    )


def event_by_id(ev: DataFrame, event_id: str) -> DataFrame:
    """The event of that id, the newest if several times share it."""
    return ev.where(F.col("event_id") == event_id).orderBy(F.col("timestamp").desc()).limit(1)


def received_day(event_id: str) -> date | None:
    """The day a sortable id was given out, from its time prefix; none for ids of another form."""
    if not re.fullmatch("[0-9a-f]{28}", event_id):
        return None
    moment = datetime(1970, 1, 1) + timedelta(milliseconds=int(event_id[:12], 16))
    return moment.date()


def stored_events_by_id(ev: DataFrame, ids: Sequence[str], reach_days: int = 2) -> DataFrame:
    """The stored events of some ids, the newest of each, found through prefixes and bloom filters.

    An event is dated about when it was received, so days from `reach_days` before the first prefix on are searched first;
    only ids not found there are looked for in the days before. Bloom filters leave out row groups without any of the
    ids. The driver holds the ids asked for, no more.
    """
    asked = list(dict.fromkeys(ids))
    days = [received_day(i) for i in asked]

    def newest(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
        found = rows.where(F.col("event_id").isin(*wanted))
        rest = [c for c in found.columns if c != "event_id"]
        return found.groupBy("event_id").agg(F.max_by(F.struct(*rest), "timestamp").alias("_e")).select("event_id", "_e.*")

    if not asked or None in days:
        return newest(ev, asked) if asked else ev.limit(0)
    since = F.lit(min(days) - timedelta(days=reach_days))
    near = newest(ev.where(F.col("event_date") >= since), asked)
    there = {r["event_id"] for r in near.select("event_id").collect()}
    missing = [i for i in asked if i not in there]
    far = newest(ev.where(F.col("event_date") < since), missing) if missing else None
    return near if far is None else near.unionByName(far)


def with_fields(ev: DataFrame, *names: str) -> DataFrame:
    """Add allowed JSON fields as text columns, parsing each JSON column once."""
    parsed = {}
    for column in dict.fromkeys(JSON_FIELDS[n][0] for n in names if n in JSON_FIELDS):
        wanted = [n for n in names if n in JSON_FIELDS and JSON_FIELDS[n][0] == column]
        paths = [JSON_FIELDS[n][1].removeprefix("$.") for n in wanted]
        schema = T.StructType([T.StructField(p, T.StringType()) for p in paths])
        ev = ev.withColumn(f"_{column}", F.from_json(column, schema))
        parsed.update({n: F.col(f"_{column}")[p] for n, p in zip(wanted, paths, strict=True)})
    kept = [c for c in ev.columns if c not in ("_data", "_metadata")]
    return ev.select(*kept, *(parsed.get(n, field(n)).alias(n) for n in names))


def live_tail(
    live: DataFrame, history: DataFrame, severity: str | None = None, buffer: int | None = None
) -> DataFrame:
    """Live rows, or the newest `buffer` of them, over history; the live row wins per event."""
    newest = live.orderBy(*newest_first()).limit(buffer) if buffer else live
    if severity:
        # An event has one severity, so both sides are filtered before they meet.
        newest, history = (df.where(F.col("severity") == severity) for df in (newest, history))
    both = newest.withColumn("origin", F.lit(0)).unionByName(history.withColumn("origin", F.lit(1)))
    merged = keep_one(both, ["event_id"], ["origin"])
    return merged.withColumn("live", F.col("origin") == 0).drop("origin").orderBy(*newest_first())


def matching(
    ev: DataFrame,
    *,
    severities: Sequence[str] = (),
    tags: Sequence[str] = (),
    numbers: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Severity list, all of the given tags, and numeric comparisons on JSON paths."""
    if severities:
        ev = ev.where(F.col("severity").isin(*severities))
    for tag in tags:
        ev = ev.where(F.array_contains("tags", tag))
    for path, (operator, bound) in (numbers or {}).items():
        ev = ev.where(compare(number(path), F.lit(operator), F.lit(float(bound))))
    return ev


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """`value operator threshold`; an unknown operator is false."""
    return (
        F.when(operator == ">", value > threshold)
        .when(operator == ">=", value >= threshold)
        .when(operator == "<", value < threshold)
        .when(operator == "<=", value <= threshold)
        .when(operator == "==", value == threshold)
        .otherwise(False)
    )


def overview(ev: DataFrame, newest: int = 100) -> DataFrame:
    """Totals over the newest events: rows, errors, sources and error percentage."""
    recent = ev.orderBy(*newest_first()).limit(newest)
    total, errors = F.count("*"), F.count_if(is_error(F.col("severity")))
    return recent.agg(
        total.alias("total"),
        errors.alias("errors"),
        F.count_distinct("source").alias("sources"),
        F.when(total > 0, F.round(errors / total * 100, 1)).otherwise(0.0).alias("error_percent"),
    )
