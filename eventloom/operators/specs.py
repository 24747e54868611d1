"""Structured query specs, named tools and transcript columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import timedelta
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.fields import COLUMN_FIELDS
from eventloom.functions.timeops import as_datetime
from eventloom.operators import alerts, analytics, retrieval, search
from eventloom.plans.pruning import between
from eventloom.plans.skew import running_sum
from eventloom.schemas import is_error, page_size

# The fallback confidence, how one is stated, and the marker of cut text.
DEFAULT_CONFIDENCE = 0.7
STATED_CONFIDENCE = r'confidence"?\s*:\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)'
TRUNCATED = "\n... (truncated)"


GROUPS = ("source", "event_type", "severity")
ORDERS = ("timestamp", "event_id", "source", "event_type", "severity")


class Tables(NamedTuple):
    """What specs and tools may read."""

    events: DataFrame
    minutes: DataFrame
    hours: DataFrame
    rules: DataFrame | None = None
    alert_events: DataFrame | None = None


def _ordered(found: DataFrame, order_by: str | None, allowed: Sequence[str], default: Sequence[Column]) -> DataFrame:
    """Sorted by `field`, `field ASC` or `field DESC`; ties in the default order."""
    if not order_by:
        return found.orderBy(*default)
    match = re.fullmatch(r"(\w+?)(?:[ _](asc|desc))?", order_by.strip(), re.IGNORECASE)
    if not match or match[1] not in allowed:
        raise ValueError(f"cannot order by {order_by!r}")
    down = (match[2] or "").lower() == "desc"
    field = F.col(match[1])
    return found.orderBy(field.desc() if down else field.asc(), *default)


def _metric(counts: DataFrame, spec: Mapping[str, Any], limit: int) -> DataFrame:
    """A metric of minute counts, per bucket and group; the counts are filtered already."""
    metric, group_by = spec.get("metric") or "", spec.get("group_by")
    if group_by and group_by not in GROUPS:
        raise ValueError(f"cannot group by {group_by!r}")
    if metric == "top":
        return analytics.ranked(counts, group_by or "source", limit)
    if metric in ("", "summary") and not group_by:
        return analytics.totals(counts)
    total = F.sum("count")
    errors = F.coalesce(F.sum(F.when(is_error(F.col("severity")), F.col("count"))), F.lit(0))
    values = {
        "event_count": total.alias("count"), "error_count": errors.alias("error_count"),
        "error_rate": (errors / total).alias("error_rate"),
    }
    if (metric or "event_count") not in values:
        raise ValueError(f"unknown metric: {metric}")
    keys = ["bucket", *([group_by] if group_by else [])]
    value = values[metric or "event_count"]
    found = counts.groupBy(*keys).agg(value)
    return _ordered(found, spec.get("order_by"), found.columns, [F.col(k) for k in keys])


def run_spec(tables: Tables, spec: Mapping[str, Any], *, as_of) -> DataFrame:
    """Run a structured query: event_query, search, analytics or count.

    Analytics takes the metrics event_count (also without one, if grouped), error_count and
    error_rate per minute and `group_by` source, event_type or severity; `top` ranks the groups, and without
    metric and group it gives the summary. Filters apply before anything is counted. Whatever is not
    supported raises a ValueError, as do limits outside 1..1000.
    """
    kind = spec.get("type") or "event_query"
    limit = page_size(spec.get("limit"), 100, 1000)
    filters = dict(spec.get("filters") or {})
    start, end = spec.get("start_time"), spec.get("end_time")
    upper = as_datetime(end or as_of)
    lower = as_datetime(start) if start else upper - timedelta(hours=24)
    if kind in ("event_query", "count"):
        found = search.with_filters(
            retrieval.filter_events(tables.events, as_of=as_of, start=lower, end=upper), filters
        )
        if kind == "count":
            return found.agg(F.count("*").alias("count"))
        down = not re.search("asc$", spec.get("order_by") or "desc", re.IGNORECASE)
        ties = retrieval.newest_first() if down else [F.col("timestamp"), F.col("event_id")]
        return _ordered(found, spec.get("order_by"), ORDERS, ties).limit(limit)
    if kind == "search":
        found = search.search_events(
            search.with_filters(tables.events, filters), spec.get("search_text"),
            as_of=as_of, start=lower, end=upper,
        )
        return _ordered(found, spec.get("order_by"), (*ORDERS, "rank"), search.search_order(True)).limit(limit)
    if kind == "analytics":
        counts = between(tables.minutes, lower, upper, "bucket")
        for name, value in filters.items():
            if COLUMN_FIELDS.get(name) not in GROUPS:
                raise ValueError(f"counts cannot be filtered by {name!r}")
            counts = counts.where(F.col(COLUMN_FIELDS[name]) == value)
        return _metric(counts, spec, limit)
    raise ValueError(f"unknown query type: {kind}")


def _events_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    return retrieval.query_events(
        tables.events, as_of=as_of, source=args.get("source"), severity=args.get("severity"),
        event_type=args.get("event_type"), start=args.get("start_time"), end=args.get("end_time"),
        limit=args.get("limit", 20),
    )


def _search_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    found = search.search_events(
        tables.events, args.get("query"), as_of=as_of, source=args.get("source"),
        severity=args.get("severity"), start=args.get("start_time"), end=args.get("end_time"),
    )
    return found.orderBy(*search.search_order(True)).limit(page_size(args.get("limit", 10)))


def _hour(args: Mapping[str, Any], as_of) -> tuple:
    now = as_datetime(as_of)
    return args.get("start_time") or now - timedelta(hours=1), args.get("end_time") or now


def _metrics_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    table = analytics.pick_table(tables.minutes, tables.hours, args.get("resolution", "1m"))
    return analytics.time_series(
        table, *_hour(args, as_of), source=args.get("source"), severity=args.get("severity")
    )


def _summary_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    return analytics.summary_totals(tables.minutes, *_hour(args, as_of))


def _history_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    return alerts.alert_history(tables.alert_events, tables.rules, args.get("limit", 20))


def _rules_tool(tables: Tables, args: Mapping[str, Any], as_of) -> DataFrame:
    return tables.rules


TOOLS = {
    "query_events": _events_tool,
    "search_events": _search_tool,
    "get_metrics": _metrics_tool,
    "get_summary": _summary_tool,
    "get_alert_history": _history_tool,
    "get_alert_rules": _rules_tool,
}


def run_tool(tables: Tables, name: str, args: Mapping[str, Any] | None = None, *, as_of) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    return TOOLS[name](tables, args or {}, as_of)


def confidence(text: Column) -> Column:
    """The first confidence in [0, 1] that an answer states; 0.7 where there is none.

    A statement is the word, quoted or not, a colon and a number.
    """
    stated = F.regexp_extract_all(F.lower(text), F.lit(STATED_CONFIDENCE), F.lit(1))
    valid = F.filter(
        F.transform(stated, lambda number: number.try_cast("double")), lambda value: value.between(0.0, 1.0)
    )
    return F.coalesce(F.get(valid, F.lit(0)), F.lit(DEFAULT_CONFIDENCE))


def usage_totals(steps: DataFrame, key: str) -> DataFrame:
    """Token usage summed over the steps of each investigation."""
    return steps.groupBy(key).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def truncate(text: Column, length: int) -> Column:
    """Text longer than `length` characters cut there, with a marker."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(TRUNCATED))
    ).otherwise(text)


def transcript(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages numbered from 1 in turn order within their conversation.

    Rows, not lists, and numbered in stretches of turns: a conversation of any length fits.
    """
    ones = messages.withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_sum(
        ones, [key], F.floor(F.col(turn) / 1024), [turn], "_one", "position"
    )
    return numbered.drop("_one")


def first_per_key(requests: DataFrame, key: str) -> DataFrame:
    """The first request received per idempotency key."""
    from eventloom.plans.skew import keep_one

    return keep_one(requests, [key], ["received_at", "event_id"])


def sample_events(ev: DataFrame, one_in: int = 10) -> DataFrame:
    """All warnings and errors, and one in `one_in` of the rest, with a `weight` to scale by.

    The choice hashes the event id, so every run and every retry keeps the same rows.
    """
    digest = F.conv(F.substring(F.md5(F.col("event_id").cast("binary")), 1, 8), 16, 10)
    drawn = F.pmod(digest.cast("bigint"), F.lit(one_in)) == 0
    frequent = F.col("severity").isin("debug", "info")
    return ev.where(~frequent | drawn).withColumn(
        "weight", F.when(frequent, F.lit(one_in)).otherwise(F.lit(1))
    )
