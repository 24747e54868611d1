"""Reading, validating, completing and appending events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom import schemas as S
from eventloom.functions.timeops import as_datetime
from eventloom.plans.pruning import between
from eventloom.plans.skew import keep_one, salted_join


# One schema for both shapes, so that a payload is parsed once.
_PAYLOAD = T.StructType(
    [T.StructField("events", T.ArrayType(S.EVENT_INPUT)), *S.EVENT_INPUT.fields]
)


def decode_batches(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """JSON text to the batch's `events` and their number, one row per batch.

    A list, `{"events": [...]}` and a single event object are all taken. Text that is not
    JSON has no events here and is left to `quarantine`.
    """
    text = F.col(payload)
    listed = F.ltrim(text).startswith("[")
    whole = F.when(listed, F.concat(F.lit('{"events":'), text, F.lit("}"))).otherwise(text)
    parsed = df.select(*keep, F.from_json(whole, _PAYLOAD).alias("_p"))
    fields = [F.col("_p")[f].alias(f) for f in S.EVENT_INPUT.fieldNames()]
    given = reduce(Column.__or__, [F.col("_p")[f].isNotNull() for f in S.EVENT_INPUT.fieldNames()])
    events = F.coalesce(F.col("_p.events"), F.when(given, F.array(F.struct(*fields))))
    return parsed.select(*keep, events.alias("events")).withColumn(
        "batch_events", F.coalesce(F.size("events"), F.lit(0))
    )


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per event with its `event_index` in the batch.

    The outer form keeps Catalyst from parsing once more just to skip empty batches.
    """
    others = [c for c in batches.columns if c != "events"]
    rows = batches.select(*others, F.posexplode_outer("events").alias("event_index", "_event"))
    return rows.where(F.col("event_index").isNotNull()).select(*others, "event_index", "_event.*")


# Every field as the text that was sent, so that one of a wrong type is seen and kept.
_SENT = T.StructType([T.StructField(f, T.StringType()) for f in S.EVENT_INPUT.fieldNames()])


def split_payloads(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One row per event: `sent` is its own JSON text, `event_index` its place in the payload.

    Batches of any size are taken. A payload without events, or that is no JSON, gives one row with a null
    index and itself as `sent`, so every payload is accounted for.
    """
    text = F.col(payload)
    listed = F.ltrim(text).startswith("[")
    whole = F.when(listed, F.concat(F.lit('{"events":'), text, F.lit("}"))).otherwise(text)
    many = F.from_json(whole, "events array<string>")["events"]
    alone = F.from_json(text, _SENT)
    given = reduce(Column.__or__, [alone[f].isNotNull() for f in _SENT.fieldNames()])
    parts = F.coalesce(many, F.when(given, F.array(text)))
    rows = df.select(*keep, text.alias("_payload"), F.posexplode_outer(parts).alias("event_index", "sent"))
    sent = F.when(F.col("event_index").isNull(), F.col("_payload")).otherwise(F.coalesce("sent", F.lit("null")))
    return rows.withColumn("sent", sent).drop("_payload")


# What JSON type each field has to have, as `schema_of_variant` names it; data and metadata may be anything.
FIELD_TYPES = {
    "source": ("STRING",),
    "event_type": ("STRING",),
    "severity": ("STRING",),
    "timestamp": ("STRING",),
    "tags": ("ARRAY<STRING>", "ARRAY<VOID>"),
}


def typed_events(rows: DataFrame) -> DataFrame:
    """Adds the event's fields, and `unreadable`, the names of those that do not have their JSON type.

    A number or list as source is refused, not stored as its text; so are tags that are no texts, and timestamps
    that are none. A null is like a missing field.
    """
    raw = F.from_json("sent", _SENT)
    kinds = {name: F.schema_of_variant(F.try_variant_get(F.try_parse_json("sent"), f"$.{name}", "variant")) for name in FIELD_TYPES}
    parsed = rows.withColumns({"_raw": raw, "_kinds": F.struct(*(kind.alias(name) for name, kind in kinds.items()))})
    sent, kinds = F.col("_raw"), F.col("_kinds")
    at = sent["timestamp"].try_cast("timestamp")
    tags = F.from_json(sent["tags"], "array<string>")
    failed = {name: ~kinds[name].isin("VOID", *allowed) for name, allowed in FIELD_TYPES.items()}
    failed["timestamp"] |= sent["timestamp"].isNotNull() & at.isNull()
    unreadable = F.filter(
        F.array(*(F.when(bad, F.lit(name)) for name, bad in failed.items())), lambda name: name.isNotNull()
    )
    typed = {"timestamp": at, "tags": tags}
    return parsed.select(
        *rows.columns,
        *(typed.get(f, sent[f]).alias(f) for f in S.EVENT_INPUT.fieldNames()),
        unreadable.alias("unreadable"),
    )


def parse_batches(df: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    return explode_batches(decode_batches(df, payload, keep))


def batch_verdicts(df: DataFrame, size: Column, limit: int = S.MAX_BATCH_EVENTS) -> DataFrame:
    """`verdict` of each batch row by its number of events: empty, too_large or ok."""
    verdict = (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "empty")
        .when(size > limit, "too_large")
        .otherwise("ok")
    )
    return df.withColumn("verdict", verdict)


def limit_batches(df: DataFrame, batch: str, limit: int = S.MAX_BATCH_EVENTS) -> DataFrame:
    """Events of flat batches with the batch's size and verdict; hot batches are salted."""
    sizes = df.groupBy(batch).agg(F.count("*").alias("batch_events"))
    verdicts = batch_verdicts(sizes, F.col("batch_events"), limit)
    salt_by = [c for c in ("event_id",) if c in df.columns] or df.columns
    return salted_join(df, verdicts, [batch], salt_by, "left")


# The messages of the five checks.
REQUIRED = "required"
NAME_TOO_LONG = f"must be <= {S.MAX_NAME_BYTES} characters"
UNKNOWN_SEVERITY = "must be one of: debug, info, warn, error, fatal"
DATA_TOO_LONG = "must be <= {} bytes"
TOO_MANY_TAGS = f"must have <= {S.MAX_TAGS} tags"


def _problem(condition: Column, index: Column, field: str, message: str) -> Column:
    return F.when(
        condition,
        F.struct(index.alias("index"), F.lit(field).alias("field"), F.lit(message).alias("message")),
    )


def _name_problem(name: str, index: Column) -> Column:
    value = F.col(name)
    missing = value.isNull() | (value == "")
    return F.coalesce(
        _problem(missing, index, name, REQUIRED),
        _problem(F.octet_length(value) > S.MAX_NAME_BYTES, index, name, NAME_TOO_LONG),
    )


def validation_errors(index: Column, max_bytes: int = S.MAX_DATA_BYTES) -> Column:
    """Array of {index, field, message}, empty for a valid row. Lengths are in bytes."""
    severity = F.col("severity")
    named = severity.isNotNull() & (severity != "")
    checks = F.array(
        _name_problem("source", index),
        _name_problem("event_type", index),
        _problem(named & ~S.is_severity(severity), index, "severity", UNKNOWN_SEVERITY),
        _problem(
            F.octet_length("data") > max_bytes, index, "data", DATA_TOO_LONG.format(max_bytes)
        ),
        _problem(F.size("tags") > S.MAX_TAGS, index, "tags", TOO_MANY_TAGS),
    )
    return F.filter(checks, lambda e: e.isNotNull())


def validate(
    df: DataFrame, index: Column | None = None, max_bytes: int = S.MAX_DATA_BYTES
) -> DataFrame:
    index = F.lit(0) if index is None else index
    return df.withColumn("errors", validation_errors(index, max_bytes))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    """One row per problem of a rejected event."""
    return validated.withColumn("error", F.explode("errors")).drop("errors")


def batch_outcome(validated: DataFrame, batch: str) -> DataFrame:
    """Accepted and rejected counts per batch; a batch fails only when nothing passes."""
    valid = F.size("errors") == 0
    return (
        validated.groupBy(batch)
        .agg(F.count_if(valid).alias("accepted"), F.count_if(~valid).alias("rejected"))
        .withColumn("failed", F.col("accepted") == 0)
    )


def fill_defaults(df: DataFrame, received_at: Column) -> DataFrame:
    """Receive time, default severity and empty containers where the sender left gaps."""
    empty = F.array().cast("array<string>")
    severity = F.col("severity")
    unset = severity.isNull() | (severity == "")
    return (
        df.withColumn("received_at", received_at)
        .withColumn("timestamp", F.coalesce("timestamp", "received_at"))
        .withColumn("severity", F.when(unset, S.DEFAULT_SEVERITY).otherwise(severity))
        .withColumn("data", F.coalesce("data", F.lit("{}")))
        .withColumn("tags", F.coalesce("tags", empty))
        .withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    )


def sortable_id(received_at: Column, *content: Column) -> Column:
    """Fixed-width id: 12 hex digits of milliseconds, then 16 of a content hash.

    Equal content received at the same moment gets the same id, so a replay is a no-op.
    """
    millis = F.lpad(F.lower(F.hex(F.unix_millis(received_at.cast("timestamp")))), 12, "0")
    digest = F.sha2(F.concat_ws("\u001f", *content), 256)
    return F.concat(millis, F.substring(digest, 1, 16))


def source_partition(source: Column, partitions: int = S.STREAM_PARTITIONS) -> Column:
    """Stream number of a source: base-31 code point hash in 32 bits, modulo `partitions`."""
    code_points = F.transform(F.split(source, ""), F.ascii)
    folded = F.aggregate(
        code_points,
        F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + c) % F.lit(4294967296),
    )
    return F.pmod(folded, F.lit(partitions)).cast("int")


def stream_name(partition: Column) -> Column:
    return F.concat(F.lit("events:"), partition.cast("string"))


def touched_span(incoming: DataFrame) -> tuple[date, date] | None:
    """First and last day the batch has events of; none if it has no events."""
    day = F.to_date("timestamp")
    row = incoming.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
    return None if row["first"] is None else (row["first"], row["last"])


def on_touched_days(
    stored: DataFrame, incoming: DataFrame, day: str = "event_date", span: tuple[date, date] | None = None
) -> DataFrame:
    """Stored rows of the days that the batch has events of.

    The span of days prunes folders (it is looked up unless given); the days themselves are
    matched by a join.
    """
    span = span or touched_span(incoming)
    if span is None:
        return stored.where(F.lit(False))
    days = incoming.select(F.to_date("timestamp").alias(day)).distinct()
    return stored.where(F.col(day).between(*map(F.lit, span))).join(days, day, "left_semi")


def append_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows not yet stored, one per event key.

    Copies inside the batch collapse in a partial aggregate. Give it only the stored days
    that the batch touches (`on_touched_days`), so that the others are never read.
    """
    fresh = keep_one(incoming, S.EVENT_KEY, ["received_at"])
    return fresh.join(existing.select(*S.EVENT_KEY), S.EVENT_KEY, "left_anti")


def quarantine(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Parsed columns plus `_corrupt_record`, which holds the text of undecodable rows."""
    with_corrupt = T.StructType(
        [*schema.fields, T.StructField("_corrupt_record", T.StringType())]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(payload, with_corrupt, options).alias("_parsed")
    return df.select(*df.columns, parsed).select(*df.columns, "_parsed.*")


def backlog(received: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows received but not yet stored, per source."""
    waiting = received.join(stored.select(*keys), keys, "left_anti")
    return waiting.groupBy("source").agg(F.count("*").alias("depth"))


def backpressure(depth: DataFrame, limit: int = S.MAX_QUEUED_EVENTS) -> DataFrame:
    """Total queued rows and whether new ones must be refused."""
    total = F.coalesce(F.sum("depth"), F.lit(0))
    return depth.agg(total.alias("total"), (total > limit).alias("reject"))


def accounting(df: DataFrame) -> DataFrame:
    """Events and bytes of data taken in, per source."""
    return df.groupBy("source").agg(
        F.count("*").alias("events"),
        F.sum(F.octet_length("data").cast("bigint")).alias("data_bytes"),
    )


def partition_calendar(
    ev: DataFrame, as_of: datetime | str, back: int = 1, ahead: int = 7
) -> DataFrame:
    """Days from yesterday to a week ahead with the rows each day partition already holds."""
    today = datetime.combine(as_datetime(as_of).date(), time())
    first, last = today - timedelta(days=back), today + timedelta(days=ahead)
    days = ev.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first.date()), F.lit(last.date()))).alias("event_date")
    )
    held = (
        between(ev, first, last + timedelta(days=1))
        .groupBy(F.to_date("timestamp").alias("event_date"))
        .agg(F.count("*").alias("rows"))
    )
    return days.join(held, "event_date", "left").select(
        "event_date",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.col("rows").isNotNull().alias("present"),
    )
