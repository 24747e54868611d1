"""Dead letters: what ingest refused, and where each of them goes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Delivery limit and idle time before a retry.
MAX_ATTEMPTS = 3
IDLE_SECONDS = 30
DEFAULT_LIST = 50


def route_pending(df: DataFrame, attempts: str = "attempts", idle: str = "idle_s") -> DataFrame:
    """`route` of each letter: dlq after too many tries, retry, or wait. Only idle ones move."""
    route = (
        F.when(F.col(idle) < IDLE_SECONDS, "wait")
        .when(F.col(attempts) >= MAX_ATTEMPTS, "dlq")
        .otherwise("retry")
    )
    return df.withColumn("route", route)


def open_letters(rejected: DataFrame, quarantine: DataFrame, handled: DataFrame) -> DataFrame:
    """Dead letters over what ingest refused, less what `handled` has settled.

    One letter per different text: id, stream (rejected or quarantine), payload, reasons,
    copies, received_at (of the last copy) and attempts, the times it was sent again. Copies
    collapse in partial aggregates. A letter is settled by a purge until it comes anew, and by
    a retry unless that refused it once more.
    """
    columns = ["stream", "payload", "received_at"]
    refused = rejected.select(
        F.lit("rejected").alias("stream"), "payload", "received_at", "index",
        F.concat_ws(" ", "field", "message").alias("reason"),
    ).unionByName(
        quarantine.select(
            F.lit("quarantine").alias("stream"), "payload", "received_at",
            F.lit(None).cast("int").alias("index"), F.lit("unreadable").alias("reason"),
        )
    )
    # An event is there once per problem.
    per_reason = refused.groupBy(*columns, "reason").agg(F.count("*").alias("copies"))
    letters = per_reason.groupBy("stream", "payload").agg(
        F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"),
        F.sum("copies").alias("_rows"),
        F.count_distinct("reason").alias("_reasons"),
        F.max("received_at").alias("received_at"),
    )
    named = letters.select(
        F.sha2(F.concat_ws("|", "stream", "payload"), 256).alias("id"), "stream", "payload", "reasons",
        F.expr("_rows div _reasons").alias("copies"), "received_at",
    )
    last = F.max_by(F.struct("action", "at"), F.struct("at", "action"))
    past = handled.groupBy("id").agg(F.count_if(F.col("action") == "retried").alias("attempts"), last.alias("_last"))
    again = F.when(F.col("_last.action") == "retried", F.col("received_at") >= F.col("_last.at")).otherwise(
        F.col("received_at") > F.col("_last.at")
    )
    return (
        named.join(past, "id", "left")
        .where(F.col("_last").isNull() | again)
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        .drop("_last")
    )


def stats(letters: DataFrame) -> DataFrame:
    """Letters per non-empty stream and, as stream `total`, over all of them."""
    return (
        letters.rollup("stream")
        .agg(F.count("*").alias("messages"), F.grouping("stream").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "total").otherwise(F.col("stream")).alias("stream"),
            "messages",
        )
    )


def list_letters(
    letters: DataFrame, stream: str, count: int = DEFAULT_LIST, order: Sequence[str] = ("received_at", "id")
) -> DataFrame:
    """The oldest letters of a stream."""
    count = DEFAULT_LIST if count <= 0 else count
    return letters.where(F.col("stream") == stream).orderBy(*order).limit(count)
