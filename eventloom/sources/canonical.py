"""Shared Parquet tables seen as the event model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import prepare

# Schema of the shared `events` table, named so that nothing is inferred from files.
RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.schema(RAW_EVENTS).parquet(f"{folder}/events.parquet")


SEVERITY = """CASE event_type WHEN 'error' THEN if(event_id % 10 = 0, 'fatal', 'error')
  WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END"""
STATUS = """CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'signup' THEN 400 + event_id % 5 ELSE 200 END"""
MESSAGE = """CASE WHEN event_type <> 'error' THEN 'operational event' ELSE element_at(array(
  'connection refused payment-gateway', 'timeout waiting for inventory-service',
  'rate limit exceeded for external API', 'circuit breaker open downstream'), cast(event_id % 4 + 1 AS int)) END"""


def to_events(raw: DataFrame) -> DataFrame:
    """The canonical event columns plus the user, as pure functions of each raw row."""
    return raw.selectExpr(
        "lpad(cast(event_id AS string), 12, '0') AS event_id",
        "concat('svc-', user_id % 8) AS source",
        "event_type",
        f"{SEVERITY} AS severity",
        "ts AS timestamp",
        "ts + make_dt_interval(0, 0, 0, event_id % 600) AS received_at",
        f"""concat('{{"status":', {STATUS},
          ',"method":"', element_at(array('GET', 'POST', 'PUT', 'DELETE'), cast(event_id % 4 + 1 AS int)),
          '","path":"/api/p', event_id % 6, '","duration_ms":', cast(floor(value * 10) AS bigint),
          ',"message":"', {MESSAGE}, '"}}') AS data""",
        "array('production', if(user_id % 2 = 0, 'us-east-1', 'eu-west-1')) AS tags",
        """concat('{"host":"host-', user_id % 5, '"}') AS metadata""",
        "user_id",
        "event_id AS seq",
        "value",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return to_events(raw_events(spark, folder))


def redelivered(ev: DataFrame) -> DataFrame:
    """Events with every purchase delivered a second time, a minute later."""
    again = ev.where(F.col("event_type") == "purchase").withColumn(
        "received_at", F.col("received_at") + F.expr("interval 1 minute")
    )
    return ev.unionByName(again)


def flawed(ev: DataFrame) -> DataFrame:
    """Events of which some lack a source, have an unknown severity or too many tags."""
    seq = F.col("seq")
    return (
        ev.withColumn("source", F.when(seq % 97 == 0, "").otherwise(F.col("source")))
        .withColumn("severity", F.when(seq % 101 == 0, "critical").otherwise(F.col("severity")))
        .withColumn(
            "tags",
            F.when(seq % 103 == 0, F.array_repeat(F.lit("t"), 51)).otherwise(F.col("tags")),
        )
    )


def event_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors keyed like events."""
    return table(spark, folder, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("event_id"), "embedding"
    )


def alert_rules(ev: DataFrame) -> DataFrame:
    """Rules for each source seen in the events and for all sources together.

    Every source gets one rule per metric, operator and window combination listed; the
    last one is disabled and the one before it names a metric nobody knows.
    """
    shapes = [
        ("error_rate", ">", 0.1, "1h", True),
        ("event_count", ">=", 3.0, "5m", True),
        ("error_count", "<", 1.0, "15m", True),
        ("event_count", "<=", 0.0, "1m", True),
        ("latency_p42", ">", 1.0, "5m", True),
        ("error_count", ">=", 0.0, "1h", False),
    ]
    shape = F.array(
        *(
            F.struct(
                F.lit(i).alias("kind"), F.lit(m).alias("metric"), F.lit(o).alias("operator"),
                F.lit(t).alias("threshold"), F.lit(w).alias("window"), F.lit(e).alias("enabled"),
            )
            for i, (m, o, t, w, e) in enumerate(shapes)
        )
    )
    scopes = ev.select(F.explode(F.array("source", F.lit(""))).alias("source")).distinct()
    scoped = scopes.select("source", F.explode(shape).alias("s"))
    return scoped.select(
        F.concat_ws(
            "-", F.lit("rule"), F.when(F.col("source") == "", "all").otherwise(F.col("source")),
            F.col("s.kind").cast("string"),
        ).alias("rule_id"),
        F.concat_ws(" ", "s.metric", "s.operator", "s.window").alias("name"),
        "s.metric", "s.operator", "s.threshold", "s.window", "source",
        F.when(F.col("s.kind") == 0, "critical").otherwise("warning").alias("severity"),
        F.concat(
            F.lit('[{"type":"webhook","url":"https://hooks.example/'), F.col("source"),
            F.lit('"},{"type":"email","url":"ops@example"}]'),
        ).alias("channels"),
        "s.enabled",
        F.lit(300).alias("cooldown_seconds"),
    )


def alert_events(ev: DataFrame) -> DataFrame:
    """One past firing for each fatal event, charged to its source's first or second rule."""
    fatal = ev.where(F.col("severity") == "fatal")
    return fatal.select(
        F.concat(F.lit("alert-"), "event_id").alias("alert_event_id"),
        F.concat(F.lit("rule-"), "source", F.lit("-"), (F.col("seq") % 20 / 10).cast("int")).alias(
            "rule_id"
        ),
        F.lit("firing").alias("status"),
        F.col("timestamp").alias("fired_at"),
        F.col("value"),
    )
