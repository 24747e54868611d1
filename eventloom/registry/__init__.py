"""Registered queries: each reads the shared tables and, where SQL can say it, has an oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}

# Fixed clocks of the registered queries.
AS_OF = "2024-01-31 00:00:00"
MONTH_START = "2024-01-01 00:00:00"
ANOMALY_AS_OF = "2024-01-05 14:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in ENTRIES:
            raise ValueError(f"registered twice: {name}")
        ENTRIES[name] = Entry(lambda spark, folder: plain(run(spark, folder)), sql)
        return run

    return register


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the oracle returns them."""
    return df.select(
        *(
            F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
            for n, t in df.dtypes
        )
    )


def r6(column):
    return F.round(column, 6)


EV_SQL = """ev AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
         'svc-' || (user_id % 8) AS source,
         event_type,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'fatal' ELSE 'error' END
              WHEN event_type = 'signup' THEN 'warn'
              WHEN event_type = 'view' THEN 'debug' ELSE 'info' END AS severity,
         ts AS "timestamp",
         ts + to_seconds(event_id % 600) AS received_at,
         '{"status":' || CASE WHEN event_type = 'error' THEN 500 + event_id % 4
                              WHEN event_type = 'signup' THEN 400 + event_id % 5 ELSE 200 END
           || ',"method":"' || (['GET','POST','PUT','DELETE'])[event_id % 4 + 1]
           || '","path":"/api/p' || (event_id % 6)
           || '","duration_ms":' || CAST(floor(value * 10) AS BIGINT)
           || ',"message":"' || CASE WHEN event_type <> 'error' THEN 'operational event'
                WHEN event_id % 4 = 0 THEN 'connection refused payment-gateway'
                WHEN event_id % 4 = 1 THEN 'timeout waiting for inventory-service'
                WHEN event_id % 4 = 2 THEN 'rate limit exceeded for external API'
                ELSE 'circuit breaker open downstream' END || '"}' AS data,
         ['production', CASE WHEN user_id % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END] AS tags,
         '{"host":"host-' || (user_id % 5) || '"}' AS metadata,
         user_id, event_id AS seq, value
  FROM events)"""

COUNTS_SQL = """counts AS (
  SELECT date_trunc('minute', "timestamp") AS bucket, source, event_type, severity, count(*) AS count
  FROM ev GROUP BY ALL)"""

DUP_SQL = """dup AS (
  SELECT * FROM ev UNION ALL BY NAME
  SELECT * REPLACE (received_at + INTERVAL 1 MINUTE AS received_at) FROM ev
  WHERE event_type = 'purchase')"""

FLAWED_SQL = """flawed AS (
  SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN '' ELSE source END AS source,
                    CASE WHEN seq % 101 = 0 THEN 'critical' ELSE severity END AS severity,
                    CASE WHEN seq % 103 = 0 THEN list_transform(range(51), lambda x: 't') ELSE tags END AS tags)
  FROM ev)"""

RULES_SQL = """rules AS (
  SELECT 'rule-' || CASE WHEN s.source = '' THEN 'all' ELSE s.source END || '-' || k.kind AS rule_id,
         k.metric || ' ' || k.operator || ' ' || k.win AS name, k.metric, k.operator, k.threshold,
         k.win AS "window", s.source, CASE WHEN k.kind = 0 THEN 'critical' ELSE 'warning' END AS severity,
         '[{"type":"webhook","url":"https://hooks.example/' || s.source
           || '"},{"type":"email","url":"ops@example"}]' AS channels,
         k.enabled, 300 AS cooldown_seconds
  FROM (SELECT DISTINCT source FROM ev UNION SELECT '') s
  CROSS JOIN (VALUES (0, 'error_rate', '>', 0.1::DOUBLE, '1h', true),
                     (1, 'event_count', '>=', 3, '5m', true),
                     (2, 'error_count', '<', 1, '15m', true),
                     (3, 'event_count', '<=', 0, '1m', true),
                     (4, 'latency_p42', '>', 1, '5m', true),
                     (5, 'error_count', '>=', 0, '1h', false))
    k(kind, metric, operator, threshold, win, enabled))"""

ALERTS_SQL = """alerts AS (
  SELECT 'alert-' || event_id AS alert_event_id,
         'rule-' || source || '-' || ((seq % 20) // 10) AS rule_id,
         'firing' AS status, "timestamp" AS fired_at, value
  FROM ev WHERE severity = 'fatal')"""

_PARTS = {
    "counts": COUNTS_SQL,
    "dup": DUP_SQL,
    "flawed": FLAWED_SQL,
    "rules": RULES_SQL,
    "alerts": ALERTS_SQL,
}


def ev_sql(body: str, *ctes: str) -> str:
    """Oracle text over the canonical events and the named or given extra tables."""
    return "WITH " + ",\n".join([EV_SQL, *(_PARTS.get(c, c) for c in ctes)]) + "\n" + body


def load_all() -> dict[str, Entry]:
    from eventloom.registry import analytics, ingest, monitoring, search, streams  # noqa: F401

    return ENTRIES
