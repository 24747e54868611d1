"""Search, vector, spec, transcript and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas as S
from eventloom.functions import text as T
from eventloom.functions.fields import duration_ms, field
from eventloom.operators import health, patterns, rollup, search, specs, vector
from eventloom.registry import AS_OF, MONTH_START, ev_sql, query, r6
from eventloom.session import work_folder
from eventloom.sources.canonical import alert_events, alert_rules, event_embeddings, events, table

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_-]+')"
TOK_SQL = f"""toks AS (SELECT event_id, source, event_type, severity, "timestamp", data, metadata, seq,
  {TOKENS.format("source")} AS a, {TOKENS.format("event_type")} AS b, {TOKENS.format("severity")} AS c, {TOKENS.format("data")} AS d,
  list_concat(list_concat(a, b), list_concat(c, d)) AS ts,
  list_concat(list_transform(list_concat(a, b), lambda x: 1.0::DOUBLE),
    list_concat(list_transform(c, lambda x: 0.4::DOUBLE), list_transform(d, lambda x: 0.2::DOUBLE))) AS ws FROM ev),
doc AS (SELECT event_id, unnest(ts) AS term, unnest(ws) AS weight, generate_subscripts(ts, 1) - 1 AS pos FROM toks)"""


def _has(word: str) -> str:
    return f"list_contains(ts, '{word}')"


@query(
    "d1_search_document",
    ev_sql("SELECT event_id, term, weight, CAST(pos AS INTEGER) AS pos FROM doc", TOK_SQL),
)
def d1(spark, folder):
    return search.term_table(events(spark, folder))


@query(
    "d2_field_filters",
    ev_sql(
        """SELECT event_id, source, severity FROM ev WHERE source = 'svc-3' AND event_type = 'error'
AND json_extract_string(data, '$.method') = 'POST' AND json_extract_string(metadata, '$.host') IS NOT NULL"""
    ),
)
def d2(spark, folder):
    found = search.match_text(
        events(spark, folder), 'source:svc-1 type:error method:POST source:"svc-3"'
    )
    return found.select("event_id", "source", "severity")


def _boolean(name: str, text: str, where: str) -> None:
    @query(name, ev_sql(f"SELECT event_id, severity FROM toks WHERE {where}", TOK_SQL))
    def run(spark, folder):
        return search.match_text(events(spark, folder), text).select("event_id", "severity")


_boolean("d3_match_and", "connection refused", f"{_has('connection')} AND {_has('refused')}")
_boolean("d3_match_or", "timeout OR refused", f"{_has('timeout')} OR {_has('refused')}")
_boolean("d3_match_not", "error NOT timeout", f"{_has('error')} AND NOT {_has('timeout')}")
_boolean(
    "d3_match_mixed",
    "fatal AND NOT refused OR breaker svc-3",
    f"({_has('fatal')} AND NOT {_has('refused')}) OR ({_has('breaker')} AND {_has('svc-3')})",
)
_boolean(
    "d4_quoted_words",
    '"rate limit!" severity:error',
    f"{_has('rate')} AND {_has('limit')} AND severity = 'error'",
)


def _rank_sql(words: list[str], where: str) -> str:
    last = ", ".join(
        f"max(pos) FILTER (term = '{w}') OVER win AS l{i}" for i, w in enumerate(words)
    )
    seen = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(words)))
    least = "least(" + ", ".join(f"l{i}" for i in range(len(words))) + ")"
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""hit AS (SELECT *, {last}, row_number() OVER win AS n, sum(1 / weight) OVER win AS inv
  FROM doc WHERE term IN ({listed}) WINDOW win AS (PARTITION BY event_id ORDER BY pos)),
span AS (SELECT *, {least} AS p FROM hit WHERE {seen}),
cover AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY event_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used
  FROM span) WHERE used IS NULL OR p > used),
ranks AS (SELECT c.event_id, sum((c.n - s.n + 1) / (c.inv - s.inv + 1 / s.weight) / (1 + (c.pos - c.p) - (c.n - s.n))) AS rank
  FROM cover c JOIN hit s ON s.event_id = c.event_id AND s.pos = c.p GROUP BY 1),
found AS (SELECT t.event_id, t."timestamp", t.source, r.rank FROM toks t JOIN ranks r USING (event_id) WHERE {where})"""


@query(
    "d5_search_ranked",
    ev_sql(
        """SELECT event_id, "timestamp", round(rank, 6) AS rank FROM found ORDER BY found.rank DESC, "timestamp" DESC, event_id DESC LIMIT 100""",
        TOK_SQL,
        _rank_sql(["connection", "refused"], f"\"timestamp\" >= TIMESTAMP '{MONTH_START}' AND severity = 'error'"),
    ),
)
def d5(spark, folder):
    page = search.search_page(
        events(spark, folder), "connection refused", as_of=AS_OF, start=MONTH_START,
        severity="error", limit=100,
    )
    return page.select("event_id", "timestamp", r6("rank").alias("rank"))


@query(
    "d5_second_page",
    ev_sql(
        """SELECT event_id, "timestamp", round(rank, 6) AS rank FROM found
ORDER BY found.rank DESC, "timestamp" DESC, event_id DESC LIMIT 30 OFFSET 20""",
        TOK_SQL,
        _rank_sql(["connection", "refused"], f"\"timestamp\" >= TIMESTAMP '{MONTH_START}'"),
    ),
)
def d5_second(spark, folder):
    """A ranked page continued by the cursor text of the one before."""
    ev = events(spark, folder)
    asked = {"query": "connection refused", "as_of": AS_OF, "start": MONTH_START}
    first = search.search_page(ev, limit=20, **asked)
    cursor = first.where("next_cursor is not null").first()["next_cursor"]
    page = search.search_page(ev, limit=30, cursor=cursor, **asked)
    return page.select("event_id", "timestamp", r6("rank").alias("rank"))


def _stems_sql() -> str:
    """Porter's steps over a list `ts` of words."""
    out = "list_filter(ts, lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"
    out = f"list_transform({out}, lambda t: CASE WHEN regexp_matches(t, '{T.STEMMED}') THEN regexp_replace(t, '{T.CONSONANT_Y}', '\\1Y', 'g') ELSE '=' || t END)"
    for step in T.STEPS:
        cases = " ".join(f"WHEN regexp_matches(t, '{e.found}') THEN regexp_replace(t, '{e.whole}', '\\1{e.instead}')" for e in step)
        out = f"list_transform({out}, lambda t: CASE WHEN t[1] = '=' THEN t {cases} ELSE t END)"
    return f"list_transform({out}, lambda t: lower(ltrim(t, '=')))"


STEMS_SQL = _stems_sql()


@query(
    "d3_match_english",
    ev_sql(
        f"""SELECT event_id, severity FROM (SELECT *, {STEMS_SQL} AS stems FROM toks)
WHERE (list_contains(stems, 'connect') AND list_contains(stems, 'refus')) OR (list_contains(stems, 'wait') AND NOT list_contains(stems, 'svc-3'))""",
        TOK_SQL,
    ),
)
def d3_english(spark, folder):
    found = search.match_english(events(spark, folder), "the connections refuse OR waits NOT svc-3")
    return found.select("event_id", "severity")


@query(
    "d5_search_english",
    ev_sql(
        """SELECT event_id, "timestamp", round(rank, 6) AS rank FROM found ORDER BY found.rank DESC, "timestamp" DESC, event_id DESC LIMIT 100""",
        TOK_SQL,
        _rank_sql(["connection", "refused"], f"\"timestamp\" >= TIMESTAMP '{MONTH_START}'"),
    ),
)
def d5_english(spark, folder):
    """Other forms of the same words: matched and ranked by stems."""
    page = search.search_page(
        events(spark, folder), "the connections refusing", as_of=AS_OF, start=MONTH_START, limit=100, analyzer="english"
    )
    return page.select("event_id", "timestamp", r6("rank").alias("rank"))


@query(
    "d7_keyword_english",
    ev_sql(
        f"""SELECT event_id, round(list_sum(list_transform(list_filter(list_zip(stems, weights), lambda p: p[1] IN ('limit', 'extern')), lambda p: p[2])), 6) AS score
FROM (SELECT event_id, {STEMS_SQL} AS stems, list_transform(list_filter(list_zip(ts, ws), lambda p: p[1] NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})), lambda p: p[2]) AS weights FROM toks)
WHERE list_contains(stems, 'limit') AND list_contains(stems, 'extern') ORDER BY 2 DESC, 1 LIMIT 40""",
        TOK_SQL,
    ),
)
def d7_english(spark, folder):
    found = search.keyword_search(events(spark, folder), "limited for externals", 40, analyzer="english")
    return found.select("event_id", r6("score").alias("score"))


@query(
    "l24_english_stems",
    f"""SELECT stem, count(*) AS n FROM (SELECT unnest({STEMS_SQL}) AS stem FROM (
  SELECT regexp_extract_all(lower(text), '[a-z0-9_-]+') AS ts FROM documents WHERE lang = 'en')) GROUP BY 1""",
)
def l24_stems(spark, folder):
    """Stems of all words of the English documents."""
    docs = table(spark, folder, "documents").where("lang = 'en'")
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    spoken = words.where(~F.col("w").isin(*T.STOP_WORDS))
    return spoken.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


@query(
    "d5_search_filters_only",
    ev_sql(
        f"""SELECT event_id, "timestamp", 0.0::DOUBLE AS rank FROM ev WHERE source = 'svc-2' AND json_extract_string(data, '$.status') = '200'
AND "timestamp" >= TIMESTAMP '{MONTH_START}' AND "timestamp" < TIMESTAMP '{AS_OF}' ORDER BY "timestamp" DESC, event_id DESC LIMIT 50"""
    ),
)
def d5_filters(spark, folder):
    page = search.search_page(
        events(spark, folder), "source:svc-1 status:200", as_of=AS_OF, source="svc-2",
        start=MONTH_START, end=AS_OF,
    )
    return page.select("event_id", "timestamp", "rank")


@query(
    "d6_rank_single_term",
    ev_sql(
        "SELECT event_id, round(sum(weight), 6) AS rank FROM doc WHERE term = 'error' GROUP BY 1",
        TOK_SQL,
    ),
)
def d6_single(spark, folder):
    found = search.search_events(events(spark, folder), "error", as_of=AS_OF, start=MONTH_START)
    return found.select("event_id", r6("rank").alias("rank"))


@query(
    "d6_rank_cover_density",
    ev_sql(
        "SELECT event_id, round(rank, 6) AS rank FROM found",
        TOK_SQL,
        _rank_sql(["error", "connection", "payment-gateway"], "true"),
    ),
)
def d6_cover(spark, folder):
    found = search.search_events(
        events(spark, folder), "error connection payment-gateway", as_of=AS_OF, start=MONTH_START
    )
    return found.select("event_id", r6("rank").alias("rank"))


@query(
    "d3_indexed_match",
    ev_sql(
        "SELECT event_id, round(rank, 6) AS rank FROM found",
        TOK_SQL,
        _rank_sql(["error", "timeout"], "NOT list_contains(ts, 'svc-2')"),
    ),
)
def d3_indexed(spark, folder):
    """From a stored term table, as a search that comes often would read it."""
    path = work_folder(spark, "terms")
    search.write_term_table(events(spark, folder), path)
    found = search.match_indexed(spark.read.parquet(path), "error timeout NOT svc-2")
    return found.select("event_id", r6("rank").alias("rank"))


KEYWORD_SQL = """kw AS (SELECT event_id, sum(weight) AS score FROM doc WHERE term IN ('error', 'timeout')
  GROUP BY 1 HAVING count(DISTINCT term) = 2 ORDER BY round(score, 9) DESC, event_id LIMIT 100)"""
VECTOR_SQL = """vec AS (SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS event_id,
  list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings WHERE embedding IS NOT NULL ORDER BY score DESC, event_id LIMIT 100)"""


@query(
    "d7_keyword_search",
    ev_sql("SELECT event_id, round(score, 6) AS score FROM kw", TOK_SQL, KEYWORD_SQL),
)
def d7(spark, folder):
    found = search.keyword_search(events(spark, folder), "error timeout", 100)
    return found.select("event_id", r6("score").alias("score"))


def query_vector(spark, folder) -> list[float]:
    """The one vector that serves as the query argument."""
    return event_embeddings(spark, folder).where("event_id = '000000000000'").first().embedding


@query(
    "d8_vector_search",
    f"WITH {VECTOR_SQL} SELECT event_id, round(score, 6) AS score FROM vec",
)
def d8(spark, folder):
    found = vector.vector_search(event_embeddings(spark, folder), query_vector(spark, folder), 100)
    return found.select("event_id", r6("score").alias("score"))


@query(
    "d9_hybrid_search",
    ev_sql(
        """SELECT event_id, round(coalesce(k.s, 0) + coalesce(v.s, 0), 6) AS score FROM
  (SELECT event_id, 1 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, event_id)) AS s FROM kw) k
  FULL JOIN (SELECT event_id, 1 / (60 + row_number() OVER (ORDER BY score DESC, event_id)) AS s FROM vec) v USING (event_id)
ORDER BY coalesce(k.s, 0) + coalesce(v.s, 0) DESC, event_id LIMIT 50""",
        TOK_SQL, KEYWORD_SQL, VECTOR_SQL,
    ),
)
def d9(spark, folder):
    found = search.hybrid_search(
        events(spark, folder), event_embeddings(spark, folder), "error timeout", query_vector(spark, folder), 50
    )
    return found.withColumn("score", r6("score"))


@query(
    "d10_degraded_hybrid",
    ev_sql(
        "SELECT event_id, round(score, 6) AS score FROM kw ORDER BY round(kw.score, 9) DESC, event_id LIMIT 40",
        TOK_SQL, KEYWORD_SQL,
    ),
)
def d10(spark, folder):
    """No vector could be made of the query, so its words alone decide."""
    found = search.hybrid_search(events(spark, folder), event_embeddings(spark, folder), "error timeout", None, 40)
    return found.withColumn("score", r6("score"))


@query(
    "d11_vector_text",
    """SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS event_id, len(embedding) AS n, CAST(i AS INTEGER) AS at,
  round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, (SELECT unnest([1, 2, 7]) AS i) WHERE embedding IS NOT NULL""",
)
def d11(spark, folder):
    """Vectors to text and back."""
    text = event_embeddings(spark, folder).select("event_id", vector.vector_text(F.col("embedding")).alias("t"))
    back = text.select("event_id", vector.text_vector(F.col("t")).alias("v")).where("v is not null")
    at = F.explode(F.array(F.lit(1), F.lit(2), F.lit(7))).alias("at")
    spread = back.select("event_id", "v", F.size("v").cast("bigint").alias("n"), at)
    return spread.select("event_id", "n", "at", r6(F.element_at("v", F.col("at")).cast("double")).alias("value"))


def tables(spark, folder) -> specs.Tables:
    ev = events(spark, folder)
    return specs.Tables(
        ev, rollup.minute_counts(ev), rollup.counts_of(ev, "1 hour"), alert_rules(ev), alert_events(ev)
    )


SPAN = {"start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-31T00:00:00Z"}
MONTH = f"\"timestamp\" >= TIMESTAMP '{MONTH_START}' AND \"timestamp\" < TIMESTAMP '{AS_OF}'"


@query(
    "f1_spec_event_query",
    ev_sql(
        f"""SELECT event_id, "timestamp" FROM ev WHERE {MONTH} AND source = 'svc-4' AND json_extract_string(data, '$.method') = 'GET'
ORDER BY "timestamp" DESC, event_id DESC LIMIT 100"""
    ),
)
def f1_events(spark, folder):
    spec = {"type": "", "filters": {"source": "svc-4", "method": "GET"}, **SPAN}
    return specs.run_spec(tables(spark, folder), spec, as_of=AS_OF).select("event_id", "timestamp")


@query(
    "f1_spec_search",
    ev_sql(
        f"""SELECT event_id, "timestamp", round(rank, 6) AS rank FROM (SELECT event_id, any_value("timestamp") AS "timestamp", sum(weight) AS rank
  FROM doc JOIN ev USING (event_id) WHERE term = 'downstream' AND severity = 'error' AND {MONTH} GROUP BY 1)
ORDER BY rank DESC, "timestamp" DESC, event_id DESC LIMIT 30""",
        TOK_SQL,
    ),
)
def f1_search(spark, folder):
    spec = {"type": "search", "filters": {"severity": "error"}, "search_text": "downstream", "limit": 30, **SPAN}
    found = specs.run_spec(tables(spark, folder), spec, as_of=AS_OF)
    return found.select("event_id", "timestamp", r6("rank").alias("rank"))


@query(
    "f1_spec_analytics",
    ev_sql(
        f"""SELECT date_trunc('minute', "timestamp") AS bucket, severity, count(*) AS count FROM ev
WHERE {MONTH} AND source = 'svc-1' GROUP BY ALL"""
    ),
)
def f1_analytics(spark, folder):
    spec = {"type": "analytics", "metric": "event_count", "group_by": "severity", "filters": {"source": "svc-1"}, **SPAN}
    return specs.run_spec(tables(spark, folder), spec, as_of=AS_OF)


@query(
    "f1_spec_count",
    ev_sql(f"SELECT count(*) AS count FROM ev WHERE {MONTH} AND severity = 'error'"),
)
def f1_count(spark, folder):
    spec = {"type": "count", "filters": {"severity": "error"}, **SPAN}
    return specs.run_spec(tables(spark, folder), spec, as_of=AS_OF)


def _analytics_spec(name: str, spec: dict, column: str, sql: str) -> None:
    @query(name, ev_sql(sql))
    def run(spark, folder):
        found = specs.run_spec(tables(spark, folder), {"type": "analytics", **spec, **SPAN}, as_of=AS_OF)
        return found.withColumn(column, r6(column))


_analytics_spec(
    "f1_spec_error_rate", {"metric": "error_rate", "group_by": "source"}, "error_rate",
    f"""SELECT date_trunc('minute', "timestamp") AS bucket, source,
  round(count(*) FILTER (severity IN ('error', 'fatal')) / count(*), 6) AS error_rate FROM ev WHERE {MONTH} GROUP BY ALL""",
)
_analytics_spec(
    "f1_spec_error_count", {"metric": "error_count", "filters": {"source": "svc-2"}}, "error_count",
    f"""SELECT date_trunc('minute', "timestamp") AS bucket, count(*) FILTER (severity IN ('error', 'fatal')) AS error_count
FROM ev WHERE {MONTH} AND source = 'svc-2' GROUP BY ALL""",
)
_analytics_spec(
    "f1_spec_by_type", {"group_by": "event_type", "filters": {"severity": "info", "event_type": "click"}}, "count",
    f"""SELECT date_trunc('minute', "timestamp") AS bucket, event_type, count(*) AS count
FROM ev WHERE {MONTH} AND severity = 'info' AND event_type = 'click' GROUP BY ALL""",
)


@query(
    "f1_spec_order",
    ev_sql(f"""SELECT event_id, source FROM ev WHERE {MONTH} AND severity = 'error' ORDER BY event_id LIMIT 40"""),
)
def f1_order(spark, folder):
    spec = {"filters": {"severity": "error"}, "order_by": "event_id ASC", "limit": 40, **SPAN}
    return specs.run_spec(tables(spark, folder), spec, as_of=AS_OF).select("event_id", "source")


def _tool(name: str, tool: str, args: dict, columns: list[str], sql: str, *ctes: str) -> None:
    @query(name, ev_sql(sql, *ctes))
    def run(spark, folder):
        found = specs.run_tool(tables(spark, folder), tool, args, as_of=AS_OF)
        rounded = {"rank", "error_rate"}
        return found.select(*(r6(c).alias(c) if c in rounded else c for c in columns))


_tool(
    "f2_tool_query_events", "query_events", {"event_type": "signup", **SPAN}, ["event_id", "timestamp"],
    f"""SELECT event_id, "timestamp" FROM ev WHERE {MONTH} AND event_type = 'signup' ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""",
)
_tool(
    "f2_tool_search_events", "search_events", {"query": "limit", **SPAN}, ["event_id", "rank"],
    f"""SELECT event_id, round(rank, 6) AS rank FROM (SELECT event_id, any_value("timestamp") AS ts, sum(weight) AS rank
  FROM doc JOIN ev USING (event_id) WHERE term = 'limit' AND {MONTH} GROUP BY 1)
ORDER BY rank DESC, ts DESC, event_id DESC LIMIT 10""",
    TOK_SQL,
)
_tool(
    "f2_tool_get_metrics", "get_metrics", {"resolution": "1h", "severity": "warn", **SPAN}, ["bucket", "count"],
    f"""SELECT date_trunc('hour', "timestamp") AS bucket, count(*) AS count FROM ev WHERE {MONTH} AND severity = 'warn' GROUP BY 1""",
)
_tool(
    "f2_tool_get_summary", "get_summary", SPAN, ["total_events", "error_count", "error_rate", "active_sources"],
    f"""SELECT count(*) AS total_events, count(*) FILTER (severity IN ('error','fatal')) AS error_count,
  round(count(*) FILTER (severity IN ('error','fatal')) / count(*), 6) AS error_rate,
  count(DISTINCT source) AS active_sources FROM ev WHERE {MONTH}""",
)
_tool(
    "f2_tool_get_alert_history", "get_alert_history", {}, ["alert_event_id", "rule_name"],
    """SELECT alert_event_id, name AS rule_name FROM alerts JOIN rules USING (rule_id)
ORDER BY fired_at DESC, alert_event_id DESC LIMIT 20""",
    "rules", "alerts",
)
_tool(
    "f2_tool_get_alert_rules", "get_alert_rules", {}, ["rule_id", "name", "enabled"],
    "SELECT rule_id, name, enabled FROM rules", "rules",
)


ANSWER_SQL = """answers AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN text || ' Confidence: 0.' || (turn % 10)
  WHEN conv_id % 3 = 1 THEN '{"summary": "x", "confidence": ' || (turn % 3) || '.5}' ELSE text END AS answer, text FROM conversations)"""


def _answers(spark, folder):
    turn = F.col("turn")
    answer = (
        F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" Confidence: 0."), (turn % 10).cast("string")))
        .when(
            F.col("conv_id") % 3 == 1,
            F.concat(F.lit('{"summary": "x", "confidence": '), (turn % 3).cast("string"), F.lit(".5}")),
        )
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").withColumn("answer", answer)


@query(
    "f3_confidence",
    f"""WITH {ANSWER_SQL} SELECT conv_id, turn,
  coalesce(list_filter(list_transform(regexp_extract_all(lower(answer),
    'confidence"?\\s*:\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?)', 1),
    lambda x: try_cast(x AS DOUBLE)), lambda x: x BETWEEN 0 AND 1)[1], 0.7::DOUBLE) AS confidence
FROM answers""",
)
def f3(spark, folder):
    return _answers(spark, folder).select("conv_id", "turn", specs.confidence(F.col("answer")).alias("confidence"))


@query(
    "f4_usage_totals",
    """SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) AS BIGINT) AS prompt_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS completion_tokens,
  CAST(sum(length(text)) AS BIGINT) AS total_tokens FROM conversations GROUP BY 1""",
)
def f4(spark, folder):
    size = F.length("text").cast("bigint")
    steps = table(spark, folder, "conversations").select(
        "conv_id",
        F.when(F.col("role") == "assistant", F.lit(0)).otherwise(size).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", size).otherwise(F.lit(0)).alias("completion_tokens"),
    )
    return specs.usage_totals(steps, "conv_id")


@query(
    "f5_truncate",
    """SELECT doc_id, length(text) > 6000 AS cut,
  md5(CASE WHEN length(text) > 6000 THEN substring(text, 1, 6000) || chr(10) || '... (truncated)' ELSE text END) AS digest FROM documents""",
)
def f5(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", (F.length("text") > 6000).alias("cut"),
        F.md5(specs.truncate(F.col("text"), 6000).cast("binary")).alias("digest"),
    )


@query(
    "g1_rate_per_second",
    ev_sql(
        """SELECT date_trunc('minute', "timestamp") AS bucket, source, round(count(*) / 60, 6) AS rate FROM ev GROUP BY ALL"""
    ),
)
def g1(spark, folder):
    rates = health.per_second_rate(events(spark, folder), ["source"], "1 minute", 60)
    return rates.withColumn("rate", r6("rate"))


SAMPLE_SQL = """samples AS (SELECT source, date_trunc('minute', "timestamp") AS "timestamp",
  max(json_extract_string(data, '$.duration_ms')::DOUBLE) AS value FROM ev GROUP BY ALL)"""


@query(
    "g2_increase_1h",
    ev_sql(
        """SELECT source, date_trunc('hour', "timestamp") AS bucket,
  sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END)::DOUBLE AS increase
FROM (SELECT *, lag(value) OVER (PARTITION BY source, date_trunc('hour', "timestamp") ORDER BY "timestamp") AS p FROM samples) GROUP BY ALL""",
        SAMPLE_SQL,
    ),
)
def g2(spark, folder):
    ev = events(spark, folder)
    samples = ev.groupBy("source", rollup.floor_to(F.col("timestamp"), "1 minute").alias("timestamp")).agg(
        F.max(duration_ms()).alias("value")
    )
    return health.increase(samples, ["source"])


HIST_SQL = """hist AS (SELECT method, le, count(*) FILTER (s <= le) AS count
  FROM (SELECT json_extract_string(data, '$.method') AS method, json_extract_string(data, '$.duration_ms')::DOUBLE / 1000 AS s FROM ev),
    (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'Infinity'::DOUBLE]) AS le) GROUP BY ALL)"""


def _histogram(spark, folder):
    timed = events(spark, folder).withColumn("method", field("method"))
    return health.cumulative_histogram(
        timed, duration_ms() / 1000, S.HTTP_SECONDS_BOUNDS, ["method"]
    )


@query("g3_duration_histogram", ev_sql("SELECT * FROM hist", HIST_SQL))
def g3(spark, folder):
    return _histogram(spark, folder)


@query(
    "g4_histogram_quantiles",
    ev_sql(
        """SELECT method, quantile, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (quantile * total - below) / nullif(count - below, 0) END, 6) AS value
FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(count) OVER w, 0) AS below, max(count) OVER (PARTITION BY method) AS total
  FROM hist WINDOW w AS (PARTITION BY method ORDER BY le)), (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS quantile)
WHERE count >= quantile * total AND below < quantile * total""",
        HIST_SQL,
    ),
)
def g4(spark, folder):
    found = health.histogram_quantile(_histogram(spark, folder), (0.5, 0.95, 0.99), ["method"])
    return found.withColumn("value", r6("value"))


def _processed(spark, folder):
    """Outcome of processing each event: where it failed, if it did."""
    from eventloom.operators import ingest
    from eventloom.sources.canonical import flawed

    checked = ingest.validate(flawed(events(spark, folder)))
    stage = F.when(F.size("errors") > 0, F.col("errors")[0]["field"])
    return checked.select(
        F.when(stage.isNull(), "ok").otherwise("error").alias("status"), stage.alias("stage")
    )


STAGE_SQL = """done AS (SELECT CASE WHEN source = '' THEN 'source' WHEN severity = 'critical' THEN 'severity'
  WHEN len(tags) > 50 THEN 'tags' END AS stage, CASE WHEN stage IS NULL THEN 'ok' ELSE 'error' END AS status FROM flawed)"""


@query("g5_processed_by_status", ev_sql("SELECT status, count(*) AS total FROM done GROUP BY 1", "flawed", STAGE_SQL))
def g5_status(spark, folder):
    return health.outcomes(_processed(spark, folder), "status")


@query("g5_errors_by_stage", ev_sql("SELECT stage, count(*) AS total FROM done WHERE stage IS NOT NULL GROUP BY 1", "flawed", STAGE_SQL))
def g5_stage(spark, folder):
    return health.outcomes(_processed(spark, folder), "stage")


@query(
    "l6_phrase_match",
    ev_sql("""SELECT event_id FROM toks WHERE ' ' || array_to_string(d, ' ') || ' ' LIKE '% for external api %'""", TOK_SQL),
)
def l6(spark, folder):
    return search.phrase_search(events(spark, folder), "for external API").select("event_id")


@query(
    "l6_indexed_phrase",
    ev_sql("""SELECT event_id FROM toks WHERE ' ' || array_to_string(d, ' ') || ' ' LIKE '% for external api %'""", TOK_SQL),
)
def l6_indexed(spark, folder):
    """The phrase looked up in the stored terms."""
    path = work_folder(spark, "terms")
    search.write_term_table(events(spark, folder), path)
    return search.phrase_indexed(spark.read.parquet(path), "for external API").select("event_id")


@query(
    "l7_embedding_text",
    ev_sql("SELECT event_id, concat_ws(' ', source, event_type, severity, data) AS embedding_text FROM ev"),
)
def l7(spark, folder):
    return search.embedding_text(events(spark, folder)).select("event_id", "embedding_text")


@query(
    "l20_dependency_edges",
    ev_sql(
        """SELECT caller, callee, count(*) AS calls, round(count(*) FILTER (severity IN ('error','fatal')) / count(*), 6) AS error_rate,
  round(avg(ms), 6) AS mean_ms
FROM (SELECT path AS callee, severity, ms, lag(path) OVER w AS caller, epoch_us("timestamp") // 1000000 - epoch_us(lag("timestamp") OVER w) // 1000000 AS waited
  FROM (SELECT *, json_extract_string(data, '$.path') AS path, json_extract_string(data, '$.duration_ms')::DOUBLE AS ms FROM ev)
  WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)) WHERE waited <= 14400 AND caller <> callee GROUP BY ALL"""
    ),
)
def l20(spark, folder):
    edges = search.dependency_edges(events(spark, folder), field("path"), gap_seconds=14400)
    return edges.withColumn("error_rate", r6("error_rate")).withColumn("mean_ms", r6("mean_ms"))


@query(
    "l21_log_patterns",
    ev_sql(
        """SELECT template, count(*) AS count, count(*) FILTER (severity IN ('error','fatal')) AS errors,
  arg_min(data, ("timestamp", event_id)) AS sample, count(DISTINCT source) AS sources
FROM (SELECT *, regexp_replace(data, '[0-9]+', '<num>', 'g') AS template FROM ev) GROUP BY 1"""
    ),
)
def l21(spark, folder):
    return search.log_patterns(events(spark, folder))


def _near_sql(source: str, select: str) -> str:
    """Closure over templates that are equal once each has lost at most one word."""
    return f"""{source},
worded AS (SELECT template, regexp_extract_all(lower(template), '[a-z0-9_-]+') AS w FROM lines GROUP BY ALL),
variants AS (SELECT template, unnest(list_distinct(list_concat([array_to_string(w, ' ')], CASE WHEN len(w) >= {patterns.SHORTEST}
  THEN list_transform(range(1, len(w) + 1), lambda i: array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) ELSE [] END))) AS v FROM worded),
near AS MATERIALIZED (SELECT DISTINCT a.template AS x, b.template AS y FROM variants a JOIN variants b USING (v)),
reached AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reached r JOIN near n ON n.x = r.y),
grouped AS (SELECT x AS template, min(y) AS pattern_group FROM reached GROUP BY 1)
{select}"""


@query(
    "l21_near_groups",
    _near_sql(
        "WITH RECURSIVE " + ev_sql("", "lines AS (SELECT *, regexp_replace(data, '[0-9]+', '<num>', 'g') AS template FROM ev)")[5:],
        """SELECT pattern_group, count(DISTINCT template) AS templates, count(*) AS count,
  count(*) FILTER (severity IN ('error','fatal')) AS errors,
  arg_min(data, (template, "timestamp", event_id)) AS sample FROM lines JOIN grouped USING (template) GROUP BY 1""",
    ),
)
def l21_groups(spark, folder):
    return patterns.near_patterns(search.log_patterns(events(spark, folder)))


@query(
    "l21_near_urls",
    _near_sql(
        "WITH RECURSIVE lines AS (SELECT page_id, regexp_replace(url, '[0-9]+', '<num>', 'g') AS template FROM pages)",
        "SELECT page_id, pattern_group FROM lines JOIN grouped USING (template)",
    ),
)
def l21_urls(spark, folder):
    """Addresses of all pages, numbers masked, in near-duplicate groups."""
    lines = table(spark, folder, "pages").select("page_id", T.log_template(F.col("url")).alias("template"))
    return lines.join(patterns.near_groups(lines), "template").select("page_id", "pattern_group")


STOPS = ("the", "and", "in", "of", "to", "or", "on", "is")


@query(
    "l24_analyzers",
    """SELECT doc_id, analyzer, CAST(CASE analyzer WHEN 'standard' THEN len(regexp_extract_all(lower(text), '[a-z0-9_-]+'))
  WHEN 'letters' THEN len(regexp_extract_all(lower(text), '[a-z]+'))
  ELSE len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda x: x NOT IN ('the','and','in','of','to','or','on','is'))) END AS INTEGER) AS terms
FROM documents, (VALUES ('standard'), ('letters'), ('stop')) a(analyzer)""",
)
def l24(spark, folder):
    docs = table(spark, folder, "documents")
    sizes = F.array(
        *(
            F.struct(F.lit(a).alias("analyzer"), F.size(T.analyze(F.col("text"), a, STOPS)).alias("terms"))
            for a in ("standard", "letters", "stop")
        )
    )
    return docs.select("doc_id", F.explode(sizes).alias("a")).select("doc_id", "a.*")


@query(
    "l25_idempotency_keys",
    ev_sql(
        """SELECT key, arg_min(event_id, (received_at, event_id)) AS event_id, min(received_at) AS received_at
FROM (SELECT *, user_id || ':' || event_type || ':' || strftime("timestamp", '%Y-%m-%d') AS key FROM ev) GROUP BY 1"""
    ),
)
def l25(spark, folder):
    day = F.date_format("timestamp", "yyyy-MM-dd")
    keyed = events(spark, folder).select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type", day).alias("key"),
        "event_id", "received_at",
    )
    return specs.first_per_key(keyed, "key")


@query(
    "l27_sampling",
    ev_sql(
        """SELECT event_id, severity, CASE WHEN severity IN ('debug', 'info') THEN 10 ELSE 1 END AS weight FROM ev
WHERE severity NOT IN ('debug', 'info') OR CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT) % 10 = 0"""
    ),
)
def l27(spark, folder):
    return specs.sample_events(events(spark, folder)).select("event_id", "severity", "weight")


@query(
    "l35_transcript",
    """SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""",
)
def l35(spark, folder):
    return specs.transcript(table(spark, folder, "conversations")).select(
        "conv_id", "turn", "role", "text", "position"
    )
