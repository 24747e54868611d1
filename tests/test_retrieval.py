import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions.cursors import cursor_column, decode_cursor
from eventloom.functions.timeops import resolution_for, time_bounds
from eventloom.operators import analytics, health, retrieval, rollup
from eventloom.schemas import page_size

NOW = dt.datetime(2024, 1, 2)


def event_frame(spark, rows):
    return spark.createDataFrame(
        [(i, s, "t", v, t) for i, s, v, t in rows],
        "event_id string, source string, event_type string, severity string, timestamp timestamp",
    )


def test_page_size_rule():
    assert [page_size(n) for n in (None, 1, 1000)] == [50, 1, 1000]
    for wrong in (0, -1, 1001):
        with pytest.raises(ValueError):
            page_size(wrong)


def test_ranges():
    assert time_bounds(NOW) == (NOW - dt.timedelta(hours=1), NOW)
    assert time_bounds(NOW, "7d") == (NOW - dt.timedelta(days=7), NOW)
    assert time_bounds(NOW, "5y", start="2024-01-01T00:00:00Z") == (dt.datetime(2024, 1, 1), NOW)
    assert time_bounds(NOW, "15m", end="2024-01-01") == (
        dt.datetime(2023, 12, 31, 23, 45), dt.datetime(2024, 1, 1),
    )


def test_resolution():
    day = dt.timedelta(hours=24)
    assert resolution_for(None, NOW - day, NOW) == "1m"
    assert resolution_for("", NOW - 2 * day, NOW) == "1h"
    assert resolution_for("5m", NOW - 2 * day, NOW) == "1m"
    assert resolution_for("1h", NOW, NOW) == "1h"


def test_cursor_round_trip(spark):
    moment = dt.datetime(2024, 1, 1, 1, 2, 3, 456)
    df = spark.createDataFrame([(moment, "id/?>~")], "t timestamp, i string")
    text = df.select(cursor_column(F.col("t"), F.col("i")).alias("c")).first().c
    assert "+" not in text and "/" not in text
    assert decode_cursor(text) == (moment, "id/?>~", None)


@pytest.mark.parametrize("text", ["", "!!!", "bm90IGpzb24=", "W10="])
def test_bad_cursors(text):
    with pytest.raises(ValueError):
        decode_cursor(text)


def test_pages_cover_everything_once_despite_ties(spark):
    tick = dt.timedelta(minutes=1)
    rows = [(f"{i:03d}", "s", "info", NOW - tick * (i // 4)) for i in range(1, 24)]
    ev = event_frame(spark, rows)
    seen, cursor = [], None
    while True:
        page = retrieval.event_page(ev, as_of=NOW, cursor=cursor, limit=5).orderBy("position").collect()
        seen += [r.event_id for r in page]
        cursor = page[-1].next_cursor
        if not page[-1].has_more:
            break
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True)]
    assert cursor is None


def test_default_bound_and_open_end(spark):
    rows = [("a", "s", "info", NOW - dt.timedelta(hours=24)), ("b", "s", "info", NOW - dt.timedelta(hours=24, seconds=1)), ("c", "s", "info", NOW + dt.timedelta(hours=1))]
    ev = event_frame(spark, rows)
    found = retrieval.query_events(ev, as_of=NOW).collect()
    assert [r.event_id for r in found] == ["c", "a"]
    assert retrieval.query_events(ev, as_of=NOW, start=NOW, end=NOW).count() == 0


def test_live_row_wins(spark):
    live = event_frame(spark, [("a", "new", "info", NOW), ("b", "new", "error", NOW)])
    old = event_frame(spark, [("a", "old", "info", NOW), ("c", "old", "error", NOW)])
    got = [(r.event_id, r.source) for r in retrieval.live_tail(live, old).collect()]
    assert got == [("c", "old"), ("b", "new"), ("a", "new")]
    assert [r.event_id for r in retrieval.live_tail(live, old, "error").collect()] == ["c", "b"]


def counts_frame(spark, rows):
    return spark.createDataFrame(
        [(t, s, "t", v, n) for t, s, v, n in rows],
        "bucket timestamp, source string, event_type string, severity string, count bigint",
    )


def test_empty_range_gives_zeros(spark):
    counts = counts_frame(spark, [(NOW, "a", "info", 3)])
    row = analytics.summary_totals(counts, "2020-01-01", "2020-01-02").first()
    assert (row.total_events, row.error_count, row.error_rate, row.active_sources) == (0, 0, 0.0, 0)
    assert retrieval.overview(event_frame(spark, [])).first() == (0, 0, 0, 0.0)


def test_top_n_ties_and_limits(spark):
    rows = [(NOW, s, "info", 5) for s in "dcba"]
    counts = counts_frame(spark, rows)
    later = NOW + dt.timedelta(minutes=1)
    top = analytics.top_n(counts, NOW, later, limit=2).collect()
    assert [r.key for r in top] == ["a", "b"]
    assert analytics.top_n(counts, NOW, later, limit=100).count() == 4
    with pytest.raises(ValueError):
        analytics.top_n(counts, NOW, later, limit=101)


def test_volume_chart_has_thirteen_buckets(spark):
    at = dt.datetime(2024, 1, 1, 10, 2)
    counts = counts_frame(spark, [(at, "a", "fatal", 2), (at, "a", "debug", 3), (at - dt.timedelta(hours=2), "a", "info", 9)])
    rows = analytics.volume_chart(counts, as_of="2024-01-01 10:04:59").collect()
    assert len(rows) == 13 and rows[0].bucket == dt.datetime(2024, 1, 1, 9, 0)
    assert (rows[-1].info, rows[-1].warn, rows[-1].error) == (3, 0, 2)
    assert sum(r.info + r.warn + r.error for r in rows) == 5


def test_count_merges(spark):
    stored = counts_frame(spark, [(NOW, "a", "info", 3), (NOW, "b", "info", 1)])
    delta = counts_frame(spark, [(NOW, "a", "info", 2), (NOW, "c", "info", 7)])
    added = {r.source: r["count"] for r in rollup.add_counts(stored, delta).collect()}
    replaced = {r.source: r["count"] for r in rollup.replace_counts(stored, delta).collect()}
    assert added == {"a": 5, "b": 1, "c": 7}
    assert replaced == {"a": 2, "b": 1, "c": 7}


def test_minute_bounds_match_bucket_bounds(spark):
    ev = event_frame(spark, [(str(i), "s", "info", NOW + dt.timedelta(seconds=17 * i)) for i in range(40)])
    start, end = NOW + dt.timedelta(seconds=61), NOW + dt.timedelta(seconds=305)
    from eventloom.plans.pruning import between

    pushed = rollup.minute_counts(ev, start, end).collect()
    plain = between(rollup.minute_counts(ev), start, end, "bucket").collect()
    assert sorted(pushed) == sorted(plain) != []


def test_histogram_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (0.5, 1.5, 1.6, 3.0, 99.0)], "v double")
    hist = health.cumulative_histogram(df, F.col("v"), (1, 2, 4))
    assert sorted((r.le, r["count"]) for r in hist.collect()) == [
        (1.0, 1), (2.0, 3), (4.0, 4), (float("inf"), 5),
    ]
    got = {r.quantile: r.value for r in health.histogram_quantile(hist, (0.0, 0.2, 0.5, 0.99)).collect()}
    assert got == {0.0: 0.0, 0.2: 1.0, 0.5: pytest.approx(1.75), 0.99: 4.0}
    empty = health.cumulative_histogram(df.where("v < 0"), F.col("v"), (1, 2))
    assert health.histogram_quantile(empty, (0.5,)).count() == 0


def test_increase_survives_a_reset(spark):
    minute = dt.timedelta(minutes=1)
    values = [10, 15, 3, 4]
    df = spark.createDataFrame([("a", NOW + minute * i, v) for i, v in enumerate(values)], "k string, timestamp timestamp, value bigint")
    assert health.increase(df, ["k"]).first().increase == 5 + 3 + 1


def test_aggregate_allow_lists(spark):
    ev = event_frame(spark, [("a", "s", "info", NOW)])
    for bad in ({"function": "exec"}, {"metric": "data; drop"}, {"group_by": ("secret",)}, {"function": "sum"}):
        with pytest.raises(ValueError):
            analytics.aggregate(ev, **bad)
