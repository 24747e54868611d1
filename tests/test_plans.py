"""Skew-safe building blocks against brute force, with one key owning half of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.functions.quantiles import exact_percentiles
from eventloom.plans.pruning import between
from eventloom.plans.skew import (
    keep_one,
    previous,
    running_sum,
    salted_join,
    with_lookback,
)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 4000
    keys = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 20, n).astype(str))
    return pd.DataFrame(
        {"k": keys, "at": rng.permutation(n * 3)[:n], "v": rng.integers(-5000, 50000, n)}
    )


def rows(df, *columns):
    return sorted(map(tuple, df[list(columns)].itertuples(index=False)))


def test_running_sum(spark, frame):
    got = running_sum(
        spark.createDataFrame(frame), ["k"], F.floor(F.col("at") / 100), ["at"], "v", "total"
    ).toPandas()
    want = frame.sort_values("at")
    want["total"] = want.groupby("k").v.cumsum()
    assert rows(got, "k", "at", "total") == rows(want, "k", "at", "total")


def test_previous_crosses_empty_slots(spark, frame):
    got = previous(
        spark.createDataFrame(frame), ["k"], F.floor(F.col("at") / 50), ["at"], ["at", "v"], "p"
    ).select("k", "at", F.coalesce("p.at", F.lit(-1)).alias("before"))
    want = frame.sort_values("at")
    want["before"] = want.groupby("k")["at"].shift().fillna(-1).astype(int)
    assert rows(got.toPandas(), "k", "at", "before") == rows(want, "k", "at", "before")


def test_lookback_frames(spark, frame):
    from pyspark.sql import Window as W

    trailing = W.partitionBy("k", "_slot").orderBy("at").rangeBetween(-700, -1)
    got = (
        with_lookback(spark.createDataFrame(frame), F.col("at"), 300, 700)
        .withColumn("seen", F.count("v").over(trailing))
        .where("_own")
        .toPandas()
    )
    times = {k: np.sort(g["at"].to_numpy()) for k, g in frame.groupby("k")}
    want = frame.assign(
        seen=[
            int(((times[k] >= a - 700) & (times[k] < a)).sum()) for k, a in zip(frame.k, frame["at"])
        ]
    )
    assert rows(got, "k", "at", "seen") == rows(want, "k", "at", "seen")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, frame, how):
    left = spark.createDataFrame(frame)
    right = spark.createDataFrame(pd.DataFrame({"k": ["hot", "3", "none"], "w": [1, 2, 3]}))
    got = salted_join(left, right, ["k"], ["at"], how)
    plain = left.join(right, ["k"], how)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(
        map(str, plain.collect())
    )


def test_salts_follow_the_partitions(spark):
    from eventloom.plans.skew import salts_of

    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in (8, 400, 20000):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            found.append(salts_of(spark.range(1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == [16, 100, 256]


def test_keep_one_takes_the_least_of_many_copies(spark):
    copies = [("a", 3, "z"), ("a", 1, "y"), ("a", 1, "x"), ("b", 9, None)] * 50
    got = keep_one(spark.createDataFrame(copies, "k string, t int, v string"), ["k"], ["t"])
    assert sorted(got.collect()) == [("a", 1, "x"), ("b", 9, None)]


def test_exact_percentiles(spark, frame):
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(spark.createDataFrame(frame), ["k"], "v", wanted, stats=True)
    for row in got.collect():
        values = frame.v[frame.k == row.k]
        assert (row["count"], row["sum"], row["min"], row["max"]) == (
            len(values), values.sum(), values.min(), values.max(),
        )
        for name, fraction in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, fraction))


def test_weighted_percentiles_and_nulls(spark):
    data = [("a", 10, 3), ("a", 20, 1), ("a", None, 7), ("b", 5, 1)]
    df = spark.createDataFrame(data, "k string, v bigint, n bigint")
    got = {r.k: r.p50 for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5}, weight="n").collect()}
    assert got == {"a": 10.0, "b": 5.0}


def test_time_bounds_reach_parquet_and_prune_days(spark, tmp_path):
    from eventloom.sources.canonical import events
    from eventloom.sources.store import write_by_day

    ev = events(spark, "/root/testdata/sf0.001").select("event_id", "source", "timestamp")
    write_by_day(ev, str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    found = between(stored, "2024-01-03 06:00:00", "2024-01-04 00:00:00")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp,2024-01-03T06:00)" in plan
    assert found.count() == between(ev, "2024-01-03 06:00:00", "2024-01-04 00:00:00").count() > 0
    days = {str(r.event_date) for r in found.select("event_date").distinct().collect()}
    assert days == {"2024-01-03"}


def test_trailing_sums(spark, frame):
    from eventloom.plans.skew import trailing_sums

    got = trailing_sums(
        spark.createDataFrame(frame), ["k"], "at", {"n": F.lit(1), "total": F.col("v")}, (700, 1), 300
    ).toPandas()
    want = []
    for k, at in zip(frame.k, frame["at"]):
        near = frame[(frame.k == k) & (frame["at"] >= at - 700) & (frame["at"] < at)]
        want.append((len(near), int(near.v.sum())))
    want = frame.assign(n=[w[0] for w in want], total=[w[1] for w in want])
    assert rows(got, "k", "at", "n", "total") == rows(want, "k", "at", "n", "total")


def test_null_keys_form_a_group(spark):
    data = [(None, t, 1) for t in range(0, 300, 50)] + [("a", 5, 1)]
    df = spark.createDataFrame(data, "k string, at bigint, v bigint")
    slot = F.floor(F.col("at") / 100)
    total = running_sum(df, ["k"], slot, ["at"], "v", "n").where("k is null").orderBy("at").collect()
    assert [r.n for r in total] == [1, 2, 3, 4, 5, 6]
    before = previous(df, ["k"], slot, ["at"], ["at"], "p").where("k is null").orderBy("at").collect()
    assert [r.p and r.p.at for r in before] == [None, 0, 50, 100, 150, 200]


def test_percentiles_hold_no_arrays_and_count_null_keys(spark):
    data = [(None, float(v) / 4) for v in range(9001)] + [("a", 1.5), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99})
    assert "collect_list" not in got._jdf.queryExecution().toString()
    found = {r.k: (r.p50, r.p99) for r in got.collect()}
    assert found == {None: (1125.0, 2227.5), "a": (1.5, 1.5)}


def _plan_counts(df):
    """(scans, hash exchanges) of the initial plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")


def test_spans_and_groups_take_one_pass(spark, tmp_path):
    import datetime as dt
    import random

    from eventloom.operators import alerts

    rng = random.Random(8)
    now = dt.datetime(2024, 1, 2)
    rows = [(now + dt.timedelta(seconds=rng.randrange(400_000)), f"a{i}", rng.choice(["r", "s", None])) for i in range(3000)]
    rows += [(now + dt.timedelta(seconds=400_000 + 301 * i), f"z{i}", "edge") for i in range(5)]
    rows += [(now + dt.timedelta(seconds=300 * i), f"y{i}", "near") for i in range(5)] * 2
    spark.createDataFrame(rows, "fired_at timestamp, alert_event_id string, rule_id string").write.parquet(str(tmp_path / "alerts"))
    alert_events = spark.read.parquet(str(tmp_path / "alerts"))
    for gap in (0, 1, 60, 300):
        found = alerts.group_alerts(alert_events, gap=gap)
        want = set()
        for rule in {r for *_, r in rows}:
            times = sorted(t for t, _, r in rows if r == rule)
            groups = [[times[0]]]
            for t in times[1:]:
                groups[-1].append(t) if (t - groups[-1][-1]).total_seconds() <= gap else groups.append([t])
            want |= {(rule, k, len(g), g[0], g[-1]) for k, g in enumerate(groups, 1)}
        assert {tuple(r) for r in found.collect()} == want
    assert _plan_counts(alerts.group_alerts(alert_events)) == (1, 2)
    counts = spark.createDataFrame([(now, "s", "t", "error", 2)], "bucket timestamp, source string, event_type string, severity string, count bigint")
    counts.write.parquet(str(tmp_path / "counts"))
    scans, exchanges = _plan_counts(alerts.breach_spans(spark.read.parquet(str(tmp_path / "counts")), threshold=1))
    assert scans == 1 and exchanges <= 2


def test_velocity_takes_one_exchange_for_its_frames(spark, tmp_path):
    from eventloom.operators import anomaly

    spark.range(10).select(F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("user_id")).write.parquet(str(tmp_path / "ev"))
    scans, exchanges = _plan_counts(anomaly.user_velocity(spark.read.parquet(str(tmp_path / "ev"))))
    assert scans <= 2 and exchanges <= 7
