"""Aggregates and ids that are looked up in stored tables instead of events."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import anomaly, distincts, moments, retrieval, sketches
from eventloom.operators.ingest import sortable_id
from eventloom.schemas import EVENT
from eventloom.sources.store import write_by_day

NOW = dt.datetime(2024, 1, 2)


def rows_scanned(df):
    """Rows that the scans of a finished query let through, from its metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName().startswith("Scan parquet"):
                rows += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Some days of events whose ids don't follow the order of the files, in many row groups."""
    path = str(tmp_path_factory.mktemp("stored"))
    rows = spark.range(60_000).select(
        F.col("id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 3 * 86_400 + F.pmod(F.xxhash64("id"), F.lit(86_000))).alias("timestamp")
    )
    at = F.col("timestamp") + F.when(F.col("id") == 11, F.expr("interval 9 days")).otherwise(F.expr("interval 1 minute"))
    ev = rows.select(
        sortable_id(at, F.col("id").cast("string")).alias("event_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"),
        F.lit("t").alias("event_type"), F.lit("info").alias("severity"), "timestamp", at.alias("received_at"),
        F.format_string('{"n":%d}', "id").alias("data"), F.array().cast("array<string>").alias("tags"), F.lit("{}").alias("metadata"),
    )
    spark.conf.set("parquet.block.size", 64 << 10)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        write_by_day(ev.select(*EVENT.fieldNames()).repartition(2), path, ids=["event_id"])
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    return spark.read.parquet(path)


def test_lookup_by_id_skips_row_groups_and_days(spark, stored, tmp_path):
    want = {r["n"]: r["event_id"] for r in stored.select("event_id", F.get_json_object("data", "$.n").cast("int").alias("n")).where("n in (5, 17, 44000)").collect()}
    found = retrieval.stored_events_by_id(stored, [want[5]])
    assert [r["data"] for r in found.collect()] == ['{"n":5}']
    absent = want[5][:-4] + ("0000" if want[5][-4:] != "0000" else "1111")
    nothing = stored.where(F.col("event_id") == absent)
    assert nothing.collect() == [] and rows_scanned(nothing) == 0
    # The same files without filters: the ids' least and greatest values alone do not tell.
    write_by_day(stored.drop("event_date"), str(tmp_path))
    unfiltered = spark.read.parquet(str(tmp_path)).where(F.col("event_id") == absent)
    assert unfiltered.collect() == [] and rows_scanned(unfiltered) > 0
    assert rows_scanned(found) < 15_000
    many = retrieval.stored_events_by_id(stored, [*want.values(), "0" * 28, want[5]]).collect()
    assert sorted(r["data"] for r in many) == ['{"n":17}', '{"n":44000}', '{"n":5}']


def test_lookup_of_late_events_and_other_ids(spark, stored):
    """An event received nine days late lies before the days searched first; ids of another form search all days."""
    late = stored.where(F.get_json_object("data", "$.n") == "11").first()["event_id"]
    recent = stored.where(F.get_json_object("data", "$.n") == "12").first()["event_id"]
    got = retrieval.stored_events_by_id(stored, [late]).collect()
    assert [r["data"] for r in got] == ['{"n":11}']
    assert len(retrieval.stored_events_by_id(stored, [late, recent]).collect()) == 2
    assert retrieval.stored_events_by_id(stored, ["no id", recent]).count() == 1
    assert retrieval.stored_events_by_id(stored, []).count() == 0
    assert retrieval.received_day("0" * 28) == dt.date(1970, 1, 1) and retrieval.received_day("x") is None


def test_merged_sketches_stay_within_their_rank_error(spark):
    """A hot source of 200 000 durations over a day, skewed and with ties, sketched by minute and merged."""
    ms = F.floor(F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)))
    ev = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 86_400).alias("timestamp"), F.lit("hot").alias("source"),
        F.format_string('{"path":"/a","duration_ms":%d}', ms.cast("bigint")).alias("data"), ms.alias("ms"),
    ).persist()
    values = np.sort([r["ms"] for r in ev.select("ms").collect()])
    day = sketches.sketch_percentiles(sketches.merge_sketches(sketches.latency_sketches(ev), "1 day", ["source"]))
    row = day.first()
    assert (row["count"], row["sum"], row["min"], row["max"]) == (len(values), values.sum(), values[0], values[-1])
    for name, p in sketches.PERCENTILES.items():
        low, high = (np.searchsorted(values, row[name], side) / len(values) for side in ("left", "right"))
        assert low - sketches.RANK_ERROR <= p <= high + sketches.RANK_ERROR, name
    few = sketches.latency_sketches(ev.where("id < 3").withColumn("data", F.lit("{}")))
    assert few.count() == 0 and sketches.sketch_percentiles(sketches.merge_sketches(few)).count() == 0


def test_bitmaps_count_numbered_values_exactly(spark):
    """More values than a bitmap holds, numbers that stay when new values come, nulls and empty ranges."""
    rng = random.Random(2)
    rows = [(NOW + dt.timedelta(minutes=rng.randrange(3000)), rng.randrange(50_000) if i % 9 else None) for i in range(60_000)]
    ev = spark.createDataFrame(rows, "timestamp timestamp, user long")
    first = distincts.number_values(ev.where("user < 1000"), "user").persist()
    numbers = distincts.number_values(ev, "user", first).persist()
    pairs = {r["value"]: r["number"] for r in numbers.collect()}
    assert sorted(pairs.values()) == list(range(len({u for _, u in rows if u is not None})))
    assert all(pairs[r["value"]] == r["number"] for r in first.collect())
    maps = distincts.hour_bitmaps(ev, "user", numbers).persist()
    assert maps.select("part").distinct().count() == 2
    for hours in ((0, 50), (3, 4), (7, 31), (60, 70)):
        start, end = (NOW + dt.timedelta(hours=h) for h in hours)
        want = len({u for t, u in rows if start <= t < end and u is not None})
        assert distincts.distinct_between(maps, start, end).first()["distinct_values"] == want


@pytest.mark.parametrize("as_of", ["2024-01-02 14:00:00", "2024-01-02 14:20:00", "2024-01-02 14:55:00", "2024-01-05 00:00:00"])
def test_stored_moments_equal_baselines_from_counts(spark, as_of):
    rng = random.Random(6)
    rows = []
    for source, mean in (("a", 5), ("b", 10**7), ("once", 0), ("silent", 3)):
        for i in range(0, 3000, 3):
            at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
            if source == "once" and i != 2280 or source == "silent" and i > 2000:
                continue
            rows += [(at, source, "t", v, mean + rng.randrange(4)) for v in ("info", "error")[: 1 + rng.randrange(2)]]
    counts = spark.createDataFrame(rows, "bucket timestamp, source string, event_type string, severity string, count bigint").persist()
    names = ["source", "windows", "current_total", "current_errors", "error_rate_mean", "error_rate_stddev",
             "event_count_mean", "event_count_stddev", "current_error_rate"]

    def table(df):
        return {r["source"]: [x if isinstance(x, int) else pytest.approx(x, rel=1e-9, abs=1e-12) for x in list(r)[1:]] for r in df.select(names).collect()}

    hours = moments.hour_moments(counts)
    got = {s: [getattr(x, "expected", x) for x in r] for s, r in table(moments.stored_baselines(hours, counts, as_of=as_of)).items()}
    assert got == table(anomaly.source_baselines(counts, as_of=as_of))


def test_stored_baselines_read_the_ends_of_the_day_alone(spark, tmp_path):
    counts = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "s", "t", "info", 1) for i in range(2880)],
        "bucket timestamp, source string, event_type string, severity string, count bigint",
    )
    write_by_day(counts, f"{tmp_path}/counts", "bucket", sort=("source", "bucket"))
    write_by_day(moments.hour_moments(counts), f"{tmp_path}/moments", "bucket", sort=("source", "bucket"))
    read = spark.read.parquet
    found = moments.stored_baselines(read(f"{tmp_path}/moments"), read(f"{tmp_path}/counts"), as_of="2024-01-02 23:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-02 22:00:00" in plan and "2024-01-01 23:00:00" in plan
    with pytest.raises(ValueError):
        moments.stored_baselines(counts, counts, as_of="2024-01-02 23:01:00")
