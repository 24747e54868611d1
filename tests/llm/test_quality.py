"""Quality rules and classifier."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import quality_classifier as qc
from eventloom.llm import quality_rules as q
from tests.llm import brute

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(docs, corpus, labels):
    got = q.quality_rules(docs, labels).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in got} == {i: brute.base_counts(t) for i, t in corpus}
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_exact_binomial_bound(spark):
    rows = [(k, n) for n in (1, 20, 400, 9000) for k in (0, 1, 3, 25) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", q._at_most(F.col("k"), F.col("n"), 0.004).alias("p"))
    for r in df.collect():
        want = sum(math.comb(r["n"], i) * 0.004**i * 0.996 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert math.isclose(r["p"], want, rel_tol=1e-9)


def test_cutoffs_are_certified(spark):
    """Enough labelled documents certify the symbol rule; a rate that good ones share is left alone."""
    def rows(n, good, symbols):
        return [(i if good else 10**6 + i, 0, symbols, 400) for i in range(n)]

    data = rows(6000, True, 20) + rows(300, False, 350)
    judged = spark.createDataFrame(data, "doc_id long, band int, s long, w long").select(
        "doc_id", "band", F.lit(False).alias("base_failed"),
        F.array(
            *(
                F.struct(F.lit(r).alias("rule"), (F.col("s") if r == "symbols" else F.col("w")).alias("rate"))
                for r in q.RULES
            )
        ).alias("rates"),
    )
    marks = judged.select("doc_id", (F.col("doc_id") < 10**6).cast("int").alias("quality"))
    assert [r.asDict() for r in q.cutoffs(judged, marks).collect()] == [{"band": 0, "cuts": {"symbols": 300}}]
    few = marks.where("doc_id < 200 or doc_id >= 1000000")
    assert q.cutoffs(judged, few).count() == 0


def test_several_strata_reject(spark):
    """Strata get cutoffs of their own, of different rules; one with too few labels keeps what passes the base rules."""
    rates = {0: ("symbols", 350), 1: ("same_words", 650), 2: ("capitals", 250), 3: ("symbols", 350)}
    n_good = {0: 2000, 1: 1900, 2: 1860, 3: 500}
    data = [
        (band * 10**4 + i, band, rates[band][0], 5 if i < n else rates[band][1], int(i < n))
        for band, n in n_good.items()
        for i in range(n + 40)
    ]
    df = spark.createDataFrame(data, "doc_id long, band int, rule string, rate long, quality int")
    rate = lambda r: F.when(F.col("rule") == r, F.col("rate")).otherwise(F.lit(0).cast("bigint"))
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), rate(r).alias("rate")) for r in q.RULES))
    judged = df.select("doc_id", "band", F.lit(False).alias("base_failed"), cells.alias("rates"), "quality")
    cuts = q.cutoffs(judged, df.select("doc_id", "quality"))
    want = {0: {"symbols": 300}, 1: {"same_words": 600}, 2: {"capitals": 200}}
    assert {r["band"]: r["cuts"] for r in cuts.collect()} == want
    counted = q.decided(judged, cuts).groupBy("band", "quality").agg(F.sum(F.col("kept").cast("int")).alias("n"))
    left = {(r["band"], r["quality"]): r["n"] for r in counted.collect()}
    assert left == {(b, 1): n for b, n in n_good.items()} | {(b, 0): 40 * (b == 3) for b in n_good}


def test_odd_tables(odd, empty, labels):
    got = q.quality_rules(odd, labels).collect()
    assert len(got) == 8 and sum(r["n_words"] == 0 for r in got) == 2
    kept = q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert q.quality_rules(empty, labels).count() == 0
    none = labels.limit(0)
    assert q.quality_rules(odd, none).where("kept").count() == sum(not r["base_failed"] for r in got)
    assert q.keep_good(empty, none).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((2000, len(qc.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = qc.fit(x[:1500], y[:1500])
    assert ((qc.scores(model, x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95

    def walk(row, root):
        at = root
        while model.left[at] != at:
            at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
        return model.value[at]

    want = [model.base + sum(walk(row, r) for r in model.roots) for row in x[:50]]
    assert np.allclose(qc.scores(model, x[:50]), 1 / (1 + np.exp(-np.array(want))))


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in qc.quality_classifier(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    marked = [(got[r["doc_id"]], r["quality"]) for r in labels.collect()]
    held = [r["predicted"] == quality for r, quality in marked if r["held_out"]]
    assert np.mean(held) > 0.95
    # Labels of held-out rows teach nothing.
    other = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in qc.quality_classifier(docs, other).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_classifier_on_odd_tables(odd, empty, labels):
    got = qc.quality_classifier(odd, labels.limit(0)).collect()
    assert len(got) == 8 and {r["score"] for r in got} == {0.5}
    assert qc.quality_classifier(empty, labels).count() == 0
