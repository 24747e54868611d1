"""The pipeline stage by stage, and the registered queries against their oracles."""

from collections import Counter

import pytest

import corpus_pipeline
from eventloom.llm import mixing, packing, quality_rules, sharding
from eventloom.llm.common import write_table
from eventloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import FOLDER
from tests.oracle import compare, connect


class _Entry:
    def __init__(self, name):
        self.run, self.sql = QUERIES[name], ORACLES.get(name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    problem, rows, _, _ = compare(spark, connect(FOLDER), name, _Entry(name), FOLDER)
    assert problem is None, problem
    assert rows > 0


def test_stages(spark, docs, corpus, labels):
    texts = dict(corpus)
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality rules"](spark, docs, FOLDER)
    want = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want

    first = write_table(steps["exact dedup"](spark, good, FOLDER), "exact")
    kept = {i for i, v in brute.exact_dedup([(i, texts[i]) for i in want]).items() if v[2]}
    rows = first.collect()
    assert first.columns == docs.columns and sorted(r["doc_id"] for r in rows) == sorted(kept)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)

    one = write_table(steps["SimHash near-dedup"](spark, first, FOLDER), "near")
    near = {i for i, v in brute.simhash([(i, texts[i]) for i in kept]).items() if v[1] == i}
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(near)

    mixed = write_table(steps["mixing"](spark, one, FOLDER), "mixed")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(one).collect() if r["copies"]}
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(copies)

    packed = steps["packing"](spark, mixed, FOLDER)
    plain = packing.pack_documents(mixed).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch")
    assert packed.columns == [*docs.columns, "n_tokens", "bucket", "bucket_len", "batch"]
    assert sorted(packed.select(plain.columns).collect()) == sorted(plain.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_tables(spark, request, which):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = write_table(stage(spark, docs, FOLDER), "stage")
        assert out.columns == docs.columns
        docs = out
    packed = write_table(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER), "packed")
    assert packed.count() == docs.count() and packed.columns[: len(docs.columns)] == docs.columns
    if which == "odd":
        whole = request.getfixturevalue(which)
        for name, stage in corpus_pipeline.STAGES[1:-1]:  # each for itself, as the first keeps none of these rows
            kept = write_table(stage(spark, whole, FOLDER), "alone")
            assert kept.count() > 0 and kept.columns == whole.columns, name
            assert kept.select("_id", "_sha", "_text_sha").distinct().collect() == [("clash",) * 3]
        packed = write_table(corpus_pipeline.pack(spark, whole, FOLDER), "packed")
        assert packed.count() == whole.count()
        assert packed.columns[len(docs.columns) :] == ["n_tokens", "bucket__", "bucket_len", "batch_"]
        assert packed.select("batch", "bucket_", "_id").distinct().collect() == [("clash",) * 3]


def test_shards_are_written_as_assigned(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*(c for c in odd.columns if c != "Shard"), "shard"]
    assert back.where("slot = 'clash'").count() == odd.count()
    placed = Counter((r["doc_id"], r["shard"]) for r in sharding.assign_shards(odd).collect())
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == placed
