"""Mixing, packing, sharding and URL filters."""

import datetime as dt
import itertools
from collections import Counter

import pytest

from eventloom.llm import mixing, packing, sharding, url_filters
from tests.llm import brute


def test_mix_comes_near_its_targets(docs, corpus):
    got = mixing.mix_sources(docs).collect()
    size = {i: len(brute.words(t)) for i, t in corpus}
    own = Counter()
    for i, n in size.items():
        own[f"src{i % 5}"] += n
    caps = {s: 2 * n for s, n in own.items()}
    weight = dict(zip(sorted(own), itertools.cycle((3, 1, 2)), strict=False))
    level, open_ = None, set(own)
    while True:  # reshare the excess until none is above
        rest = 1.5 * sum(own.values()) - sum(caps[s] for s in own if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > caps[s]}
        if not above:
            break
        open_ -= above
    target = {s: level * weight[s] if s in open_ else float(caps[s]) for s in own}
    taken, largest = Counter(), Counter()
    for r in got:
        s = f"src{r['doc_id'] % 5}"
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], own[s])
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in own)
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(3)).collect())


def test_mixture_repeats_documents(docs, odd, empty):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 8 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixture(odd).columns == odd.columns
    assert mixing.mixture(odd).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(empty).count() == mixing.mixture(empty).count() == 0


def _padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    import random

    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
    counts = [rng.randint(1, 9) for _ in lengths]
    for buckets in (1, 2, 3, 20):
        got = packing.boundaries(lengths, counts, buckets)
        best = min(
            _padding(lengths, counts, [*c, lengths[-1]])
            for n in range(min(buckets, len(lengths)))
            for c in itertools.combinations(lengths[:-1], n)
        )
        assert len(got) <= buckets and got[-1] == lengths[-1]
        assert _padding(lengths, counts, got) == best


def test_batches_stay_within_the_budget(docs, corpus, odd, empty):
    got = packing.pack_documents(docs, budget=4000).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(brute.words(t)) for i, t in corpus}
    bounds = sorted({r["bucket_len"] for r in got})
    for r in got:
        assert r["bucket_len"] == min(b for b in bounds if b >= r["n_tokens"]) == r["n_tokens"] + r["padding"]
    sizes = Counter((r["bucket"], r["bucket_len"], r["batch"]) for r in got)
    assert all(n == 1 or n * length <= 4000 for (_, length, _), n in sizes.items())
    for bucket in {b for b, _, _ in sizes}:
        full = [n for (b, _, _), n in sorted(sizes.items()) if b == bucket]
        assert len(set(full[:-1])) <= 1 and full[-1] <= full[0]
    assert len(packing.pack_documents(odd).collect()) == 8
    assert packing.packed_documents(odd).select("doc.*").columns == odd.columns
    assert packing.pack_documents(empty).count() == 0


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != "s9")
    assert moved < 0.1 * 1009

    # Plainly: in turns, each shard takes the first free slot of its whole order of preference.
    orders = {
        s: [(sharding._number(f"offset|{s}") + j * (sharding._number(f"skip|{s}") % 1008 + 1)) % 1009 for j in range(1009)]
        for s in names
    }
    plain = {}
    for s in itertools.cycle(names):
        if len(plain) == 1009:
            break
        plain[next(at for at in orders[s] if at not in plain)] = s
    assert [plain[i] for i in range(1009)] == table
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_assign_shards(docs, odd, empty, tmp_path):
    table = sharding.lookup_table()
    got = sharding.assign_shards(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["slot"] == sharding._number(str(r["doc_id"])) % sharding.SLOTS and r["shard"] == table[r["slot"]]
    odd_rows = sharding.assign_shards(odd).collect()
    assert len(odd_rows) == 8 and len({r["slot"] for r in odd_rows if r["doc_id"] is None}) == 3
    assert sharding.assign_shards(empty).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), f"file://{tmp_path}/shards")
    back = docs.sparkSession.read.parquet(f"file://{tmp_path}/shards")
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == {r["doc_id"]: r["shard"] for r in got}


def test_url_filters(spark):
    day = dt.date
    entries = [
        (1, "a.example.com", "block", day(2024, 1, 10)), (1, "a.example.com", "allow", day(2024, 3, 5)),
        (0, "example.com", "block", day(2024, 2, 1)), (0, "example.com", "allow", day(2024, 2, 1)),
        (2, "b.example.com/x", "allow", day(2024, 2, 10)), (1, None, "block", day(2024, 1, 1)),
    ]
    cases = [
        ("http://a.example.com/q", day(2024, 1, 9), False, None), ("http://A.Example.com./q", day(2024, 1, 10), True, "a.example.com"),
        ("http://a.example.com", day(2024, 3, 4), True, "a.example.com"), ("http://a.example.com", day(2024, 3, 5), False, "a.example.com"),
        ("https://u:p@b.example.com:8/x?y", day(2024, 2, 9), True, "example.com"),
        ("https://b.example.com:8/x?y", day(2024, 2, 10), False, "b.example.com/x"),
        ("https://b.example.com/xx", day(2025, 7, 1), True, "example.com"),
        ("https://other.org/x", day(2024, 5, 1), False, None), ("nonsense", day(2024, 5, 1), False, None),
        (None, day(2024, 5, 1), False, None), ("http://a.example.com", None, False, None), ("", day(2024, 5, 1), False, None),
    ]
    captures = spark.createDataFrame([(i, u, d) for i, (u, d, _, _) in enumerate(cases)] + [(0, *cases[0][:2])], "page_id long, url string, fetched date")
    listed = spark.createDataFrame(entries, "rank int, pattern string, action string, day date")
    got = url_filters.filter_urls(captures, listed, "2024-12-31").collect()
    assert len(got) == len(cases) + 1
    assert {r["page_id"]: (r["blocked"], r["pattern"]) for r in got} == {i: c[2:] for i, c in enumerate(cases)}
    assert url_filters.filter_urls(captures, listed.limit(0), "2024-12-31").where("blocked").count() == 0
    assert url_filters.filter_urls(captures.limit(0), listed, "2024-12-31").count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://x.example.com/a", "<p>"), (1, "http://x.example.com/a", "<p>")], "page_id long, url string, host string")
    assert url_filters.filtered_pages(pages).count() == 3
