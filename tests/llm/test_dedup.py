"""Deduplication operators against brute force and on odd tables."""

import tracemalloc
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import suffix_dedup as sd
from eventloom.llm import substring_dedup as sk
from eventloom.llm import suffixes
from eventloom.llm.components import components
from eventloom.llm.exact_dedup import BLOCK, exact_dedup, keep_first
from eventloom.llm.simhash import keep_one, links, simhash_dedup
from eventloom.llm.substring_dedup import substring_dedup
from eventloom.llm.suffix_dedup import suffix_dedup
from eventloom.llm.suffixes import suffix_order
from tests.llm import brute


def by_id(rows, *columns):
    return {r["doc_id"]: tuple(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns) for r in rows}


def test_substring_dedup(docs, corpus):
    got = by_id(substring_dedup(docs).collect(), "n_words", "n_removed", "kept_text")
    assert got == brute.substring_dedup(corpus)


def test_substring_dedup_deals_large_buckets_again(docs, corpus, monkeypatch):
    rows = sorted(corpus, key=lambda r: r[0])
    texts = [" ".join(brute.words(t)).encode() for _, t in rows if len(brute.words(t)) >= 20]
    keys = np.array([i for i, t in rows if len(brute.words(t)) >= 20], np.int64)
    group = sk.Group(b"\n".join(texts), np.zeros(len(keys), np.int8), keys, np.zeros(len(keys), np.int32))

    def found():
        return {
            (key, place + i)
            for _, ks, ps, ns in sk._marked(group, 20)
            for key, place, n in zip(ks.tolist(), ps.tolist(), ns.tolist(), strict=True)
            for i in range(n)
        }

    whole = found()
    monkeypatch.setattr(sk, "BUCKET_BYTES", 20_000)
    assert whole and found() == whole


def test_words_take_little_memory():
    """A task holds two 8 MB chunks or a 16 MB bucket of text: places of words may be numbered, those of bytes may not."""
    data = np.frombuffer(b"seven77 " * (1 << 18) + b"end", np.uint8)
    tracemalloc.start()
    words = sk.words_of(data, np.array([0, 4, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.text.tobytes() == b"seve n77 " + b"seven77 " * ((1 << 18) - 1) + b"end "
    assert peak < 15 * len(data)


def test_substring_buckets_are_bounded(spark, monkeypatch):
    """A phrase in a third of the documents, and a passage shorter than a window in others, among different words."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    phrase, passage = ["aa", "bb", "cc", "dd"], [f"p{i}" for i in range(18)]
    rows = []
    for i in range(1500):
        inner = phrase if i % 3 == 0 else passage if i % 3 == 1 else word(4)
        rows.append((i, " ".join(word(30) + inner + word(30))))
    rows += [(2000 + i, t) for i, t in rows[:40]]
    docs = sk.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    limit = 12_000

    def largest():
        sizes: dict[int, int] = {}
        for r in sk.sent_strings(docs, bucket_bytes=limit).where("data is not null").collect():
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(sk.zstandard.decompress(r["data"]))
        return max(sizes.values())

    assert largest() <= sk.CROWDED * limit
    with monkeypatch.context() as once:
        once.setattr(sk, "crowded_buckets", lambda *_: [])
        assert largest() > 2 * sk.CROWDED * limit

    def found(**limits):
        return {
            (r["key"], r["first"] + i)
            for r in sk.marks(docs, **limits).collect()
            for i in range(r["windows"])
        }

    whole = found()
    assert len(whole) >= 40 * 45 and found(bucket_bytes=limit) == whole


def test_suffix_dedup(docs, corpus):
    got = suffix_dedup(docs).collect()
    for r in got:
        assert r["n_removed"] == sum(s["bytes"] for s in r["spans"])
    want = {i: (n, gone, kept) for i, (n, gone, _, kept) in brute.suffix_dedup(corpus).items()}
    assert by_id(got, "n_bytes", "n_removed", "kept_bytes") == want
    assert {r["doc_id"]: len(r["spans"]) for r in got} == {i: v[2] for i, v in brute.suffix_dedup(corpus).items()}


def test_suffix_dedup_deals_large_buckets_again(corpus, monkeypatch):
    parts = [t.encode()[:4000] for _, t in corpus if t and len(t.encode()) >= 400]
    n = len(parts)
    group = sd.Group(parts, np.zeros(n, np.int8), np.arange(n), np.zeros(n, np.int32))

    def found():
        return {
            (key, first + i)
            for _, ks, fs, ns in sd._marked(group, 400)
            for key, first, m in zip(ks.tolist(), fs.tolist(), ns.tolist(), strict=True)
            for i in range(m)
        }

    whole = found()
    monkeypatch.setattr(sd, "BUCKET_BYTES", 10_000)
    assert whole and found() == whole


@pytest.mark.parametrize("shared", [200, 395])
def test_suffix_buckets_are_bounded(spark, monkeypatch, shared):
    """A passage shorter than a window in all documents, among different bytes, and some copies of documents."""
    rng = np.random.default_rng(shared)
    letters = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    passage = letters(shared)
    # A few surroundings occur twice right beside the passage, so that windows with both do too.
    sides = [(letters(500), letters(500)) for _ in range(390)]
    rows = [(i, a + passage + b) for i, (a, b) in enumerate(sides)]
    rows += [(1000 + i, letters(300) + a[-40:] + passage + b[:40] + letters(300)) for i, (a, b) in enumerate(sides[:150])]
    rows += [(2000 + i, t) for i, t in rows[:20]]
    docs = sd.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    limit = 8_000

    def largest():
        sizes: dict[int, int] = {}
        for r in sd.sent_pieces(docs, bucket_bytes=limit)[0].collect():
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(sd.zstandard.decompress(r["data"]))
        return max(sizes.values(), default=0)

    def found(**limits):
        return {
            (r["key"], r["first"] + i)
            for r in sd.marks(docs, **limits).collect()
            for i in range(r["windows"])
        }

    assert largest() <= 2 * sd.CROWDED * limit
    digested, by_digest = [], sd._by_digest
    with monkeypatch.context() as once:
        once.setattr(sd, "_by_digest", lambda *x: digested.append(1) or by_digest(*x))
        dealt = found(bucket_bytes=limit)
    assert digested or shared < 395
    seen: dict[str, list] = {}
    for i, t in rows:
        for at in range(len(t) - 399):
            seen.setdefault(t[at : at + 400], []).append((i, at))
    assert dealt == {p for at in seen.values() if len(at) > 1 for p in at}
    assert found() == dealt
    with monkeypatch.context() as once:
        once.setattr(sd, "CROWDED", 10**6)
        assert largest() > 2 * 4 * limit


def test_long_rows_are_cut_into_segments(docs, corpus, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 1000)
    import pyarrow as pa

    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
    parts = list(sd.raw_segments(batch, 400))
    starts = [b[0] + i for d, _, _, b in parts for i in range(len(d) - 399)]
    assert starts == list(range(5000 - 399))
    assert all(bytes(d).decode() == text[b[0] : b[0] + len(d)] for d, _, _, b in parts)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    unit = rng.integers(0, 2 + seed, 300).astype(np.uint8)
    text = np.concatenate([unit, unit[:200], unit, [0, 0], unit[50:], np.full(90, 1), [0]]).astype(np.uint8)
    data = text.tobytes()
    order = suffix_order(text, 60).tolist()
    assert sorted(order) == list(range(len(data)))
    pad = data + b"\0" * 60
    heads = [pad[i : i + 60] for i in order]
    assert heads == sorted(heads)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_of_wanted(seed):
    """Wanted suffixes are in order, and of the others only some behind each run of wanted ones are touched."""
    rng = np.random.default_rng(seed)
    unit = rng.integers(0, 2 + seed, 300).astype(np.uint8)
    text = np.concatenate([unit, unit[:200], unit, [0, 0], unit[50:], np.full(90, 1), [0]]).astype(np.uint8)
    wanted = np.repeat(rng.random(len(text) // 20 + 1) < 0.3, 20)[: len(text)]
    order = suffix_order(text, 60, wanted)
    assert len(set(order.tolist())) == len(order) and set(np.flatnonzero(wanted)) <= set(order.tolist())
    small = [text[i:].tobytes() < text[i + 1 :].tobytes() for i in range(len(text))]
    for i in sorted(set(order.tolist()) - set(np.flatnonzero(wanted).tolist())):
        assert i - 1 in order and not small[i - 1]
    pad = text.tobytes() + b"\0" * 60
    heads = [pad[i : i + 60] for i in order[wanted[order]].tolist()]
    assert heads == sorted(heads)


def test_suffix_sorting_leaves_the_rest_of_pieces_alone(monkeypatch):
    """Bytes behind a piece's last window are not sorted, and suffixes that agree to the depth are compared once."""
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 450)
    parts = [np.concatenate((rng.integers(97, 123, 20), passage, rng.integers(97, 123, 20), [0])) for _ in range(200)]
    text = np.concatenate(parts).astype(np.uint8)
    at = np.arange(len(text)) % len(parts[0])
    valid = at + 400 < len(parts[0])
    compared, same = [], suffixes._Text.same
    monkeypatch.setattr(suffixes._Text, "same", lambda *a: compared.append(len(a[1])) or same(*a))
    found = suffixes.repeated(text, valid, 400)
    heads = [text[i : i + 400].tobytes() for i in np.flatnonzero(valid).tolist()]
    assert found[valid].tolist() == [n > 1 for n in map(Counter(heads).get, heads)] and not found[~valid].any()
    # The suffixes that start a window were compared some nine times each, and so were all others.
    assert sum(compared) < 2 * valid.sum()


def test_suffix_dedup_goes_by_bytes_and_not_by_words(spark):
    """Passages of over 50 words in two documents: 400 bytes go, 399 and texts on their own stay."""
    rng = np.random.default_rng(7)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist()).decode()
    own = lambda: " ".join(word(5) for _ in range(60))
    short, long = (" ".join([word(6) for _ in range(56)] + [word(n)]) for n in (7, 8))
    assert (len(short), len(long)) == (399, 400)
    rows = [(i, f"{own()} {i}{(long, short, '')[i // 2]}{i} {own()}") for i in range(6)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 400, 1: 400, 2: 0, 3: 0, 4: 0, 5: 0}


def test_exact_dedup(docs, corpus):
    got = by_id(exact_dedup(docs).collect(), "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact_dedup(corpus)


def test_exact_dedup_tells_long_texts_apart(spark):
    base = "x" * (BLOCK * 5 + 7)
    rows = [(1, base), (2, base[:-1] + "y"), (3, "y" + base[1:]), (4, base), (5, base + base), (6, base[: BLOCK * 4])]
    rows += [(7, base[:BLOCK]), (8, base[: BLOCK * 2]), (9, base[:BLOCK])]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 7}


def test_simhash(docs, corpus):
    got = by_id(simhash_dedup(docs).collect(), "fingerprint", "component_id")
    assert got == brute.simhash(corpus)


@pytest.mark.parametrize("most", [0, 3, 64])
def test_links_join_all_within_the_radius(spark, monkeypatch, most):
    from eventloom.llm import simhash

    monkeypatch.setattr(simhash, "PAIRWISE", most)
    rng = np.random.default_rng(most)
    values = {0, -1, 1, 7, 15}
    for centre in rng.integers(-(2**63), 2**63, 4).tolist():
        for flips in rng.integers(0, 5, 40).tolist():
            value = centre % 2**64
            for bit in rng.choice(64, flips, replace=False).tolist():
                value ^= 1 << bit
            values.add(value - 2**64 if value >= 2**63 else value)
    near = lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = links(fps)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert all(near(a, b) and a != b for a, b in pairs)
    got = {r["node"]: r["root"] for r in components(found).collect()}
    want = {v: root for v, root in brute.roots(values, near).items()}
    assert {v: got.get(v, v) for v in values} == want


@pytest.mark.parametrize("most", [0, 64])
def test_variants_of_fingerprints_are_not_broadcast(spark, monkeypatch, tmp_path, most):
    """A table of a few kilobytes has 34 variants per row and more points around them: too many for the driver."""
    from eventloom.llm import simhash

    plans = []

    def spy(df, name, *args, write=simhash.write_table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, *args)

    monkeypatch.setattr(simhash, "PAIRWISE", most)
    monkeypatch.setattr(simhash, "write_table", spy)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) == 10 << 20
    spark.range(50).selectExpr("id * 1000003 AS fp").write.parquet(f"{tmp_path}/fps")
    found = links(spark.read.parquet(f"{tmp_path}/fps"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and all("Join" in plan and "Broadcast" not in plan for plan in plans)


def test_places_of_blocks_are_not_broadcast(spark, docs, monkeypatch):
    from eventloom.llm import exact_dedup as ed

    plans = {}

    def spy(df, name, *args, write=ed.write_table):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *args)

    monkeypatch.setattr(ed, "write_table", spy)
    assert keep_first(docs).count() > 0
    assert "Join" in plans["names-0"] and "Broadcast" not in plans["names-0"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 50)] + [(-3, 300), (7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in got}
    assert len(got) == len(root)
    assert {root[i] for i in range(61)} == {0}
    assert {root[200 + i] for i in range(50)} == {200}
    assert root[300] == -3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty):
    assert substring_dedup(empty).count() == 0
    assert suffix_dedup(empty).count() == 0
    assert exact_dedup(empty).count() == 0
    assert simhash_dedup(empty).count() == 0
    assert keep_first(empty).columns == empty.columns and keep_first(empty).count() == 0
    assert keep_one(empty).columns == empty.columns and keep_one(empty).count() == 0


def test_odd_rows_substring(odd):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup(odd).collect())
    n = 60 + 11 * 9
    inner = got[2][3]
    # The repeated row keeps what the first keeps; documents 3 and those without id lose the copy.
    assert got[:4] == [(False, -5, 1, 0), (False, 1, n, inner), (False, 1, n, inner), (False, 2, 0, 0)]
    assert got[4] == (False, 3, n, n)
    assert got[5] == (True, 0, 0, 0)
    assert {g[3] for g in got[6:]} == {n}


def test_odd_rows_suffix(odd):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup(odd).collect())
    size = got[1][2]
    assert [g[3] for g in got] == [0, size, size, 0, size, 0, size, size]


def test_repeated_rows_are_no_copies(spark):
    text = " ".join(f"w{i}" for i in range(300))
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup(twice).collect()] == [0, 0]
    assert [r["n_removed"] for r in suffix_dedup(twice).collect()] == [0, 0]


def test_odd_rows_exact(odd):
    got = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, -99 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["kept"])
        for r in exact_dedup(odd).collect()
    )
    assert got[:2] == [(False, -5, -5, 1, True), (False, 1, 1, 4, False)]
    assert got[2:5] == [(False, 1, 1, 4, True), (False, 2, 2, 2, True), (False, 3, 1, 4, False)]
    assert sum(g[4] for g in got) == 4
    kept = keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == 4


def test_odd_rows_simhash(odd):
    got = simhash_dedup(odd).collect()
    assert len(got) == 8
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 3)} == {1}
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-5, 1, 2]


def test_rows_that_share_an_id_count_apart(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(200))
    # Row c shares its id with the first of another component, but is not the first of its own.
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (3, text("d"))]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["text"][0]) for r in kept.collect())
    assert got == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
