"""Collocations and the alignment of tokenizers next to plain versions."""

import copy
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import alignment, collocations
from tests.llm import brute

COLUMNS = ("phrase", "a", "l", "r", "n", "score")


def _mined(df, **how):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, **how).collect()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    vocab = ["New", "york", "city", "of", "the", "rÃ©sumé", "x\x00y", "é", "a-b", "Z"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocab[: 3 + i % 8]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", "!"]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text if i % 50 else None))
    rows += [("en", "same long sentence stands here often enough " * 40), ("en", "word " * 500), ("fr", "rare"), (None, "")]
    return rows + rows[:5]


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 7)])
def test_collocations_equal_brute_force(spark, spoken, least, top):
    df = spark.createDataFrame(spoken, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(3)
    want = brute.collocations(spoken, least, top=top)
    assert len(want) > 20
    assert _mined(df, least=least, top=top) == want
    assert _mined(df, least=least, top=top, chunk_bytes=600) == want  # many chunks, long texts in parts


def test_rows_of_a_chunk_are_cut_between_pieces():
    ids = np.array([1, 2, -1, 3, 4, 5, 6, -1, 7, -1, 8], np.int32)
    assert [p.tolist() for p in collocations._cut(ids, 3)] == [[1, 2, -1, 3, 4, 5, 6], [7, -1, 8]]
    assert [p.tolist() for p in collocations._cut(ids[:2], 1)] == [[1, 2]]
    assert [p.tolist() for p in collocations._cut(ids[:0], 1)] == [[]]


def test_words_are_told_apart(monkeypatch):
    """Equal n-gram fingerprints and equal word fingerprints: counts and numbers still go by text."""
    def spelled(found):
        return [found.words[i] if i >= 0 else None for i in found.ids.tolist()]

    want = [b"b", b"a", None, b"a", b"b", None, b"a", b"b"]
    assert spelled(collocations.numbered([b"b a. a b", b"a b"], ["en", "de"])) == want
    assert spelled(collocations.numbered([b"b a. a b", b"a b"], ["en", "de"], seed=1)) == want
    rows = np.array([0, 1, 2, 1, 0, 1], np.int32)
    at, _, n = collocations._by_text(rows, np.arange(5), np.zeros(5, np.uint64), 2)
    assert {tuple(rows[i : i + 2].tolist()): c for i, c in zip(at, n.tolist(), strict=True)} == {
        (0, 1): 2, (1, 2): 1, (2, 1): 1, (1, 0): 1,
    }
    monkeypatch.setattr(collocations.rolling, "mixed", lambda x, seed=0: x & np.uint64(0))
    assert spelled(collocations.numbered([b"b a. a b"], ["en"])) == want[:5]


def test_words_that_polynomials_name_alike_are_named_anew(spark):
    """A Thue-Morse word and its mirror have one fingerprint modulo 2 ** 64 in any base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [("en", f"x {a} y. x {b} z. {a}")] * 4
    first, second = (collocations.numbered([w.encode()], ["en"]).fps.tolist() for w in (a, b))
    assert first == second
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute.collocations(rows, 4)
    assert len(want) == 2 and _mined(df, least=4) == want


@pytest.mark.parametrize("bits", [64, 6])
def test_collocations_without_broadcast_and_with_collisions(spark, spoken, monkeypatch, bits):
    df = spark.createDataFrame(spoken, "lang string, text string")
    want = brute.collocations(spoken, 9)
    assert _mined(df, least=9, chunk_bytes=900, bits=bits) == want
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 3)
    assert _mined(df, least=9, chunk_bytes=900, bits=bits) == want


def test_counts_are_packed_for_the_shuffle(spark):
    """Sums over chunks, each with a chunk that holds it, in fewer than ten bytes a fingerprint (rows took some twenty)."""
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 64, 1 << 16, np.uint64)
    held = [np.unique(rng.choice(fps, 40000)) for _ in range(6)]
    batches = [b for i, x in enumerate(held) for b in collocations._counts(i, np.concatenate((x, x[:50])))]
    packs = list(collocations._packed(5)(batches))
    want, n = np.unique(np.concatenate([np.concatenate((x, x[:50])) for x in held]), return_counts=True)
    assert sum(len(d.as_py()) for p in packs for d in p.column("data")) < 10 * len(want)
    assert len({r for p in packs for r in p.column("range").to_pylist()}) == 5
    df = spark.createDataFrame([r for p in packs for r in p.to_pylist()] * 2, collocations.PACKS)
    got = {r["fp"] % (1 << 64): (r["n"], r["pointer"]) for r in collocations._frequent(df, 6).collect()}
    assert {f: c for f, (c, _) in got.items()} == {f: 2 * c for f, c in zip(want.tolist(), n.tolist(), strict=True) if c >= 3}
    assert all(np.uint64(f) in held[chunk] for f, (_, chunk) in list(got.items())[:300])


@pytest.mark.parametrize("told", [collocations.BROADCAST_ROWS, 3])
def test_text_of_words_travels_only_where_they_are_frequent(spark, monkeypatch, told):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", told)
    rows = [("en", f"often here rare{i}") for i in range(40)]
    words, _, all_words = collocations.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), least=20)
    assert sorted(r["phrase"] for r in words.collect()) == ["here", "often"]
    assert [tuple(r) for r in all_words.collect()] == [("en", 120)]
    each = spark.range(100).select(F.col("id").alias("fp"))
    few = spark.range(7).select(F.col("id").alias("fp"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = collocations._among(each, few)
        assert left.count() == 7 and ("BroadcastHashJoin" in left._jdf.queryExecution().toString()) == (told > 7)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("bits", [9, 12])
def test_rare_phrases_that_share_a_fingerprint_with_frequent_ones(spark, spoken, bits):
    """A longer phrase that is rare with all it collides with takes nothing off a pair, nor a pair off a longer phrase."""
    df = spark.createDataFrame(spoken, "lang string, text string")
    assert _mined(df, least=30, chunk_bytes=900, bits=bits) == brute.collocations(spoken, 30)


def test_what_is_shuffled_grows_no_faster_than_the_texts(spark, monkeypatch):
    """Words that become frequent with more texts do not change what is counted of pairs; each text of a word is written once."""
    sent = []
    of_packs = collocations._frequent
    monkeypatch.setattr(collocations, "_frequent", lambda packs, least: sent.append(packs) or of_packs(packs, least))
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [("en", " ".join(rng.choices(vocab, range(1, 401), k=300))) for _ in range(80)]
    for part in (rows[:10], rows):
        df = spark.createDataFrame(part, "lang string, text string").coalesce(1)
        words, _, _ = collocations.phrase_counts(df, least=20, chunk_bytes=3000)
        assert words.count() == words.select("phrase").distinct().count() > 0
    counted = [p.agg(F.sum("size").alias("n"), F.sum(F.length("data")).alias("bytes")).first() for p in sent]
    (_, few, _), (_, many, _) = counted[:3], counted[3:]
    assert few["n"] > 2900  # nearly all of 2990 pairs differ, whether their words are frequent or not
    assert many["n"] < 8.1 * few["n"] and many["bytes"] < 9 * few["bytes"] and many["bytes"] < 5 * many["n"]


def test_collocations_of_odd_tables(spark, empty, odd):
    assert collocations.collocations(empty).collect() == []
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert _mined(odd, least=3) == brute.collocations(rows, 3)


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.read_files(alignment.default_folder()))


TEXTS = [
    "\x00ab c", "<s> x</s><unk>", "a▁b", " ▁ a", "  lead", "trail  ", "a\tb\nc", " ", "<0x0A> q", "é́ ﬁ", " x　y​", "a   b    c d",
    "<|endoftext|> z", "👍🏽 q", "� �", "don't can't 've", "x\x1c y \x85z", "\r\n \r", "antidisestablishmentarianism 中文字符 русский",
]


def test_shared_cuts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        a = np.unique(np.append(rng.integers(1, 5 * n, n), 5 * n))
        b = np.unique(np.append(rng.integers(1, 5 * n, n), 5 * n))
        assert a[alignment.shared_cuts(a, b)].tolist() == np.intersect1d(a, b).tolist()
    assert alignment.shared_cuts(np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []


@pytest.mark.parametrize("rows_told", [alignment.BROADCAST_ROWS, 10])
def test_alignment_equals_brute_force(spark, corpus, tokenizers, monkeypatch, rows_told):
    """Units put together equal whole texts encoded at once, counts are those of the whole table."""
    rows = [(i, t) for i, t in corpus if len(t or "") < 3000][:150] + [(2000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(3000, " ".join(TEXTS) * 3), (3001, None), (3002, "")]
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", rows_told)
    want = brute.aligned(rows, tokenizers)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit(1)).repartition(3)
    for size in (alignment.CHUNK_BYTES, 3000):
        got = alignment.align_tokenizers(df, chunk_bytes=size).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert want[2002][0] == 0 and want[2000][0] > 0


def test_alignment_of_odd_tables(spark, odd, empty, tokenizers):
    assert alignment.align_tokenizers(empty).collect() == []
    rows = [(i, r["text"]) for i, r in enumerate(odd.collect())]
    want = brute.aligned(rows, tokenizers)
    got = [tuple(r)[1:] for r in alignment.align_tokenizers(odd).collect()]
    assert sorted(got) == sorted(want.values())
    broken = spark.range(1).select(F.lit(7).alias("doc_id"), F.unhex(F.lit("61FF62")).cast("string").alias("text"))
    assert [tuple(r) for r in alignment.align_tokenizers(broken).collect()] == [(7, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_text_of_several_chunks(spark, corpus, tokenizers):
    text = max((t for _, t in corpus if t), key=len) * 4
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    got = alignment.align_tokenizers(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), chunk_bytes=2000)
    row = got.where("doc_id = 1").first()
    assert (row["n_a"], row["n_b"]) == (len(a), len(tokenizers.b.encode(text)))


def test_units_are_encoded_some_at_a_time(tokenizers):
    """The same tokens as one by one, with fewer texts to encode; odd units send no others on their own."""

    class Counting:
        texts = 0

        def encode(self, texts, **how):
            self.texts += len(texts)
            return tokenizers.b.encode(texts, **how)

    plain = [f"w{i}é" for i in range(3200)]
    spy = copy.copy(tokenizers)
    spy.b = Counting()
    for odd in ([], [u for t in TEXTS for u in alignment.CUT.split(t)]):
        units = list(dict.fromkeys(plain[:1600] + odd + plain[1600:]))
        spy.b.texts = 0
        got = alignment.encoded(units, spy)
        assert spy.b.texts < 400
        each = [alignment.encoded([u], tokenizers) for u in units]
        assert [x.tolist() for x in got] == [np.concatenate(x).tolist() for x in zip(*each, strict=True)]
        assert got[3].all() == (not odd)
