import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import search, specs, vector
from eventloom.schemas import EVENT

NOW = dt.datetime(2024, 1, 2)


def plain(query):
    wanted = T.read_search(query)
    return wanted.filters, [
        [("!" if t.negated else "") + t.word for t in terms] for terms in wanted.alternatives
    ]


@pytest.mark.parametrize(
    ("query", "filters", "alternatives"),
    [
        ("", {}, []),
        (None, {}, []),
        ("source:payment-service error", {"source": "payment-service"}, [["error"]]),
        (
            "source:auth-service severity:error login failed",
            {"source": "auth-service", "severity": "error"},
            [["login", "failed"]],
        ),
        ("timeout OR refused", {}, [["timeout"], ["refused"]]),
        ('"connection refused" source:db', {"source": "db"}, [["connection", "refused"]]),
        ("unknown_field:value test", {}, [["unknown_fieldvalue", "test"]]),
        ('hello "world foo" bar', {}, [["hello", "world", "foo", "bar"]]),
        ('path:"/a b" x', {"path": "/a b"}, [["x"]]),
        ("source:a OR source:b", {"source": "b"}, []),
        ("a NOT b or c and d", {}, [["a", "!b"], ["c", "d"]]),
        ("AND OR NOT", {}, []),
        ("!!! x", {}, [["unknown", "x"]]),
        ("Type:click :x y:", {"type": "click"}, [["x", "y"]]),
    ],
)
def test_reading_search_text(query, filters, alternatives):
    assert plain(query) == (filters, alternatives)


def event_frame(spark, rows):
    base = [(str(i), s, k, v, d, '{"host":"h1"}', NOW) for i, (s, k, v, d) in enumerate(rows)]
    return spark.createDataFrame(
        base,
        "event_id string, source string, event_type string, severity string, data string, metadata string, timestamp timestamp",
    )


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_matching_is_by_whole_words_and_ignores_case(spark):
    ev = event_frame(
        spark,
        [
            ("db", "t", "error", '{"m":"Connection refused"}'),
            ("db", "t", "info", '{"m":"connections refused"}'),
            ("gateway", "t", "error", '{"m":"timeout-x"}'),
            ("gateway", "t", None, None),
        ],
    )
    assert ids(search.match_text(ev, "CONNECTION refused")) == ["0"]
    assert ids(search.match_text(ev, "timeout")) == []
    assert ids(search.match_text(ev, "timeout-x OR connections")) == ["1", "2"]
    assert ids(search.match_text(ev, "NOT refused")) == ["2", "3"]
    assert ids(search.match_text(ev, "host:h1 gateway NOT error")) == ["3"]
    assert ids(search.phrase_search(ev, "connection refused")) == ["0"]
    assert ids(search.phrase_search(ev, "refused connection")) == []


def cover_rank(words, groups, doc):
    """Brute force: all spans, keep minimal ones, score each."""
    hits = [(p, t, w) for p, t, w in doc if t in words]

    def holds(part):
        seen = {t for _, t, _ in part}
        return any(set(g) <= seen for g in groups)

    total = 0.0
    for i in range(len(hits)):
        for j in range(i, len(hits)):
            part = hits[i : j + 1]
            if holds(part) and not holds(part[1:]) and not holds(part[:-1]):
                gap = part[-1][0] - part[0][0] - (len(part) - 1)
                total += len(part) / sum(1 / w for _, _, w in part) / (1 + gap)
    return total


@pytest.mark.parametrize("query", ["aa bb", "aa bb cc", "aa OR bb", "aa bb OR cc", "aa NOT zz"])
def test_cover_density_against_brute_force(spark, query):
    import random

    rng = random.Random(3)
    rows = [
        (rng.choice(["aa", "x"]), rng.choice(["bb", "aa"]), rng.choice(["cc", "info"]),
         " ".join(rng.choice(["aa", "bb", "cc", "x", "y"]) for _ in range(rng.randint(0, 25))))
        for _ in range(40)
    ]
    ev = event_frame(spark, rows)
    wanted = T.read_search(query).alternatives
    groups = [[t.word for t in terms if not t.negated] for terms in wanted]
    words = {w for g in groups for w in g}
    got = {r.event_id: r.rank for r in ev.select("event_id", T.cover_density_rank(wanted).alias("rank")).collect()}
    for i, (s, k, v, d) in enumerate(rows):
        fields = [(s, 1.0), (k, 1.0), (v, 0.4), (d, 0.2)]
        flat = [(t, w) for text, w in fields for t in text.split()]
        doc = [(p, t, w) for p, (t, w) in enumerate(flat)]
        assert got[str(i)] == pytest.approx(cover_rank(words, groups, doc)), rows[i]


def test_explicit_filters(spark):
    ev = event_frame(spark, [("a", "t", "info", "{}"), ("b", "t", "error", "{}")])
    found = search.search_events(ev, "source:a severity:error", as_of=NOW, source="b", severity="info")
    assert ids(found) == ["1"]


def test_ranked_pages_resume_without_gaps(spark):
    rows = [("s", "t", "error", " ".join(["error"] * (i % 3 + 1))) for i in range(12)]
    ev = event_frame(spark, rows)
    everything = search.search_page(ev, "error", as_of=NOW, limit=100).orderBy("position").collect()
    seen, after = [], None
    for _ in range(4):
        page = search.search_page(ev, "error", as_of=NOW, limit=3, after=after).orderBy("position").collect()
        seen += [r.event_id for r in page]
        after = (page[-1].rank, page[-1].timestamp, page[-1].event_id)
    assert seen == [r.event_id for r in everything]


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None), ("d", [-1.0, 0.0]), ("z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "event_id string, embedding array<float>")
    got = vector.vector_search(df, [2.0, 0.0], 3).collect()
    assert [r.event_id for r in got] == ["a", "b", "d"]
    assert [r.score for r in got] == pytest.approx([1.0, 0.6, -1.0])
    text = df.select(vector.vector_text(F.col("embedding")).alias("t")).first().t
    assert text == "[1.0,0.0]"
    back = spark.createDataFrame([("[1,2.5]",)], "t string").select(vector.text_vector(F.col("t")).alias("v"))
    assert back.first().v == [1.0, 2.5]


def test_fusion_and_its_degraded_forms(spark):
    words = spark.createDataFrame([("a", 9.0), ("b", 8.0)], "event_id string, score double")
    near = spark.createDataFrame([("b", 0.9), ("c", 0.8)], "event_id string, score double")
    got = vector.fuse(words, near, 5).collect()
    assert [r.event_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.event_id for r in vector.fuse(None, near, 5).collect()] == ["b", "c"]
    assert [r.event_id for r in vector.fuse(words, None, 1).collect()] == ["a"]
    with pytest.raises(ValueError):
        vector.fuse(None, None, 5)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"confidence": 0.85}', 0.85),
        ('"confidence" : 0.4 sure', 0.4),
        ("Confidence: .5", 0.5),
        ("confidence: 7", 0.7),
        ('{"confidence": 1.5}', 0.7),
        ("confidence: 3 of 10, so confidence: 0.2", 0.2),
        ("confidence: high", 0.7),
        ("none", 0.7),
        (None, 0.7),
    ],
)
def test_confidence(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(specs.confidence(F.col("t")).alias("c")).first().c == expected


def test_log_templates(spark):
    df = spark.createDataFrame([("to 10.0.0.12:5432 at 0xFFaa in 12ms",)], "t string")
    assert df.select(T.log_template(F.col("t")).alias("x")).first().x == "to <ip>:<num> at <hex> in <num>ms"


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        specs.run_spec(specs.Tables(None, None, None), {"type": "drop"}, as_of=NOW)
    with pytest.raises(ValueError):
        specs.run_tool(specs.Tables(None, None, None), "rm", as_of=NOW)


@pytest.mark.parametrize("query", ["error", "error timeout", "error OR downstream NOT svc-1", "limit NOT fatal"])
def test_stored_terms_find_what_a_scan_finds(spark, tmp_path, query):
    from eventloom.sources.canonical import events

    ev = events(spark, "/root/testdata/sf0.001")
    search.write_term_table(ev, str(tmp_path))
    terms = spark.read.parquet(str(tmp_path))
    got = search.match_indexed(terms, query)
    scanned = search.search_events(ev, query, as_of=NOW, start="2000-01-01")
    want = {r.event_id: pytest.approx(r.rank) for r in scanned.collect()}
    assert {r.event_id: r.rank for r in got.collect()} == want != {}
    assert "In(term" in got._jdf.queryExecution().toString() or "EqualTo(term" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("query", ["source:a", "NOT x", "a OR NOT b"])
def test_stored_terms_refuse_what_they_cannot_answer(spark, query):
    with pytest.raises(ValueError):
        search.match_indexed(None, query)


def test_unsupported_specs_raise(spark):
    counts = spark.createDataFrame([], "bucket timestamp, source string, event_type string, severity string, count long")
    tables = specs.Tables(spark.createDataFrame([], EVENT), counts, counts)
    analytic = {"type": "analytics", "group_by": "source"}
    for spec in (
        {"order_by": "data"}, {"limit": 5000}, {**analytic, "metric": "p99"}, {**analytic, "filters": {"method": "GET"}},
        {"type": "analytics", "group_by": "host"}, {**analytic, "order_by": "severity"}, {"type": "drop"},
    ):
        with pytest.raises(ValueError):
            specs.run_spec(tables, spec, as_of="2024-01-31")
    assert specs.run_spec(tables, {**analytic, "order_by": "count DESC"}, as_of="2024-01-31").count() == 0


# The examples of Porter's paper, rule by rule, each word with its stem after the whole algorithm.
PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate
cease ceas controll control roll roll""".split()


def test_stems_agree_with_the_published_examples_and_their_column_form(spark):
    words, stems = PORTER[::2], PORTER[1::2]
    assert [T.stem_word(w) for w in words] == stems
    words += ["connections", "refusing", "queries", "svc-3", "is", "a1s", "", "yes", "say", "saying", "employed", "toying", "é"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(T.stem(F.col("w")).alias("s")).collect()] == [T.stem_word(w) for w in words]
    assert T.stem_word("connections") == T.stem_word("connecting") == "connect" and T.stem_word("svc-3s") == "svc-3s"


def test_english_search_matches_and_ranks_by_stems(spark):
    rows = [("a", "waits for connections"), ("b", "waited, connecting"), ("c", "wait"), ("d", "the connection waiting and waiting")]
    ev = spark.createDataFrame([(i, "s", "t", "info", d, dt.datetime(2024, 1, 1)) for i, d in rows],
                               "event_id string, source string, event_type string, severity string, data string, timestamp timestamp")

    def found(query, **how):
        df = search.search_events(ev, query, as_of="2024-01-01 12:00:00", analyzer="english", **how)
        return {r["event_id"]: round(r["rank"], 4) for r in df.collect()}

    assert set(found("the wait connect")) == {"a", "b", "d"}
    assert found("waiting") == {"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.4}
    assert set(found("waits NOT connected")) == {"c"}
    assert found("the and of") == {}
    assert found("waiting", after=(0.4, "2024-01-01", "d")).keys() == {"a", "b", "c"}
    got = search.keyword_search(ev, "connected waits", 2, analyzer="english").collect()
    assert [(r["event_id"], round(r["score"], 4)) for r in got] == [("d", 0.6), ("a", 0.4)]
    assert search.keyword_search(ev, "the", 2, analyzer="english").collect() == []
    assert [r["event_id"] for r in search.hybrid_search(ev, None, "waited", None, 1, "english").collect()] == ["d"]
    with pytest.raises(ValueError):
        found_none = search.search_events(ev, "x", as_of="2024-01-01", analyzer="klingon")
        found_none.collect()


def test_a_later_ranked_page_works_its_rank_out_once(spark):
    ev = spark.createDataFrame([], "event_id string, source string, event_type string, severity string, data string, timestamp timestamp")
    found = search.search_events(ev, "connection refused", as_of="2024-01-01", after=(0.5, "2024-01-01", "a"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_indexed_phrases_equal_the_text_search(spark, tmp_path):
    texts = ["a b a b c", "a x b", "b a", "a b", "c a b, c", "A-b a.b", "", "a a a b b b", "b c a"]
    rows = [(f"e{i}", "b", "a", "c", t, dt.datetime(2024, 1, 1 + i % 3)) for i, t in enumerate(texts)]
    ev = spark.createDataFrame(rows, "event_id string, source string, event_type string, severity string, data string, timestamp timestamp")
    search.write_term_table(ev, str(tmp_path))
    terms = spark.read.parquet(str(tmp_path))
    for phrase in ("a b", "a b c", "a a", "b", "b a", "a b a b", "a-b", "nowhere", "a c"):
        got = {r["event_id"] for r in search.phrase_indexed(terms, phrase).collect()}
        assert got == {r["event_id"] for r in search.phrase_search(ev, phrase).collect()}, phrase
    with pytest.raises(ValueError):
        search.phrase_indexed(terms, "  ")


def test_ranked_pages_need_a_ranked_cursor(spark):
    from eventloom.functions.cursors import Cursor

    with pytest.raises(ValueError, match="cursor with a rank"):
        search.search_page(spark.range(0), "word", as_of="2024-01-01", cursor=Cursor("2024-01-01", "a"))
