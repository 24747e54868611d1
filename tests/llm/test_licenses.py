"""Licence scans next to plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import license_scan as ls
from eventloom.llm.license_texts import PHRASES, TEMPLATES
from tests.llm import brute


@pytest.fixture(scope="module")
def scanner():
    return ls.Scanner(PHRASES, TEMPLATES)


def _scanned(scanner, text, **how):
    return ls.scan_text(scanner, text.encode(), **how)


def test_base_phrases_equal_brute_force(spark, docs, corpus):
    extra = [
        (5000, "CC-BY cc by, General Public\nLicense; all\x00rights reserved all rights reserved"), (5001, "cc éby cc by"),
        (5002, "general general public license public license"), (5003, "All rights  (reserved"), (5004, "all rights"),
        (5005, "cc cc by by " * 700), (5006, "GENERAL PUBLIC LICENSE, VERSION 2" * 3),
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = ls.scan_licenses(df, slice_bytes=500).collect()
    want = {i: brute.base_licenses(t, PHRASES) for i, t in corpus + extra}
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
    for r in got:
        base = set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(base | {s["label"] for s in r["spans"]}))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not base)


def test_matches_equal_brute_force():
    """Matching statistics over small alphabets, with sequences that share parts, and any slicing."""
    rng = random.Random(1)
    for _ in range(60):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        scanner = ls.Scanner({}, {str(i): [t] for i, t in enumerate(texts)}, long=1)
        sequences = [t.split() for t in texts]
        text = " ".join(rng.choice("aabbccx") for _ in range(60))
        for limit in (1 << 20, 7):
            ids = [[scanner.automaton.ids.get(w.encode(), -1) for w in part.decode().split()] for part in ls._sliced(text.encode(), limit)]
            n, _, found = scanner.stream(ls.np.array(part, ls.np.int32) for part in ids)
            assert n == 60
            assert [(end, size) for end, size, _ in found] == brute.maximal_matches(text.split(), sequences, 1)
            for end, size, state in found:
                run = text.split()[end - size + 1 : end + 1]
                places = {(k, j) for k, s in enumerate(sequences) for j in range(len(s)) if s[j - size + 1 : j + 1] == run and j >= size - 1}
                assert set(scanner.automaton.places[state]) == places


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_templates_are_found_whole_and_edited(scanner, label):
    rng = random.Random(label)
    filler = "some other prose stands around the notice "
    for text in TEMPLATES[label]:
        row = _scanned(scanner, filler + text + " " + filler)
        span = next(s for s in row["spans"] if s["label"] == label and s["share"] == 1)
        assert span["first"] == 7 and span["last"] == 6 + len(ls.words_of(text))
        words = text.split()
        if len(words) > 60:
            for i in rng.sample(range(len(words)), 3):
                words[i] = "changed"
            row = _scanned(scanner, filler + " ".join(words))
            assert label in row["labels"].split(",")
            assert label not in _scanned(scanner, " ".join(words[: len(words) // 2]))["labels"].split(",")


def test_labels_of_notices_and_clean_texts(scanner):
    def labels(text):
        return _scanned(scanner, text)["labels"]

    assert labels("Released under the MIT License.") == "mit"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache-2.0"
    assert labels("All rights reserved.") == "reserved"
    assert labels("released without the express license of the software version") == ""
    assert _scanned(scanner, "released without any license")["score"] == 0
    twice = _scanned(scanner, "x Released under the MIT License. " * 3)
    assert [(s["first"], s["last"]) for s in twice["spans"]] == [(1, 5), (7, 11), (13, 17)]


def test_a_licence_across_slices_of_a_long_text(scanner):
    text = "word " * 5000 + TEMPLATES["mit"][0] + " word" * 5000
    assert _scanned(scanner, text, slice_bytes=300) == _scanned(scanner, text)
    assert _scanned(scanner, text)["labels"] == "mit"


def test_odd_tables(spark, odd, empty):
    assert ls.scan_licenses(empty).collect() == []
    got = ls.scan_licenses(odd.withColumn("score", F.lit("x"))).collect()
    want = [(r["doc_id"], *brute.base_licenses(r["text"], PHRASES)) for r in odd.collect()]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    assert all(r["score"] == 0 for r in got if r["n_words"] == 0)
