"""Licence scans with a generalised suffix automaton over the words of licence texts.

The automaton accepts every run of words of any template. A text streamed through it yields, word by word, the
longest run that ends there and stands in a template. Where such a run can't be made longer it is a
match; long matches are chained in the order of text and template, and a template is found where a chain
covers enough of its words. The phrases that always count are templates of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_limits
from eventloom.llm.license_texts import PHRASES, TEMPLATES

LONG = 5
GAP = 20
SHARE = 0.8
SLICE_BYTES = 1 << 20

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")

SCANNED = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, share: double>>"
)


def words_of(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().translate(LOWER))


class Automaton:
    """Generalised suffix automaton over sequences of words."""

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.sequences = [[self.ids.setdefault(w, len(self.ids)) for w in s] for s in sequences]
        for sequence in self.sequences:
            state = 0
            for word in sequence:
                state = self._extend(state, word)
        self.places = self._places()

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the runs of `state` followed by the word, apart from longer runs with the same target."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence has this run
            return self._split(last, word, self.next[last][word])
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def _places(self) -> list[list[tuple[int, int]]]:
        """For each state, (sequence, place of its last word) of its runs; the templates alone bound their number."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for k, sequence in enumerate(self.sequences):
            state = 0
            for at, word in enumerate(sequence):
                state = self.next[state][word]
                ending = state
                while ending > 0:
                    found[ending].append((k, at))
                    ending = self.link[ending]
        return found


class Scanner:
    """The automaton of all templates, and what its states mean."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, Iterable[str]], long: int = LONG):
        texts = [(label, words_of(text)) for label, own in templates.items() for text in own]
        base = [(label, words_of(phrase)) for phrase, label in phrases.items()]
        both = [x for x in base + texts if x[1]]
        self.labels = [label for label, _ in both]
        self.sizes = [len(words) for _, words in both]
        self.n_base = len([x for x in base if x[1]])
        self.automaton = Automaton(words for _, words in both)
        self.least = [min(long, n) for n in self.sizes]
        self.shortest = min(self.least[self.n_base :], default=long)
        self.ending = self._ending()

    def _ending(self) -> list[list[tuple[int, int]]]:
        """Of each state, (phrase, its words) of the phrases that end its runs, where these are long enough."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for k, sequence in enumerate(self.automaton.sequences[: self.n_base]):
            state = 0
            for word in sequence:
                state = self.automaton.next[state][word]
            found[state].append((k, self.sizes[k]))
        for state in sorted(range(1, len(found)), key=self.automaton.length.__getitem__):
            found[state] += found[self.automaton.link[state]]
        return found

    def stream(self, ids: Iterator[np.ndarray]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """(number of words, (start, phrase) of all phrases, (end, length, state) of matches) of a text in slices."""
        following, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        ending, shortest = self.ending, self.shortest
        phrases, matches = [], []
        done = state = size = 0
        for part in ids:
            known = np.flatnonzero(part >= 0)
            before = done - 1  # the last word seen
            for at, word in zip((known + done).tolist(), part[known].tolist(), strict=True):
                if at != before + 1 and size:
                    if size >= shortest:
                        matches.append((before, size, state))
                    state = size = 0
                if word not in following[state]:
                    if size >= shortest:
                        matches.append((before, size, state))
                    while state and word not in following[state]:
                        state = link[state]
                        size = length[state]
                state = following[state].get(word, 0)
                size = size + 1 if state else 0
                before = at
                if ending[state]:
                    phrases += [(at - n + 1, k) for k, n in ending[state] if n <= size]
            done += len(part)
            if size and before != done - 1:
                if size >= shortest:
                    matches.append((before, size, state))
                state = size = 0
        if size >= shortest:
            matches.append((done - 1, size, state))
        return done, phrases, matches

    def chains(self, matches: list[tuple[int, int, int]], gap: int = GAP) -> dict[int, list[tuple[int, int, int]]]:
        """Of each template, chains (words covered, first, last) that lead to each of its matches.

        Matches of a chain follow each other in text and template, at most `gap` words apart in the text.
        """
        by_template = defaultdict(list)
        for end, size, state in matches:
            for k, at in self.automaton.places[state]:
                if k >= self.n_base and size >= self.least[k]:
                    by_template[k].append((end, size, at))
        found = {}
        for k, own in by_template.items():
            chains: list[tuple[int, int, int]] = []
            for i, (end, size, at) in enumerate(own):  # ends don't fall
                best, first, j = 0, end - size + 1, i - 1
                while j >= 0 and own[j][0] >= end - size - gap:
                    if own[j][0] <= end - size and own[j][2] <= at - size and chains[j][0] > best:
                        best, first = chains[j][0], chains[j][1]
                    j -= 1
                chains.append((best + size, first, end))
            found[k] = chains
        return found

    def judge(self, matches: list[tuple[int, int, int]], share: float = SHARE) -> tuple[float, list[dict]]:
        """(largest covered share of any template, spans that cover enough of one); spans of a template don't overlap."""
        top, spans = 0.0, []
        for k, chains in sorted(self.chains(matches).items()):
            n, free = self.sizes[k], -1
            top = max(top, max(c[0] for c in chains) / n)
            good = [c for c in chains if c[0] >= share * n]
            # By last word, the best of those that begin alike.
            best: dict[int, tuple[int, int, int]] = {}
            for c in good:
                if c[0] > best.get(c[1], (0,))[0]:
                    best[c[1]] = c
            for covered, first, last in sorted(best.values(), key=lambda c: (c[2], c[1])):
                if first > free:
                    spans.append({"label": self.labels[k], "first": first, "last": last, "share": covered / n})
                    free = last
        return top, spans


def _sliced(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in slices of about the limit, cut between words."""
    begin = 0
    while len(text) - begin > limit:
        cut = NO_WORD.search(text, begin + limit)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_SCANNED = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def scan_text(scanner: Scanner, text: bytes, share: float = SHARE, slice_bytes: int = SLICE_BYTES) -> dict:
    known = scanner.automaton.ids

    def numbers() -> Iterator[np.ndarray]:
        for part in _sliced(text.translate(LOWER), slice_bytes):
            words = WORDS.findall(part)
            yield np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))

    n_words, phrases, matches = scanner.stream(numbers())
    top, spans = scanner.judge(matches, share)
    starts = [at for at, _ in phrases]
    base = {scanner.labels[k] for _, k in phrases}
    return {
        "n_words": n_words, "n_base": len(starts), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s["label"] for s in spans})), "score": 1.0 if starts else top, "spans": spans,
    }


def _scan(scanner: Scanner, share: float, slice_bytes: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"doc_id": doc_id, **scan_text(scanner, text.as_py(), share, slice_bytes)}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, _SCANNED)

    return run


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, Iterable[str]] = TEMPLATES, long: int = LONG, share: float = SHARE,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. n_base counts all places of
    `phrases`, first_word and last_word are their least and greatest start. A template is found where a chain of matches of
    at least `long` words (or of the whole template, if shorter), at most 20 words apart, covers `share` of its words; spans
    hold its label, first and last word and covered share. labels are those of phrases and templates,
    sorted, each once. score is the largest covered share of any template, 1 with any phrase.

    A null text has no words, no labels and score 0. Repeated rows and null ids are scanned like
    others, an empty table gives an empty result, other columns are not read. No shuffle. A very long text streams
    through in slices; its matches are kept until its end.
    """
    arrow_limits(docs.sparkSession)
    scanner = Scanner(phrases, templates, long)
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInArrow(_scan(scanner, share, slice_bytes), SCANNED)
