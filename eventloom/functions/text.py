"""Tokens, search terms, matching and ranking of an event's weighted text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.fields import is_field

# Indexed fields with their weight classes A = 1.0, B = 0.4, C = 0.2.
FIELD_WEIGHTS = {"source": 1.0, "event_type": 1.0, "severity": 0.4, "data": 0.2}
BREAK = "[^a-z0-9_-]+"
OPERATORS = {"AND": "AND", "&": "AND", "OR": "OR", "|": "OR", "NOT": "NOT", "!": "NOT"}

# A token runs to a blank or to the end of the quoted part it contains.
_TOKEN = re.compile(r"""[^ \t"']*(?:"[^"]*"?|'[^']*'?)|[^ \t"']+""")


class Term(NamedTuple):
    word: str
    negated: bool = False


class SearchText(NamedTuple):
    """Field filters, and alternatives of terms that must all hold."""

    filters: dict[str, str]
    alternatives: list[list[Term]]

    @property
    def words(self) -> list[str]:
        """Distinct words that may add to the rank."""
        wanted = [t.word for terms in self.alternatives for t in terms if not t.negated]
        return list(dict.fromkeys(wanted))


def clean_word(text: str) -> str:
    """Letters, digits, `_` and `-` in lower case; `unknown` if nothing is left."""
    return re.sub(r"[^A-Za-z0-9_-]", "", text).lower() or "unknown"


def read_search(text: str | None) -> SearchText:
    """Search box text to filters and terms.

    `field:value` on a known field filters, the last value per field winning. Remaining
    words are alternatives split at OR; neighbours must all match; NOT negates a word.
    Operators that lack a word are dropped.
    """
    filters: dict[str, str] = {}
    alternatives: list[list[Term]] = [[]]
    negate = False
    for token in _TOKEN.findall(text or ""):
        name, colon, value = token.partition(":")
        if colon and name and value and is_field(name.lower()):
            filters[name.lower()] = value.strip("\"'")
            continue
        for word in token.split():
            operator = OPERATORS.get(word.upper())
            if operator == "OR":
                alternatives.append([])
            elif operator == "NOT":
                negate = True
            elif operator is None and word.strip("\"'"):
                alternatives[-1].append(Term(clean_word(word), negate))
                negate = False
    return SearchText(filters, [terms for terms in alternatives if terms])


def tokens(column: Column) -> Column:
    return F.array_remove(F.split(F.lower(column), BREAK), "")


def _present(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def has_word(word: str) -> Column:
    """Whether any indexed field holds the word.

    A substring test runs first, so that most rows never reach the boundary pattern.
    """
    text = F.lower(F.concat_ws(" ", *FIELD_WEIGHTS))
    bounded = f"(?:^|[^a-z0-9_-]){re.escape(word)}(?:$|[^a-z0-9_-])"
    return F.contains(text, F.lit(word)) & text.rlike(bounded)


def matches(alternatives: Sequence[Sequence[Term]]) -> Column:
    """OR over alternatives, AND over their terms."""

    def holds(term: Term) -> Column:
        return ~has_word(term.word) if term.negated else has_word(term.word)

    either = [reduce(Column.__and__, [holds(t) for t in terms]) for terms in alternatives]
    return reduce(Column.__or__, either)


def has_phrase(words: Sequence[str]) -> Column:
    """Whether some field holds the words next to each other, in order."""
    wanted = F.lit(" " + " ".join(clean_word(w) for w in words) + " ")

    def spaced(name: str) -> Column:
        return F.concat(F.lit(" "), F.regexp_replace(F.lower(_present(name)), BREAK, " "), F.lit(" "))

    return reduce(Column.__or__, [F.contains(spaced(name), wanted) for name in FIELD_WEIGHTS])


def field_tokens() -> list[tuple[Column, float]]:
    return [(tokens(_present(name)), weight) for name, weight in FIELD_WEIGHTS.items()]


def document() -> Column:
    """Array of {pos, term, weight} over all indexed fields, positions running on."""

    def weighted(found: Column, weight: float) -> Column:
        return F.transform(
            found, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))
        )

    joined = F.concat(*(weighted(found, weight) for found, weight in field_tokens()))
    return F.transform(
        joined,
        lambda d, i: F.struct(i.alias("pos"), d["term"].alias("term"), d["weight"].alias("weight")),
    )


def hits(words: Sequence[str]) -> Column:
    return F.filter(document(), lambda d: d["term"].isin(*words))


def frequency_rank(words: Sequence[str], found: Column | None = None) -> Column:
    """Sum of the weights of all occurrences of the words."""
    found = hits(words) if found is None else found
    return F.aggregate(found, F.lit(0.0), lambda total, h: total + h["weight"])


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cover_density_rank(
    alternatives: Sequence[Sequence[Term]], found: Column | None = None
) -> Column:
    """Sum over minimal spans that hold every word of some alternative.

    A span with n hits scores n / sum(1 / weight), divided by one plus the words between
    its hits. For a single word that is the sum of its weights. `found` are the hits of
    the words that are not negated, by position; without it the event's text is read.
    """
    groups = [[t.word for t in terms if not t.negated] for terms in alternatives]
    groups = [list(dict.fromkeys(g)) for g in groups if g]
    if not groups:
        return F.lit(0.0)
    if all(len(g) == 1 for g in groups):
        return frequency_rank([g[0] for g in groups], found)
    words = list(dict.fromkeys(w for g in groups for w in g))
    # Per word, where it was seen last and what had been passed before it.
    unseen = F.struct(
        F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.lit(0.0).cast("double").alias("inverse")
    )
    begin = F.struct(
        F.array_repeat(unseen, len(words)).alias("last"),
        F.lit(0).alias("n"),
        F.lit(0.0).cast("double").alias("inverse"),
        F.lit(-1).alias("edge"),
        F.lit(0.0).cast("double").alias("score"),
    )

    def span_start(last: Column) -> Column:
        starts = [[F.element_at(last, words.index(w) + 1) for w in g] for g in groups]
        earliest = [F.least(*s) if len(s) > 1 else s[0] for s in starts]
        return F.greatest(*earliest) if len(earliest) > 1 else earliest[0]

    def step(state: Column, hit: Column) -> Column:
        here = F.struct(
            hit["pos"].alias("pos"), state["n"].alias("n"), state["inverse"].alias("inverse")
        )
        last = F.array(
            *(
                F.when(hit["term"] == w, here).otherwise(F.element_at(state["last"], i + 1))
                for i, w in enumerate(words)
            )
        )
        passed = state["n"] + 1
        inverse = state["inverse"] + 1 / hit["weight"]

        def with_last(last: Column) -> Column:
            def with_start(start: Column) -> Column:
                inside = passed - start["n"]
                between = hit["pos"] - start["pos"] - (inside - 1)
                gain = inside / (inverse - start["inverse"]) / (1 + between)
                new = start["pos"] > state["edge"]
                return F.struct(
                    last.alias("last"),
                    passed.alias("n"),
                    inverse.alias("inverse"),
                    F.when(new, start["pos"]).otherwise(state["edge"]).alias("edge"),
                    F.when(new, state["score"] + gain).otherwise(state["score"]).alias("score"),
                )

            return _bind(span_start(last), with_start)

        return _bind(last, with_last)

    found = hits(words) if found is None else found
    return F.aggregate(found, begin, step, lambda state: state["score"])


# Patterns masked in log text, in this order.
MASKS = (
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\d+", "<num>"),
)


def log_template(column: Column) -> Column:
    """Text with addresses, hex numbers and numbers masked."""
    return reduce(lambda text, mask: F.regexp_replace(text, *mask), MASKS, column)


# Common English words that carry no meaning of their own.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been being
    have has had having do does did doing a an the and but if or because as until while of at by for with about against
    between into through during before after above below to from up down in out on off over under again further then once
    here there when where why how all any both each few more most other some such no nor not only own same so than too very
    s t can will just don should now""".split()
)

# What stands in front of an ending, for Porter's conditions: with consonants C and vowels V, a word has the form
# [C](VC)^m[V]. A y after a vowel or at the beginning is a consonant, written Y here.
_C, _V = "[^aeiouy]", "[aeiouy]"
_ANY = ".*"
_VOWEL = f".*{_V}.*"
_M1 = f"{_C}*{_V}+{_C}.*"
_M2 = f"{_C}*{_V}+{_C}+{_V}+{_C}.*"
# The same if the ending itself begins with the last consonant.
_M2_HERE = f"{_C}*{_V}+{_C}+{_V}+(?:{_C}.*)?"
# m = 1 and ending in consonant, vowel, consonant, the last not w, x or y; and all others with m = 1.
_SHORT = f"{_C}+{_V}[^aeiouywxY]"
_NOT_SHORT = f"{_C}*{_V}+{_C}{_C}+|{_C}*{_V}{_V}+{_C}|{_V}+{_C}|{_C}*{_V}+[wxY]|{_C}*{_V}+{_C}+{_V}+"


class Ending(NamedTuple):
    """An ending, what must stand in front of it, and what takes its place."""

    ending: str
    front: str
    instead: str = ""

    @property
    def found(self) -> str:
        return f"^.*{self.ending}$"

    @property
    def whole(self) -> str:
        return f"^({self.front}){self.ending}$"


def _endings(front: str, pairs: str) -> list[Ending]:
    return [Ending(ending, front, instead) for ending, _, instead in (p.partition(">") for p in pairs.split())]


# The steps of Porter's algorithm. Of each step the first ending that the word has decides, whether or not its
# condition holds. A plus marks words that lost -ed or -ing until the step after the next.
STEPS: list[list[Ending]] = [
    _endings(_ANY, "sses>ss ies>i ss>ss s>"),
    [Ending("eed", _M1, "ee"), Ending("ed", _VOWEL, "+"), Ending("ing", _VOWEL, "+")],
    [
        *_endings(_ANY, r"at\+>ate bl\+>ble iz\+>ize"),
        *(Ending(rf"{c}{c}\+", _ANY, c) for c in "bcdfghjkmnpqrtvwx"),
        Ending(r"\+", _SHORT, "e"),
    ],
    _endings(_ANY, r"\+>"),
    [Ending("[yY]", _VOWEL, "i")],
    _endings(
        _M1,
        """ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize
        ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble""",
    ),
    _endings(_M1, "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"),
    [
        *_endings(_M2, "al> ance> ence> er> ic> able> ible> ant> ement> ment> ent>"),
        Ending("sion", _M2_HERE, "s"), Ending("tion", _M2_HERE, "t"),
        *_endings(_M2, "ou> ism> ate> iti> ous> ive> ize>"),
    ],
    [Ending("e", f"{_M2}|{_NOT_SHORT}")],
    [Ending("ll", _M2_HERE, "l")],
]
STEMMED = "^[a-z]{3,}$"
CONSONANT_Y = "(^|[aeiou])y"


def stem(word: Column) -> Column:
    """Porter's stem of a lower-case word; words with digits or signs and those of two letters stay as they are."""

    def taken(step: list[Ending]) -> Callable[[Column], Column]:
        def body(w: Column) -> Column:
            out = w
            for e in reversed(step):
                out = F.when(w.rlike(e.found), F.regexp_replace(w, e.whole, f"$1{e.instead}")).otherwise(out)
            return out

        return body

    out = F.regexp_replace(word, CONSONANT_Y, "$1Y")
    for step in STEPS:
        out = _bind(out, taken(step))
    return F.when(word.rlike(STEMMED), F.lower(out)).otherwise(word)


def stem_word(word: str) -> str:
    if not re.match(STEMMED, word):
        return word
    out = re.sub(CONSONANT_Y, r"\g<1>Y", word)
    for step in STEPS:
        decides = next((e for e in step if re.match(e.found, out)), None)
        if decides:
            out = re.sub(decides.whole, rf"\g<1>{decides.instead}", out)
    return out.lower()


def english_document() -> Column:
    """`document()` in stems: stop words are left out and keep their positions."""
    spoken = F.filter(document(), lambda d: ~d["term"].isin(*STOP_WORDS))
    return F.transform(
        spoken, lambda d: F.struct(d["pos"].alias("pos"), stem(d["term"]).alias("term"), d["weight"].alias("weight"))
    )


def english_terms(alternatives: Sequence[Sequence[Term]]) -> list[list[Term]]:
    """The alternatives in stems, without stop words and without alternatives of nothing else."""
    groups = [[Term(stem_word(t.word), t.negated) for t in terms if t.word not in STOP_WORDS] for terms in alternatives]
    return [g for g in groups if g]


def holds_terms(alternatives: Sequence[Sequence[Term]], found: Column) -> Column:
    """`matches` over an array of {term, ...} instead of the text: OR over alternatives, AND over their terms."""

    def holds(term: Term) -> Column:
        here = F.exists(found, lambda d: d["term"] == term.word)
        return ~here if term.negated else here

    either = [reduce(Column.__and__, [holds(t) for t in terms]) for terms in alternatives]
    return reduce(Column.__or__, either) if either else F.lit(False)


def analyze(column: Column, analyzer: str = "standard", stop_words: Sequence[str] = ()) -> Column:
    """Terms of a text: `standard` and `letters` lower-case, `whitespace` keeps words as is,
    `stop` is `standard` without the given words, `english` the stems without stop words."""
    if analyzer == "english":
        words = stop_words or STOP_WORDS
        return F.transform(F.filter(tokens(column), lambda t: ~t.isin(*words)), stem)
    if analyzer == "whitespace":
        return F.array_remove(F.split(column, r"\s+"), "")
    if analyzer == "letters":
        return F.array_remove(F.split(F.lower(column), "[^a-z]+"), "")
    if analyzer == "stop":
        return F.filter(tokens(column), lambda t: ~t.isin(*stop_words))
    if analyzer == "standard":
        return tokens(column)
    raise ValueError(f"unknown analyzer: {analyzer}")
