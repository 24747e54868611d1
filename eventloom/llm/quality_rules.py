"""Rule-based quality filter whose cutoffs carry a guarantee.

Each rule rejects documents whose rate exceeds a cutoff. Rates are whole numbers per thousand.
On labelled documents, a cutoff is certified for a stratum (a band of document lengths) if the
exact binomial bound shows that it rejects less than its share of `RISK` of the good documents
of that stratum. The error probability `ERROR` is divided by the number of rules and strata;
cutoffs of one rule need no further share, as they are tested from lenient to strict and a
stricter one never rejects less. Of the certified cutoffs, the one with the best balance of bad
and good documents rejected is used; where none is certified, the rule rejects nothing.

Only DataFrame functions are used. Texts are read once, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, WORD, narrow, write_table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
BANDS = (100, 500, 2000)
RULES = ("symbols", "dup_lines", "repeats", "same_words", "capitals", "exclamations")
CUTOFFS = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
RISK = 0.02
ERROR = 0.05
# A wrongly rejected good document weighs as much as so many bad ones.
GOOD_WEIGHT = 20


def _let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, also when `use` refers to it inside a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column, each) -> Column:
    last = F.size(words) - WINDOW
    return F.transform(F.sequence(F.lit(0), last), lambda i: each(F.slice(words, i + 1, WINDOW), i))


def _covered(words: Column) -> Column:
    """Words in windows that occur twice or more, compared by content."""
    window = lambda w, i: F.struct(F.array_join(w, " ").alias("w"), i.alias("at"))

    def repeated(found: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(found, j)["w"] == x["w"], F.lit(False))
        return F.filter(
            F.transform(found, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["at"])),
            lambda at: at.isNotNull(),
        )

    places = F.sort_array(_let(F.sort_array(_windows(words, window)), repeated))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, at: F.struct(
            (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - at)).alias("n"), (at + WINDOW).alias("end")
        ),
        lambda s: s["n"],
    )


def _window_hashes(words: Column) -> Column:
    """A hash of each window of 8 words, made of those of its halves, quarters and words."""

    def doubled(step: int):
        return lambda h: F.zip_with(
            h, F.slice(h, step + 1, F.size(h) - step), lambda x, y: F.xxhash64(x, y)
        )

    singles = F.transform(words, lambda w: F.xxhash64(w))
    fours = _let(_let(singles, doubled(1)), doubled(2))
    return F.slice(_let(fours, doubled(4)), 1, F.size(words) - (WINDOW - 1))


def _repeat_words(words: Column) -> Column:
    # Equal windows have equal hashes; without equal hashes there is nothing to compare.
    doubtful = _let(_window_hashes(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < WINDOW, 0).when(doubtful, _covered(words)).otherwise(0)


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("bigint")


def measures(text: Column) -> Column:
    """Struct of the counts that the rules use."""
    words = _words(text)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    from_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    from_lines = _let(
        lines,
        lambda found: F.struct(
            F.size(found).cast("bigint").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    left = lambda kept: (F.length(text) - F.length(kept)).cast("bigint")
    return F.struct(
        from_words.alias("words"),
        from_lines.alias("lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        left(F.regexp_replace(text, f"[{SYMBOLS}]+", "")).alias("n_symbols"),
        left(F.regexp_replace(text, "[A-Z]+", "")).alias("n_capitals"),
        left(F.regexp_replace(text, "!+", "")).alias("n_exclamations"),
    )


def judged(measured: DataFrame, measure: str = "m") -> DataFrame:
    """The measures as columns with the base verdict, the stratum and the rate of each rule."""
    m = F.col(measure)
    counts = {
        "n_words": m["words"]["n_words"], "n_distinct": m["words"]["n_distinct"],
        "n_repeat_words": m["words"]["n_repeat_words"], "n_lines": m["lines"]["n_lines"],
        "n_dup_lines": m["lines"]["n_dup_lines"], "word_chars": m["word_chars"], "n_symbols": m["n_symbols"],
        "n_capitals": m["n_capitals"], "n_exclamations": m["n_exclamations"],
    }
    n = counts["n_words"]
    band = sum((n >= limit).cast("int") for limit in BANDS)
    rates = {
        "symbols": _per_mille(counts["n_symbols"], counts["word_chars"]),
        "dup_lines": _per_mille(counts["n_dup_lines"], counts["n_lines"]),
        "repeats": _per_mille(counts["n_repeat_words"], n),
        "same_words": _per_mille(n - counts["n_distinct"], n),
        "capitals": _per_mille(counts["n_capitals"], counts["word_chars"]),
        "exclamations": _per_mille(counts["n_exclamations"], n),
    }
    failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    return measured.withColumns(
        counts
        | {
            "base_failed": failed,
            "band": band,
            "rates": F.array(
                *(F.struct(F.lit(r).alias("rule"), rates[r].alias("rate")) for r in RULES)
            ),
        }
    )


def _at_most(k: Column, n: Column, p: float) -> Column:
    """Exact P(at most k of n) under the binomial with p, summed from logarithms of its terms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct(
        (s["log"] + F.log((n - i) / (i + 1.0)) + odds).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")
    )
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), start, step, lambda s: s["sum"])


def cutoffs(judged_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, cuts): per stratum a map from rule to certified cutoff. At most one row per band.

    `labels` has doc_id and quality (1: good). Rows without either are ignored; of several
    labels of a document the highest counts, and repeated documents count once each.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.max("quality") >= 1).alias("good"))
    )
    held = (
        judged_docs.where("not base_failed")
        .select("doc_id", "band", "rates")
        .join(marks, "doc_id")
        .groupBy("band", "rates", "good")
        .agg(F.count("*").alias("n"))
    )
    cell = F.explode("rates").alias("r")
    grid = F.array(*(F.lit(c) for c in CUTOFFS))
    above = F.explode(F.filter(grid, lambda c: F.col("r.rate") > c)).alias("cutoff")
    hits = (
        held.select("band", "good", "n", cell)
        .select("band", "good", "n", F.col("r.rule").alias("rule"), above)
        .groupBy("band", "rule", "cutoff")
        .agg(
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("k"),
            F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("bad"),
        )
    )
    good = held.where("good").groupBy("band").agg(F.sum("n").alias("n"))
    share = RISK / len(RULES)
    level = ERROR / (len(RULES) * (len(BANDS) + 1))
    # At most one row per stratum.
    tested = hits.join(F.broadcast(good), "band").where(F.col("k") <= F.col("n") * share)
    worth = F.col("bad") - GOOD_WEIGHT * F.col("k")
    return (
        tested.where((_at_most(F.col("k"), F.col("n"), share) <= level) & (worth > 0))
        .groupBy("band", "rule")
        .agg(F.max_by("cutoff", F.struct(worth, "cutoff")).alias("cutoff"))
        .groupBy("band")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    )


def decided(judged_docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds `kept`."""
    # One row per stratum at most, so the broadcast side is bounded.
    joined = judged_docs.join(F.broadcast(cuts), "band", "left")
    over = F.exists(
        "rates", lambda r: F.coalesce(r["rate"] > F.try_element_at(F.col("cuts"), r["rule"]), F.lit(False))
    )
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its counts, base_failed and kept.

    A null or empty text has no words and fails the base rules. Null ids are judged like others
    but never labelled; repeated rows are judged each. Empty labels certify nothing, which
    leaves the base rules. Other columns are not read, and an empty table gives an empty result.
    """
    plain = narrow(docs, doc_id, text)
    measured = write_table(plain.select("doc_id", measures(F.col("text")).alias("m")), "measures")
    found = judged(measured)
    return decided(found, cutoffs(found, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are measured once for the cutoffs and once to judge them, which saves writing or
    shuffling them.
    """
    plain = narrow(docs, "doc_id", "text")
    measured = write_table(plain.select("doc_id", measures(F.col("text")).alias("m")), "measures")
    cuts = write_table(cutoffs(judged(measured), labels), "cutoffs")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    # Exploding an array of one keeps the planner from repeating the measures for each use of them.
    once = F.explode(F.array(measures(F.coalesce(F.col("text"), F.lit(""))))).alias("m")
    return decided(judged(docs.select(whole, once)), cuts).where("kept").select("doc.*")
