"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of all texts are computed in the JVM, once. The model is fitted with numpy on a
bounded sample of labelled documents (`SAMPLE` rows); its trees are flattened into arrays, a few
kilobytes, and tasks score batches of documents by walking all rows down each tree at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, arrow_limits, narrow, write_table

SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAF = 10
RIDGE = 1.0

FEATURES = (
    "chars", "words", "word_length", "distinct", "lines", "dup_lines", "capitals", "digits",
    "full_stops", "commas", "exclamations", "bars", "signs", "other", "repeats",
)


def statistics(text: Column) -> Column:
    """Array of doubles in the order of `FEATURES`."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))
    lines = F.split(text, "\n")
    size = F.greatest(F.length(text), F.lit(1))
    count = lambda chars: F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))
    from_words = let(
        words,
        lambda w: F.array(
            F.size(w).cast("double"),
            F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)),
            # A word equal to the one before it.
            F.aggregate(
                F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: (a == b).cast("int")),
                F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)),
            ) / F.greatest(F.size(w), F.lit(1)),
        ),
    )
    from_lines = let(
        lines, lambda found: F.array(F.size(found).cast("double"), 1 - F.size(F.array_distinct(found)) / F.size(found))
    )
    shares = [
        count("A-Z"), count("0-9"), count("."), count(","), count("!"), count("|"), count("#*$%&<>"),
        F.octet_length(text) - F.length(text),
    ]
    shares = F.array(*((s / size).cast("double") for s in shares))
    chars = F.length(text).cast("double")
    return let(
        F.struct(from_words.alias("w"), from_lines.alias("l"), shares.alias("s"), chars.alias("c")),
        lambda x: F.concat(
            F.array(x["c"], x["w"][0], x["c"] / F.greatest(x["w"][0], F.lit(1.0)), x["w"][1], x["l"][0], x["l"][1]),
            x["s"],
            F.array(x["w"][2]),
        ),
    )


class Trees(NamedTuple):
    """All trees in one array per field; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int


def scores(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    total = np.full(len(x), model.base)
    rows = np.arange(len(x))
    for root in model.roots:
        at = np.full(len(x), root)
        for _ in range(model.depth):
            low = x[rows, model.feature[at]] <= model.threshold[at]
            at = np.where(low, model.left[at], model.right[at])
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def _best_split(binned: np.ndarray, own: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, last bin that goes left) over all histograms of a node."""
    best = (1e-6, -1, -1)
    total_g, total_h = g[own].sum(), h[own].sum()
    whole = total_g**2 / (total_h + RIDGE)
    for feature in range(binned.shape[1]):
        b = binned[own, feature]
        left_g = np.cumsum(np.bincount(b, g[own], BINS))[:-1]
        left_h = np.cumsum(np.bincount(b, h[own], BINS))[:-1]
        left_n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - whole
        gain[(left_n < LEAF) | (len(own) - left_n < LEAF)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), feature, at)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with logistic loss. One label alone, or no rows, give a constant model."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], 1)
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([])
            level = [(roots[-1], np.arange(len(y)))]
            for depth in range(DEPTH + 1):
                following = []
                for node, own in level:
                    gain, feature, last = _best_split(binned, own, g, h) if depth < DEPTH else (0, -1, -1)
                    if feature < 0 or last >= len(edges[feature]):
                        step = RATE * g[own].sum() / (h[own].sum() + RIDGE)
                        nodes[node] = [0, 0.0, node, node, step]
                        total[own] += step
                        continue
                    left, right = len(nodes), len(nodes) + 1
                    nodes += [[], []]
                    nodes[node] = [feature, edges[feature][last], left, right, 0.0]
                    low = binned[own, feature] <= last
                    following += [(left, own[low]), (right, own[~low])]
                level = following
    table = np.array(nodes, float).reshape(-1, 5)
    whole = lambda i: table[:, i].astype(np.int64)
    return Trees(np.array(roots, np.int64), whole(0), table[:, 1], whole(2), whole(3), table[:, 4], base, DEPTH)


def _training_rows(measured: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most `SAMPLE` labelled rows for learning, those with the least hashes of their id."""
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.max("quality") >= 1).cast("int").alias("label"))
    )
    rows = (
        measured.where(~held_out(F.col("doc_id")))
        .join(marks, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "x")
        .limit(SAMPLE)
        .select("x", "label")
        .collect()
    )
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return x, np.array([r["label"] for r in rows], float)


def held_out(doc_id: Column) -> Column:
    """Rows that never serve for learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _scored(model: Trees):
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").values.to_numpy(zero_copy_only=False)
            offsets = batch.column("x").offsets.to_numpy()
            x = x[offsets[0] : offsets[-1]].reshape(-1, len(FEATURES)) if len(offsets) > 1 else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(model, x))], names=["doc_id", "score"]
            )

    return scored


def quality_classifier(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Labels (doc_id, quality) are learned from rows that are not held out only, and scores depend on the
    text alone. A null text counts as empty and is scored too. Rows without an id are not held
    out and never labelled; of several labels of an id the highest counts. Without labels of
    both kinds the score is a constant. Other columns are not read, and an empty table gives an
    empty result.
    """
    arrow_limits(docs.sparkSession)
    plain = narrow(docs, doc_id, text)
    measured = write_table(plain.select("doc_id", statistics(F.col("text")).alias("x")), "statistics")
    model = fit(*_training_rows(measured, labels))
    found = measured.mapInArrow(_scored(model), "doc_id bigint, score double")
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
