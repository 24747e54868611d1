"""Packing documents into batches of similar length.

A histogram of all lengths is aggregated; dynamic programming over it finds the bucket
boundaries with the least padding. Inside a bucket, documents form batches whose padded size
stays within a token budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import n_words, ranked, write_table

BUCKETS = 8
BUDGET = 16384
SPREAD = 256


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets of ascending lengths with the least padding.

    With C(i) documents among the first i lengths, the cost of a bucket (i, j] is
    length(j) * (C(j) - C(i)) plus a constant, so the best i for growing j lies on the lower
    hull of lines with falling slopes -C(i). That takes a step per length and bucket. Of equally good
    boundaries the smaller one wins, then fewer buckets.
    """
    n = len(lengths)
    if not n:
        return []
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    worst = lengths[-1] * total[-1] + 1
    cost = [0] + [worst] * n
    picks = []
    best = (worst, 0)
    for used in range(1, min(buckets, n) + 1):
        hull: list[tuple[int, int, int]] = []
        head = 0
        now, pick = [worst] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if cost[j - 1] < worst:
                slope, base = -total[j - 1], cost[j - 1]
                while len(hull) - head >= 2:
                    (s1, b1, _), (s2, b2, _) = hull[-2], hull[-1]
                    if (base - b1) * (s1 - s2) <= (b2 - b1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, base, j - 1))
            if head == len(hull):
                continue
            x = lengths[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            slope, base, i = hull[head]
            now[j], pick[j] = slope * x + base + x * total[j], i
        picks.append(pick)
        cost = now
        if now[n] < best[0]:
            best = (now[n], used)
    out, j = [], n
    for pick in reversed(picks[: best[1]]):
        out.append(lengths[j - 1])
        j = pick[j]
    return out[::-1]


def bucket_bounds(sizes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for the column `n_tokens`.

    The driver receives one row per different length. Different lengths are at most as many as
    the longest document has tokens, and far fewer than documents.
    """
    rows = sizes.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    pairs = sorted((r["n_tokens"], r["n"]) for r in rows)
    return boundaries([p[0] for p in pairs], [p[1] for p in pairs], buckets)


def _packed(rows: DataFrame, bounds: list[int], budget: int) -> DataFrame:
    """`rows` (doc_id, n_tokens, tie and more) with bucket, bucket_len and batch."""
    bucket = sum((F.lit(b) < F.col("n_tokens")).cast("int") for b in bounds) if bounds else F.lit(0)
    ids = F.coalesce("doc_id", F.lit(0))
    placed = rows.withColumns(
        {
            "bucket": bucket,
            "coarse": F.pmod(ids, F.lit(SPREAD)),
            "fine": F.pmod(F.shiftright(ids, 8), F.lit(SPREAD)),
        }
    )
    length = F.element_at(F.array(*(F.lit(b) for b in bounds or [0])).cast("array<bigint>"), F.col("bucket") + 1)
    order = ranked(placed, ["bucket"], "coarse", "fine", ["doc_id", "tie"], "nth")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len"))))
    return order.withColumn("bucket_len", length).withColumn("batch", F.floor((F.col("nth") - 1) / size))


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_len, batch, padding.

    Tokens are words; a null text has none. A batch holds as many documents of its bucket as
    fit into the budget when padded to bucket_len, and at least one. Documents come in the
    order of (id mod 256, id / 256 mod 256, id), those without id in the place of zero; repeated
    rows are packed each. Other columns are not read, and an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    sizes = write_table(rows.select("doc_id", n_words().alias("n_tokens"), tie.alias("tie")), "lengths")
    return _packed(sizes, bucket_bounds(sizes, buckets), budget).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", "batch",
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def packed_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The documents with their columns in `doc` and n_tokens, bucket, bucket_len and batch."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("n_tokens"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(0).alias("tie"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
    )
    bounds = bucket_bounds(rows.select("n_tokens"), buckets)
    return _packed(rows, bounds, budget).select("doc", "n_tokens", "bucket", "bucket_len", "batch")
