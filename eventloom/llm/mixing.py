"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in `target / source size` copies. The expected copies
are summed up in the order of sizes, one offset per source is added, and a document is
taken once for every whole number that its stretch of the sum crosses. In the order of sizes the words taken
miss the target by about one document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import n_words, ranked, write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SPREAD = 256


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(no_source, source_key, source_size, target): one row per source.

    Sources take the weights in turn, in code point order, a null source last. Together they get `share`
    of all words; none gets more than `most` times its own, and what it would have above
    goes to the others by weight. The windows below run over one row per source.
    """
    own = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy("no_source", "source_key")) - 1) % len(weights)
    weighed = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
        "cap", F.col("source_size") * most
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    # If exactly the sources before this one were at their cap, the others would get `level` per weight.
    level = (
        F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    placed = weighed.withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    found = placed.withColumn("open", F.min(open_).over(all_rows))
    target = F.when(F.col("nth") >= F.col("open.nth"), F.col("open.level") * F.col("weight")).otherwise(
        F.col("cap").cast("double")
    )
    return found.select("no_source", "source_key", "source_size", target.alias("target"))


def _offset(seed: str) -> Column:
    """In [0, 1), one for each source and seed."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source_key", F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def _sampled(rows: DataFrame, seed: str) -> DataFrame:
    """`rows` (doc_id, source, size, tie and more) with source_size, target and copies."""
    own = F.col("source").cast("string")
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SPREAD))
    placed = rows.withColumns(
        {
            "no_source": own.isNull(),
            "source_key": F.coalesce(own, F.lit("")),
            # Both grow as sizes fall.
            "coarse": -F.floor(F.log2(F.col("size") + 1.0) * 32),
            "fine": -F.col("size") * SPREAD + part,
        }
    )
    aims = targets(placed.select("no_source", "source_key", "size"))
    order = ranked(placed, ["no_source", "source_key"], "coarse", "fine", ["doc_id", "tie"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    return (
        order.join(aims, ["no_source", "source_key"])
        .withColumns({"rate": rate, "offset": _offset(seed)})
        .withColumn("copies", upto(F.col("rank")) - upto(F.col("rank") - 1))
    )


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix"
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Size is the number of words, zero for a null text. Null sources form one source. Documents
    of equal size and id (null ids: in the order of a hash of the text) are interchangeable.
    Other columns are not read, and an empty table gives an empty result. Reruns agree.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    rows = write_table(rows.select("doc_id", "source", n_words().alias("size"), tie.alias("tie")), "sizes")
    return _sampled(rows, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(0).alias("tie"),
        whole,
    )
    return (
        _sampled(rows, seed)
        .where("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth"))
        .select("doc.*")
    )
