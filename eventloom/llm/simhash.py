"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits differ in at most one bit of one of their 32-bit halves. Each
half therefore sends all its variants within half the radius, one bit, and both sides meet at
a common variant: a half with an even number of ones sends its 32 neighbours and itself, one with
an odd number only itself, as halves one bit apart have different parity. Colliding
fingerprints are verified on all 64 bits.

Where many fingerprints collide, as in large groups of near copies, no pairs are made. Those
fingerprints send the ball around their other half too. All that meet at such a point lie within 3 bits of
its smallest member at most one bit away, so linking each of them to that one loses no
connection and makes no more links than rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_limits, exploded, keyed, narrow, write_table
from eventloom.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
# Colliding fingerprints up to this number are compared in pairs; more go through the second ball.
PAIRWISE = 64


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(line[a:b], SEED)
            for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
        ]
    ones = np.zeros(64, np.int64)
    whole = np.array(hashes, dtype=">u8")
    for i in range(0, len(whole), 1 << 16):
        part = whole[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _fingerprints(names: list[str]):
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = pa.array((fingerprint(t.as_py()) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), fps], names=[*names, "fp"])

    return found


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(no_id, key, fp) of every row of `keyed` documents, and `more` binary columns before fp."""
    arrow_limits(docs.sparkSession)
    names = ["no_id", "key", *more]
    kinds = "no_id boolean, key bigint, " + "".join(f"{name} binary, " for name in more) + "fp bigint"
    return docs.select(*names, "text").mapInArrow(_fingerprints(names), kinds)


def _flips(value: Column, positions: int, times: int = 1) -> Column:
    """Array of `value` with each choice of `times` bits flipped."""
    masks = [1 << i for i in range(positions)]
    if times == 2:
        masks = [x | y for i, x in enumerate(masks) for y in masks[i + 1 :]]
    return F.transform(F.array(*(F.lit(m).cast("bigint") for m in masks)), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints (`fp`) that join all within the radius.

    All links are true; in crowded neighbourhoods they are stars instead of all pairs.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select(
        "fp",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), high.alias("half"), low.alias("other")),
                F.struct(F.lit(1).alias("side"), low.alias("half"), high.alias("other")),
            )
        ).alias("h"),
    ).select("fp", "h.*")
    half, even = F.col("half"), F.bit_count("half") % 2 == 0
    sent = halves.select(
        "fp", "side", "half", "other",
        F.explode(F.when(even, F.concat(F.array(half), _flips(half, 32))).otherwise(F.array(half))).alias("v"),
    )
    sent = sent.select("fp", "side", "v", "other", (F.col("half") == F.col("v")).alias("own"))
    # A variant that no fingerprint has itself joins nothing.
    sizes = sent.groupBy("side", "v").agg(F.count("*").alias("n"), F.max("own").alias("met"))
    met = exploded(sent).join(sizes.where("n > 1 and met").drop("met"), ["side", "v"])
    met = write_table(met, "met")
    few = met.where(F.col("n") <= PAIRWISE)
    one = few.where("own").select("side", "v", F.col("fp").alias("a"))
    two = few.select("side", "v", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    # Rows of one variant lie together and take few bytes on disk, many more in memory.
    pairs = one.join(exploded(two), ["side", "v"]).where((F.col("a") != F.col("b")) & near).select("a", "b")

    crowd = met.where(F.col("n") > PAIRWISE)
    other = F.col("other")
    ball = F.concat(F.array(other), _flips(other, 32))
    wide = crowd.where("own").where(F.bit_count("other") % 2 == 0)
    points = crowd.select("side", "v", "fp", F.explode(ball).alias("w"), F.col("own").alias("hub"))
    points = points.unionByName(
        wide.select("side", "v", "fp", F.explode(_flips(other, 32, 2)).alias("w"), F.lit(False).alias("hub"))
    )
    hubs = (
        points.where("hub").groupBy("side", "v", "w").agg(F.min("fp").alias("a"))
    )
    stars = exploded(points).join(hubs, ["side", "v", "w"]).select("a", F.col("fp").alias("b"))
    stars = stars.where((F.col("a") != F.col("b")) & near)
    return pairs.unionByName(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def rooted(docs: DataFrame, *more: str) -> DataFrame:
    """(no_id, key, `more`, fp, root) of every row of `keyed` documents; root is one for a component."""
    own = write_table(fingerprints(docs, *more), "fingerprints")
    fps = write_table(own.select("fp").distinct(), "distinct")
    roots = components(links(fps))
    return own.join(roots, own["fp"] == roots["node"], "left").select(
        "no_id", "key", *more, "fp", F.coalesce("root", "fp").alias("root")
    )


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most 3 bits are linked; component_id is the
    smallest id that a document reaches over links. Documents without a word, null texts among
    them, have fingerprint zero and are linked like any others. Null ids are no component_id;
    a component of null ids alone has a null one. Repeated rows stay. Other columns are not
    read, and an empty table gives an empty result.
    """
    rows = write_table(rooted(keyed(narrow(docs, doc_id, text))), "rooted")
    own_id = F.when(~F.col("no_id"), F.col("key"))
    # As a table of its own, the side with one row per component lets a join split a hot one.
    least = write_table(rows.groupBy("root").agg(F.min(own_id).alias("component_id")), "least")
    return rows.join(least, "root").select(
        own_id.alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns: that with the smallest id.

    A row is named by its id and the SHA-256 of its text, so rows that share an id but not a component all
    count. Rows without an id come after those with one, and of repeated rows one stays.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = keyed(docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), whole))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    name = ["no_id", "key", "sha"]
    first = rooted(rows, "sha").groupBy("root").agg(F.min(F.struct(*name)).alias("first"))
    kept = first.select("first.*")
    found = rows.select(*name, "doc").join(kept, name, "left_semi")
    return found.dropDuplicates(name).select("doc.*")
