"""Exact deduplication by deterministic block naming.

The normalised text of a document is cut into blocks of `BLOCK` bytes. Equal blocks get the
same integer: blocks are dealt to buckets by a hash, sorted inside their bucket, and the rank
among the bucket's different blocks together with the bucket number is the name. Adjacent names
are paired and the pairs named in the same way until one name is left per document. Names
compare contents, not hashes, so two texts share an identity only if they are equal.

Copies are collapsed before anything is shuffled: a chunk of a map task sends each of its
different texts and blocks once. A group of copies, whatever its size, thus reaches a bucket
once per chunk, and its other rows travel as a few integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import SPACE, arrow_limits, exploded, narrow, slices, unused, write_table

BLOCK = 4096
CHUNK_BYTES = 8 << 20
BLOCKS_PER_BUCKET = 1024

_ROWS = (
    "kind int, chunk bigint, local int, row int, doc_id bigint, sha string, block binary, blocks array<int>"
)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its different blocks (kind 0), its different texts (1) and all its rows (2)."""
    task = TaskContext.get().partitionId()
    schema = pa.schema(
        [
            ("kind", pa.int32()), ("chunk", pa.int64()), ("local", pa.int32()), ("row", pa.int32()),
            ("doc_id", pa.int64()), ("sha", pa.string()), ("block", pa.binary()),
            ("blocks", pa.list_(pa.int32())),
        ]
    )
    for number, batch in enumerate(slices(batches, "text", CHUNK_BYTES)):
        chunk = (task << 24) + number
        texts: dict[bytes, int] = {}
        blocks: dict[bytes, int] = {}
        cuts: list[list[int]] = []
        local = []
        for value in batch.column("text").cast(pa.binary()).to_pylist():
            at = texts.get(value)
            if at is None:
                at = texts[value] = len(cuts)
                parts = [value[i : i + BLOCK] for i in range(0, len(value), BLOCK)] or [b""]
                cuts.append([blocks.setdefault(p, len(blocks)) for p in parts])
            local.append(at)

        def rows(kind, n, **columns):
            columns |= {"kind": [kind] * n, "chunk": [chunk] * n}
            return pa.RecordBatch.from_arrays(
                [
                    columns[f.name] if isinstance(columns.get(f.name), pa.Array)
                    else pa.array(columns.get(f.name, [None] * n), f.type)
                    for f in schema
                ],
                schema=schema,
            )

        yield rows(0, len(blocks), local=range(len(blocks)), block=list(blocks))
        yield rows(1, len(cuts), local=range(len(cuts)), blocks=cuts)
        yield rows(
            2, len(local), local=local, row=range(len(local)),
            doc_id=batch.column("doc_id"), sha=batch.column("sha"),
        )


def _named(distinct: DataFrame, value: Column, order: list[str], buckets: int) -> DataFrame:
    """Adds `name`: bucket and rank in the bucket, one integer per different value."""
    bucket = F.pmod(F.xxhash64(value), F.lit(buckets))
    rank = F.dense_rank().over(W.partitionBy("_bucket").orderBy(*order))
    return (
        distinct.withColumn("_bucket", bucket)
        .withColumn("name", rank.cast("bigint") * F.lit(buckets) + F.col("_bucket"))
        .drop("_bucket")
    )


def _buckets(df: DataFrame) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, df.count() // BLOCKS_PER_BUCKET)


def identities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with chunk, local, row, doc_id and sha; identities with chunk, local, level and name)."""
    arrow_limits(docs.sparkSession)
    cut = write_table(docs.select("doc_id", "text", "sha").mapInArrow(_cut, _ROWS), "blocks", ["kind"])
    rows = cut.where("kind = 2").select("chunk", "local", "row", "doc_id", "sha")
    blocks = cut.where("kind = 0").select("chunk", "local", "block")
    names = _named(blocks, F.col("block"), ["block"], _buckets(blocks)).select(
        "chunk", F.col("local").alias("block"), "name"
    )
    texts = cut.where("kind = 1").select("chunk", "local", "blocks", F.size("blocks").alias("n"))
    places = texts.select("chunk", "local", "n", F.posexplode("blocks").alias("at", "block"))
    level = write_table(
        exploded(places).join(names, ["chunk", "block"]).select("chunk", "local", "n", "at", "name"), "names-0"
    )
    longest = level.agg(F.max("n")).first()[0] or 1
    done = [level.where("n = 1").select("chunk", "local", F.lit(0).alias("level"), "name")]
    depth = 0
    while (1 << depth) < longest:
        left, right = (F.max(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = (
            level.where(F.col("n") > (1 << depth))
            .groupBy("chunk", "local", "n", F.expr("at div 2").cast("int").alias("at"))
            .agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        )
        pairs = write_table(pairs, "pairs")
        distinct = pairs.select("a", "b").distinct()
        named = _named(distinct, F.struct("a", "b"), ["a", "b"], _buckets(pairs))
        level = write_table(
            pairs.join(named, ["a", "b"]).select("chunk", "local", "n", "at", "name"), "names"
        )
        depth += 1
        done.append(
            level.where(F.col("n") <= (1 << depth)).select(
                "chunk", "local", F.lit(depth).alias("level"), "name"
            )
        )
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return rows, whole


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has become one space; a null text is
    an empty one. Of equal texts the row with the smallest id stays. Null ids come after all
    others; of rows that repeat an id and a text, one stays. Other columns are not read, and an
    empty table gives an empty result.
    """
    plain = narrow(docs, doc_id, text).withColumn("text", F.regexp_replace("text", SPACE, " "))
    rows, names = identities(plain.withColumn("sha", F.sha2("text", 256)))
    tagged = rows.join(names, ["chunk", "local"])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "chunk", "row")
    groups = tagged.groupBy("level", "name").agg(
        F.min(order).alias("first"), F.count("*").alias("group_size")
    )
    # As a table of its own, the side with one row per group lets a join split a hot group.
    groups = write_table(groups, "groups")
    first = F.col("first")
    return tagged.join(groups, ["level", "name"]).select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        "group_size",
        ((F.col("chunk") == first["chunk"]) & (F.col("row") == first["row"])).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names."""
    id_, sha, text_sha = unused(docs.columns, "_id", "_sha", "_text_sha")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    hashed = docs.withColumn(text_sha, F.sha2(text, 256))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_sha) == F.col(sha))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", text_sha]).drop(text_sha)
