"""What the operators of this package share: input columns, Arrow limits, tables in the work folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import work_folder

# White space between words, as a Java and as a DuckDB class.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

ARROW_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long documents do not meet in a Python worker."""
    for key, value in ARROW_LIMITS.items():
        if int(spark.conf.get(key, None) or 1 << 40) > int(value):
            spark.conf.set(key, value)


def narrow(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under its own names; others cannot clash with them."""
    return docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`").alias(c) for c in more),
    )


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as tell it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """Adds (`no_id`, `key`), which names a row: its id or, where that is null, a hash of its text."""
    return docs.select(
        "*",
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.xxhash64("text")).alias("key"),
    )


# For tables of large rows: writers and readers hold a row group at a time.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20)}


def write_table(
    df: DataFrame, name: str, partition_by: Iterable[str] = (), options: Mapping[str, str] | None = None
) -> DataFrame:
    """Write to the cluster's shared folder and read it back.

    Cuts lineage, keeps what several later steps read, and outlives lost executors.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.partitionBy(*partition_by).options(**(options or {})).parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def exploded(df: DataFrame) -> DataFrame:
    """A side of a join that has more rows than the table it is read from; it is shuffled, never broadcast.

    Spark takes no notice of what an explode adds: to it, such a side is as small as the files below. Chosen for a
    broadcast by that, it would gather in the driver, as a broadcast once planned is not taken back.
    """
    return df.hint("merge")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.col(text), F.lit(WORD)).cast("bigint")


def text_bytes(docs: DataFrame) -> int:
    """Size of all texts: one number that tells how many buckets the data need."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes, or one row if longer."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        begin, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < len(lengths):
            yield batch.slice(begin)


def ranked(
    df: DataFrame, keys: list[str], coarse: str, fine: str, order: list[str], name: str = "rank"
) -> DataFrame:
    """Adds the 1-based rank of each row in its key by (`coarse`, `fine`, `order`).

    A key, however hot, never meets in one task: rows are ranked inside (key, coarse, fine),
    these are counted inside (key, coarse), and only the coarse slots meet per key. All three
    columns and the keys must not be null.
    """
    slots = [*keys, coarse]
    earlier = (W.unboundedPreceding, -1)
    counts = df.groupBy(*slots, fine).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*slots).agg(F.sum("_n").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(coarse).rowsBetween(*earlier))
    within = F.sum("_n").over(W.partitionBy(*slots).orderBy(fine).rowsBetween(*earlier))
    offsets = counts.select(*slots, fine, F.coalesce(within, F.lit(0)).alias("_within")).join(
        totals.select(*slots, F.coalesce(before, F.lit(0)).alias("_before")), slots
    )
    place = F.row_number().over(W.partitionBy(*slots, fine).orderBy(*order))
    return df.join(offsets, [*slots, fine]).select(
        *df.columns, (F.col("_before") + F.col("_within") + place).alias(name)
    )
