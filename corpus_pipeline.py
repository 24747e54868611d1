"""A corpus from raw documents to batches: filter, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import unused, write_table
from eventloom.llm.exact_dedup import keep_first
from eventloom.llm.mixing import mixture
from eventloom.llm.packing import packed_documents
from eventloom.llm.quality_rules import keep_good
from eventloom.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept, cutoffs certified on the labels of the corpus."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal documents."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in batches of similar length; their own columns first.

    n_tokens, bucket, bucket_len and batch follow, each with an underscore more where the documents have that name.
    """
    packed = packed_documents(docs)
    own = [F.col("doc")[c].alias(c) for c in docs.columns]
    new = ("n_tokens", "bucket", "bucket_len", "batch")
    return packed.select(*own, *(F.col(c).alias(n) for c, n in zip(new, unused(docs.columns, *new), strict=True)))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

# XXH64, which the fingerprints are made of, is no SQL function; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
