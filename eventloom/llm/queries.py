"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (
    alignment,
    collocations,
    exact_dedup,
    license_scan,
    mixing,
    oracles,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filters,
)

Run = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filtered_pages(table(spark, sf_dir, "pages"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir))


QUERIES: dict[str, Run] = {
    "op1_substring_dedup": op1,
    "op2_exact_dedup": op2,
    "op3_quality_rules": op3,
    "op4_sharding": op4,
    "op5_quality_classifier": op5,
    "op6_suffix_dedup": op6,
    "op7_mixing": op7,
    "op8_packing": op8,
    "op9_simhash_dedup": op9,
    "op10_url_filters": op10,
    "op11_collocations": op11,
    "op12_tokenizer_alignment": op12,
    "op13_license_scan": op13,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": oracles.EXACT_DEDUP,
    "op3_quality_rules": oracles.QUALITY_RULES,
    "op7_mixing": oracles.MIXING,
    "op8_packing": oracles.PACKING,
    "op10_url_filters": oracles.URL_FILTERS,
    "op11_collocations": oracles.COLLOCATIONS,
}
