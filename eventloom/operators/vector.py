"""Vector similarity and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_CONSTANT = 60


def cosine_to(query: Sequence[float]) -> Callable[[Column], Column]:
    """Cosine similarity of a vector column to one query vector, a batch at a time.

    Arrow batches become one matrix product in double precision. Lengths must agree.
    """
    wanted = np.asarray(query, dtype=np.float64)
    wanted = wanted / np.linalg.norm(wanted)

    @F.pandas_udf("double")
    def similarity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype="float64")
                continue
            matrix = np.stack(vectors.to_numpy()).astype(np.float64)
            if matrix.shape[1] != wanted.shape[0]:
                raise ValueError(f"vectors of {matrix.shape[1]} and {wanted.shape[0]} dimensions")
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            with np.errstate(divide="ignore", invalid="ignore"):
                yield pd.Series(matrix @ wanted / norms)

    return similarity


def vector_search(
    vectors: DataFrame, query: Sequence[float], limit: int, column: str = "embedding"
) -> DataFrame:
    """Exact nearest rows by cosine; rows without a vector are skipped."""
    scored = vectors.where(F.col(column).isNotNull()).withColumn(
        "score", cosine_to(query)(F.col(column))
    )
    return scored.drop(column).orderBy(F.desc("score"), "event_id").limit(limit)


def _ranked(results: DataFrame, limit: int, name: str) -> DataFrame:
    # One task numbers what the limit leaves.
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "event_id")
    best = results.orderBy(F.desc("score"), "event_id").limit(2 * limit)
    return best.select(
        "event_id", (1.0 / (F.lit(RRF_CONSTANT) + F.row_number().over(order))).alias(name)
    )


def fuse(keyword: DataFrame | None, vector: DataFrame | None, limit: int) -> DataFrame:
    """Reciprocal rank fusion of the best 2 * limit of two lists; a missing one leaves the other alone."""
    if keyword is None or vector is None:
        only = vector if keyword is None else keyword
        if only is None:
            raise ValueError("no result list")
        return only.select("event_id", "score").orderBy(F.desc("score"), "event_id").limit(limit)
    joined = _ranked(keyword, limit, "_k").join(_ranked(vector, limit, "_v"), "event_id", "full_outer")
    score = F.coalesce("_k", F.lit(0.0)) + F.coalesce("_v", F.lit(0.0))
    return (
        joined.select("event_id", score.alias("score"))
        .orderBy(F.desc("score"), "event_id")
        .limit(limit)
    )


def vector_text(column: Column) -> Column:
    """`[1.0,2.0]` text of a vector."""
    return F.to_json(column)


def text_vector(column: Column) -> Column:
    return F.from_json(column, "array<float>")
