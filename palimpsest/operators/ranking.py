"""Top-k by score with a fixed order of ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(score: str, *ties: str) -> list[Column]:
    """Descending score, compared at nine decimals so that the order of a sum doesn't matter, then the ties."""
    return [F.round(F.col(score), 9).desc(), *(F.col(t) for t in ties)]


def top_k(rows: DataFrame, partition: list[str], k: int | Column, score: str = "score", tie: str = "uid", rank: str = "rank") -> DataFrame:
    """The k best rows of each partition, with their rank from 1. The optimizer keeps k rows of each task before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*by_score(score, tie))).cast("bigint"))
    return ranked.where(F.col(rank) <= k)


def above(rows: DataFrame, threshold: float, k: int, partition: list[str], score: str = "score") -> DataFrame:
    """Rows with at least ``threshold`` (none is dropped if it isn't positive), the k best of them."""
    return top_k(rows.where(F.col(score) >= threshold) if threshold > 0 else rows, partition, k, score)
