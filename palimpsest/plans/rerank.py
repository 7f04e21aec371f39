"""Second stages: scores of (query, text) pairs from outside or by words, their scaling, and their return to where results came from."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import relevance
from palimpsest.operators.ranking import above, top_k

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def lexical_score(query: Column, text: Column) -> Column:
    """The scorer used where no other is given: the share of the query's words that occur."""
    return relevance(text, query)


def model_score(scorer: Scorer) -> Callable[[Column, Column], Column]:
    """A vectorised function of queries and texts as a score column (Arrow batches)."""
    udf = F.pandas_udf(scorer, "double")
    return lambda query, text: udf(query, text)


def embedded(texts: DataFrame, encoder: Callable[[pd.Series], pd.Series], text: str = "text", out: str = "v") -> DataFrame:
    """Texts with vectors of an encoder given from outside; a null text is encoded as empty."""
    return texts.withColumn(out, F.pandas_udf(encoder, "array<float>")(F.coalesce(F.col(text), F.lit(""))))


def rerank(results: DataFrame, queries: DataFrame, units: DataFrame, k: int, score: Callable[[Column, Column], Column] = lexical_score, first: int = 100, threshold: float = 0.0) -> DataFrame:
    """The ``first`` results of each query scored anew by their texts: those of at least ``threshold``, the k best. ``query_id, uid, score, rank``."""
    head = top_k(results.drop("rank"), ["query_id"], first).drop("rank", "score")
    full = head.join(units.select("uid", "text"), "uid").join(queries.select("query_id", "query"), "query_id")
    return above(full.withColumn("score", score(F.col("query"), F.coalesce("text", F.lit("")))).select("query_id", "uid", "score"), threshold, k, ["query_id"])


def scaled(results: DataFrame) -> DataFrame:
    """Scores within 0 and 1: left as they are if all of a query's are, else min-max; 0.5 if all are equal."""
    q = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(q), F.max("score").over(q)
    return results.withColumn("scaled", F.when((lo >= 0) & (hi <= 1), F.col("score")).when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.5)).drop("score").withColumnRenamed("scaled", "score")


def in_given_order(results: DataFrame) -> DataFrame:
    """Scores that only keep the order, for a scorer that failed: 0.01 less 0.00001 a place."""
    return results.withColumn("score", 0.01 - (F.col("rank") - 1) * 0.00001)


def split_back(reranked: DataFrame, sources: DataFrame) -> DataFrame:
    """Results with the sources (``uid, source``, or ``query_id, uid, source`` if they differ by query) they came from and their rank within each."""
    key = [c for c in ("query_id", "uid") if c in sources.columns]
    x = reranked.join(sources.select(*key, "source").distinct(), key)
    return x.withColumn("source_rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("rank")).cast("bigint"))
