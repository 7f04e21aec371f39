"""Summaries of runs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean and the 90th and 99th percentile by linear interpolation, overall (nulls) and by the given columns."""
    q = F.percentile(value, F.array(F.lit(0.9), F.lit(0.99)))
    return rows.rollup(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q[0].alias("p90"), q[1].alias("p99")) if by else rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q[0].alias("p90"), q[1].alias("p99"))


def score_summary(rows: DataFrame, category: str) -> DataFrame:
    """By category and overall (null): total, evaluated, correct, wrong, share correct, mean and population deviation of the score."""
    return rows.rollup(category).agg(
        F.count("*").alias("total"), F.count("score").alias("evaluated"), F.count_if(F.col("correct")).alias("correct"), F.count_if(~F.col("correct")).alias("wrong"),
        F.try_divide(F.count_if(F.col("correct")), F.count("score")).alias("accuracy"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"),
    )


def metric_aggregates(rows: DataFrame, value: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.count(value).alias("n"))


def weighted_comparison(rows: DataFrame, by: str, exclude: str) -> DataFrame:
    """Means weighted by ``n`` of each category, overall, and overall without one category."""
    mean = (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("weighted")
    named = rows.groupBy(F.col(by).cast("string").alias("category")).agg(mean)
    return named.unionByName(rows.agg(mean).select(F.lit("overall").alias("category"), "weighted")).unionByName(rows.where(F.col(by) != exclude).agg(mean).select(F.lit(f"overall without {exclude}").alias("category"), "weighted"))


def summary_by_type(rows: DataFrame, kind: str) -> DataFrame:
    """By type of question and overall (null): questions, correct ones, their share, mean and total tokens, and the first wrong one. ``rows``: the type, ``query_id, correct, tokens``."""
    return rows.rollup(kind).agg(
        F.count("*").alias("questions"), F.count_if("correct").alias("correct"), (F.count_if("correct") / F.count("*")).alias("accuracy"), F.avg("tokens").alias("mean_tokens"), F.sum("tokens").alias("tokens"),
        F.min(F.when(~F.col("correct"), F.col("query_id"))).alias("first_wrong"),
    )


def evidence_recall(rows: DataFrame) -> DataFrame:
    """``rows``: query_id, evidence and retrieved (arrays of ids); adds ``recall``, the share of the evidence retrieved, 1 for none."""
    e = F.array_distinct("evidence")
    return rows.withColumn("recall", F.when(F.size(e) > 0, F.size(F.array_intersect(e, "retrieved")) / F.size(e)).otherwise(1.0))


def answer_scores(pairs: DataFrame, *key: str) -> DataFrame:
    """``pairs``: a key, once each, and the words of gold and answer (``g``, ``a``); words stay where the first column of the key has brought them. ``em``: whether their sets of words are equal; ``f1``: that of their bags, 0 if nothing is shared.
    Words are counted by grouping, so texts of any length cost as much as they have words."""
    tag = lambda c, g, a: F.transform(c, lambda w: F.struct(w.alias("w"), F.lit(g).alias("g"), F.lit(a).alias("a")))
    words = pairs.select(*key, F.explode_outer(F.concat(tag("g", 1, 0), tag("a", 0, 1))).alias("x")).groupBy(*key, F.col("x.w").alias("w")).agg(F.coalesce(F.sum("x.g"), F.lit(0)).alias("g"), F.coalesce(F.sum("x.a"), F.lit(0)).alias("a"))
    n = words.groupBy(*key).agg(F.sum(F.least("g", "a")).alias("same"), F.count_if((F.col("g") > 0) != (F.col("a") > 0)).alias("apart"), F.sum("g").alias("gold"), F.sum("a").alias("answer"))
    p, r = F.try_divide("same", "answer"), F.try_divide("same", "gold")
    return n.select(*key, (F.col("apart") == 0).alias("em"), F.when(F.col("same") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def pre_aggregated(items: DataFrame, category: str, name: str, count: str) -> DataFrame:
    """By category ('Other' if missing): the sum of counts and the number of distinct names."""
    return items.groupBy(F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit("Other")).alias("category")).agg(F.sum(count).alias("total"), F.count_distinct(name).alias("names"))


def relation_statistics(relations: DataFrame) -> DataFrame:
    """One row: relations, those within and across sessions, types, and confidence."""
    cross = F.col("src_session") != F.col("dst_session")
    return relations.agg(
        F.count("*").alias("relations"), F.count_if(cross).alias("cross_session"), F.count_if(~cross).alias("within_session"), F.count_distinct("type").alias("types"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")
    )
