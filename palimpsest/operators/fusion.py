"""Fusion of the results of several retrieval methods, in one long table ``query_id, method, uid, score, rank``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.ranking import top_k
from palimpsest.session import ship


def once_per_method(results: DataFrame) -> DataFrame:
    """A unit that a method returned again counts with its best rank."""
    return results.groupBy("query_id", "method", "uid").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))


def rrf(results: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (constant + rank) over methods."""
    fused = results.groupBy("query_id", "uid").agg(F.sum(1 / (constant + F.col("rank"))).alias("score"))
    return top_k(fused, ["query_id"], k)


def average(results: DataFrame, k: int) -> DataFrame:
    """The mean over the methods that returned the unit."""
    return top_k(results.groupBy("query_id", "uid").agg(F.avg("score").alias("score")), ["query_id"], k)


def weighted(results: DataFrame, weights: dict[str, float], k: int, normalization: str = "min_max") -> DataFrame:
    """Weighted mean of normalised scores. A method that didn't return a unit gives it 0 before normalisation over all
    units of the query; equal scores are left as they are. ``z_score`` standardises and then applies min-max."""
    known = {m: w for m, w in weights.items() if w > 0}
    units = results.select("query_id", "uid").distinct()
    wide = units.withColumn("method", F.explode(F.array(*[F.lit(m) for m in known])))
    full = wide.join(results.select("query_id", "uid", "method", "score"), ["query_id", "uid", "method"], "left").fillna(0.0, ["score"])
    w = Window.partitionBy("query_id", "method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    if normalization == "z_score":
        full = full.withColumn("z", F.try_divide(F.col("score") - F.avg("score").over(w), F.stddev_pop("score").over(w)))
        zlow, zhigh = F.min("z").over(w), F.max("z").over(w)
        scaled = F.when(high > low, (F.col("z") - zlow) / (zhigh - zlow + 1e-8)).otherwise(F.col("score"))
    else:
        scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.col("score"))
    weight = F.coalesce(*[F.when(F.col("method") == m, F.lit(float(v))) for m, v in known.items()])
    fused = full.withColumn("scaled", scaled).groupBy("query_id", "uid").agg((F.sum(F.col("scaled") * weight) / F.lit(float(sum(known.values())))).alias("score"))
    return top_k(fused, ["query_id"], k)


def in_all_methods(results: DataFrame) -> DataFrame:
    """Units that every method which returned anything for the query returned."""
    methods = results.groupBy("query_id").agg(F.count_distinct("method").alias("n"))
    each = results.groupBy("query_id", "uid").agg(F.count_distinct("method").alias("found"))
    return each.join(methods, "query_id").where("found = n").select("query_id", "uid")


def method_statistics(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "method").agg(F.count("*").alias("results"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def agreement(results: DataFrame, sparse: set[str], dense: set[str], best: DataFrame, top: int = 10) -> DataFrame:
    """How sure a result is: ``query_id, confidence, jaccard, final_score, level``. Confidence is the best score
    (``best``: query_id, score) held within 0 and 1; jaccard compares the sparse methods' best units with the dense ones'."""
    head = results.where(F.col("rank") <= top)
    side = lambda ms, c: F.collect_set(F.when(F.col("method").isin(*sorted(ms)), F.col("uid"))).alias(c)
    sets = head.groupBy("query_id").agg(side(sparse, "s"), side(dense, "d"))
    union = F.size(F.array_union("s", "d"))
    out = sets.join(best, "query_id", "left").select(
        "query_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.5)))).alias("confidence"), F.when(union > 0, F.size(F.array_intersect("s", "d")) / union).otherwise(0.0).alias("jaccard")
    )
    final = F.round(0.7 * F.col("confidence") + 0.3 * F.col("jaccard"), 4)
    return out.select("query_id", F.round("confidence", 4).alias("confidence"), F.round("jaccard", 4).alias("jaccard"), final.alias("final_score"), F.when(final >= 0.7, "High").when(final >= 0.4, "Medium").otherwise("Low").alias("level"))


def mmr(results: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, weight: float = 0.5, constant: int = 60, pool: int = 200) -> DataFrame:
    """Maximal marginal relevance over the fused candidates: ``query_id, uid, score, rank``.

    Candidates come in the order of reciprocal rank fusion, ``pool`` of them at most (what is chosen is a sequential choice
    within one query, so a query is one task). Each step takes the greatest ``weight`` * cos(query, d) - (1 - weight) * max(0,
    cos(d, chosen)), the first within 1e-5. The score mixes fusion (0.3) and the place (0.7). Units without a vector, and queries without one, keep the order of fusion after the others.
    """
    ship(results.sparkSession)
    fused = rrf(results, pool, constant).select("query_id", "uid", F.col("score").alias("fused"), F.col("rank").alias("place"))
    joined = fused.join(vectors.select("uid", F.col("v").cast("array<double>").alias("v")), "uid", "left").join(queries.select("query_id", F.col("v").cast("array<double>").alias("qv")), "query_id", "left")
    uid = results.schema["uid"].dataType.simpleString()
    qid = results.schema["query_id"].dataType.simpleString()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        n, fused, v, qv = len(rows), rows["fused"].to_numpy(), rows["v"].tolist(), rows["qv"].tolist()
        usable = [i for i in range(n) if v[i] is not None and qv[i] is not None and len(v[i]) == len(qv[i])]
        order: list[int] = []
        if usable:
            m = np.array([v[i] for i in usable], dtype=np.float64)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            q = np.asarray(qv[usable[0]], dtype=np.float64)
            rel = m @ (q / max(np.linalg.norm(q), 1e-12))
            redundant, left = np.zeros(len(usable)), np.ones(len(usable), dtype=bool)
            for _ in range(min(k, len(usable))):
                value = np.where(left, weight * rel - (1 - weight) * redundant, -np.inf)
                j = int(np.flatnonzero(value >= value.max() - 1e-5)[0])
                left[j] = False
                order.append(usable[j])
                redundant = np.maximum(redundant, m @ m[j])
        able = set(usable)
        order += [i for i in range(n) if i not in able][: max(0, k - len(order))]
        size = len(order)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[order].to_numpy(), "uid": rows["uid"].iloc[order].to_numpy(), "score": [0.3 * fused[i] + 0.7 * (size - r) / size for r, i in enumerate(order)], "rank": range(1, size + 1)})

    return joined.groupBy("query_id").applyInPandas(choose, f"query_id {qid}, uid {uid}, score double, rank bigint")
