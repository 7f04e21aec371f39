"""Exact nearest neighbours of dense vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.blocks import Weigh
from palimpsest.operators.products import TERMS, best_products
from palimpsest.operators.ranking import top_k
from palimpsest.session import bounded_broadcast, ship, written

#: Vectors in a block: a product of two blocks is the unit of work.
BLOCK = 4096
MIN_NORM = 1e-6


def _blocks(vectors: DataFrame, key: str, prefix: str, rows: int) -> DataFrame:
    """Blocks of about ``rows`` vectors, one row each."""
    n = max(1, -(-vectors.count() // rows))
    return vectors.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{prefix}_block")).agg(
        F.collect_list(key).alias(f"{prefix}_ids"), F.flatten(F.collect_list(F.col("v").cast("array<double>"))).alias(f"{prefix}_values")
    )


def _matrix(values: pa.ListScalar, n: int) -> np.ndarray:
    m = values.values.to_numpy(zero_copy_only=False).reshape(n, -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, drop_self: bool = False, block: int = BLOCK, metric: str = "cosine") -> DataFrame:
    """``query_id, uid, cosine, score, rank``: the k nearest of ``vectors`` (``uid, v``) to each of ``queries`` (``query_id, v``).

    Exact cosine; ``score`` is (cosine + 1) / 2 held within 0 and 1. With the metric ``l2`` the nearest by Euclidean distance, scored 1 / (1 + distance); ``cosine`` is then minus the distance. Vectors of another length, with a null, or of a norm below
    1e-6 are left out on both sides. Both sides are cut into blocks; a product of two blocks is one matrix
    multiplication that keeps k rows a query, so neither side is broadcast as a whole nor are pairs materialised.
    """
    ship(vectors.sparkSession)
    good = lambda df: df.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) >= MIN_NORM**2))
    q, u = _blocks(good(queries.select("query_id", "v")), "query_id", "q", block), _blocks(good(vectors.select("uid", "v")), "uid", "u", block)
    keep = k + (1 if drop_self else 0)
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["uid"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qi, ui = b.column("q_ids")[i].values, b.column("u_ids")[i].values
                if metric == "l2":
                    x, y = (b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in (("q_values", len(qi)), ("u_values", len(ui))))
                    s = -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
                else:
                    s = _matrix(b.column("q_values")[i], len(qi)) @ _matrix(b.column("u_values")[i], len(ui)).T
                if len(ui) > keep + 8:
                    # A few more than k, so that the order of ties is decided by id, not here.
                    cut = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
                    rows, cols = np.nonzero(s >= cut - 1e-9)
                else:
                    rows, cols = np.indices(s.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(rows)), ui.take(pa.array(cols)), pa.array(s[rows, cols])], names=["query_id", "uid", "cosine"])

    near = q.crossJoin(u).mapInArrow(run, f"query_id {kinds[0]}, uid {kinds[1]}, cosine double")
    if drop_self:
        near = near.where(F.col("query_id") != F.col("uid"))
    score = 1 / (1 - F.col("cosine")) if metric == "l2" else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    return top_k(near.withColumn("score", score), ["query_id"], k)


def semantic_neighbours(queries: DataFrame, vectors: DataFrame, dim: int, most: int, threshold: float) -> DataFrame:
    """The ``most`` + 1 nearest of each query, then without itself and below ``threshold``: the cut comes before the threshold."""
    near = dense_search(queries, vectors, most + 1, dim)
    return near.where((F.col("query_id") != F.col("uid")) & (F.round("score", 9) >= threshold))


def implicit_neighbours(queries: DataFrame, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """Neighbours of several queries together: each once, in order of query and rank, until k times the number of queries."""
    near = dense_search(queries, vectors, k, dim, drop_self=True)
    first = near.groupBy("uid").agg(F.min(F.struct("query_id", "rank")).alias("at"), F.max("score").alias("score"))
    n = queries.select("query_id").distinct().count()
    return first.orderBy("at", "uid").limit(k * n).select("uid", "score")


def sparse_search(queries: DataFrame, units: DataFrame, k: int, stored: bool = False, blocks: DataFrame | None = None, weigh: Weigh | None = None, size: int | None = None) -> DataFrame:
    """Dot product over shared terms of exploded sparse vectors: ``queries(query_id, term, weight)``, ``units(uid,
    term, weight)``; only positive, finite weights, only positive scores. ``query_id, uid, score, rank``. Rows of terms that no query has are left out before anything is shuffled.
    ``stored`` units are read from a table as they are, twice; others are written first. ``blocks`` and ``weigh``, if given, have the same weights, and ``size`` is about their number."""
    positive = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    q = written(queries.where(positive).select("query_id", "term", F.col("weight").alias("qw")), "query-weights")
    u = units.where(positive).select("uid", "term", F.col("weight").alias("uw"))
    if not stored:
        u = written(u.join(bounded_broadcast(q.select("term").distinct(), TERMS), "term", "left_semi").select("uid", "term", "uw"), "unit-weights")
    return best_products(q, u, u.count() if size is None else size, k, 0.0, None, blocks, weigh)


def tiny_weights_dropped(sparse: DataFrame, vocabulary: int = 30522) -> DataFrame:
    """A sparse vector's stored form: weights above 1e-6 in size, terms within the vocabulary."""
    return sparse.where((F.abs("weight") > 1e-6) & F.col("term").between(0, vocabulary - 1))


def save_sparse(units: DataFrame, folder: str) -> None:
    """Write a sparse index (``uid, term, weight``), sorted by term in each file."""
    units.select("uid", "term", "weight").sortWithinPartitions("term").write.parquet(folder)


def changed_sparse(stored: DataFrame, new: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """A sparse index with new vectors, which take the place of old ones of the same uid, and without the uids ``gone``."""
    leaving = [x.select("uid") for x in (new, gone) if x is not None]
    for x in leaving:
        stored = stored.join(x.distinct(), "uid", "left_anti")
    return stored if new is None else stored.unionByName(new.select(*stored.columns))


def near_pairs(vectors: DataFrame, dim: int, least: float, block: int = BLOCK, group: str | None = None) -> DataFrame:
    """``uid, other, cosine``: all ordered pairs of different vectors with a cosine of at least ``least``, of the same ``group`` if a column is named. Bad vectors are left out as in ``dense_search``.
    Each two blocks are multiplied once, and both orders of a pair come from the same product."""
    ship(vectors.sparkSession)
    ok = vectors.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) >= MIN_NORM**2)).select("uid", "v", (F.col(group) if group else F.lit(0)).alias("g"))
    n = max(1, -(-ok.count() // block))
    side = lambda p: ok.groupBy("g", F.pmod(F.xxhash64("uid"), F.lit(n)).alias(f"{p}_block")).agg(F.collect_list("uid").alias(f"{p}_ids"), F.flatten(F.collect_list(F.col("v").cast("array<double>"))).alias(f"{p}_values"))
    kind = vectors.schema["uid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                p, q = x.column("a_ids")[i].values, x.column("b_ids")[i].values
                s = _matrix(x.column("a_values")[i], len(p)) @ _matrix(x.column("b_values")[i], len(q)).T
                near = s >= least - 1e-9
                if x.column("a_block")[i].as_py() == x.column("b_block")[i].as_py():
                    near = np.triu(near, 1)
                rows, cols = np.nonzero(near)
                both = [pa.concat_arrays([a.take(pa.array(i)) for a, i in order]) for order in (((p, rows), (q, cols)), ((q, cols), (p, rows)))]
                yield pa.RecordBatch.from_arrays([*both, pa.array(np.tile(s[rows, cols], 2))], names=["uid", "other", "cosine"])

    a, b = side("a"), side("b").withColumnRenamed("g", "h")
    pairs = a.join(b, (F.col("g") == F.col("h")) & (F.col("a_block") <= F.col("b_block"))) if group else a.crossJoin(b).where("a_block <= b_block")
    return pairs.select("a_ids", "a_values", "a_block", "b_ids", "b_values", "b_block").mapInArrow(run, f"uid {kind}, other {kind}, cosine double").where("uid <> other")
