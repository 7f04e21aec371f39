"""Whole retrieval plans: hybrid search, layered search, three towers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.functions.text import token_estimate
from palimpsest.operators import dense, fusion, lexical, prune
from palimpsest.operators.ranking import by_score, top_k
from palimpsest.session import written


@dataclass
class Config:
    """Methods (bm25, splade, cosine), their fusion (rrf, average, weighted) and the size of each recall."""

    methods: tuple[str, ...] = ("bm25", "splade", "cosine")
    fusion: str = "rrf"
    weights: dict[str, float] = field(default_factory=dict)
    constant: int = 60
    normalization: str = "min_max"
    multiplier: float = 3.0
    least: int = 50

    def recall(self, k: int) -> int:
        return max(int(k * self.multiplier), self.least)


@dataclass
class Corpus:
    """What can be searched: units (``uid, text``), vectors (``uid, v``), exploded sparse vectors (``uid, term, weight``), and the units' lexical index if there is one."""

    units: DataFrame
    vectors: DataFrame | None = None
    sparse: DataFrame | None = None
    dim: int = 64
    index: lexical.Index | None = None


def recall(corpus: Corpus, texts: DataFrame, vectors: DataFrame | None, sparse: DataFrame | None, config: Config, k: int, within: DataFrame | None = None) -> DataFrame:
    """``query_id, method, uid, score, rank`` of each method, with the same k; ``within`` (``uid``) restricts what is found."""
    n, out = config.recall(k), []
    limit = lambda df: df if within is None else df.join(within.select("uid").distinct(), "uid", "left_semi")
    if "bm25" in config.methods:
        out.append(lexical.bm25(corpus.index or lexical.build_index(corpus.units).stored(), texts, n, within).withColumn("method", F.lit("bm25")))
    if "splade" in config.methods and sparse is not None and corpus.sparse is not None:
        out.append(dense.sparse_search(sparse, limit(corpus.sparse), n).withColumn("method", F.lit("splade")))
    if "cosine" in config.methods and vectors is not None and corpus.vectors is not None:
        out.append(dense.dense_search(vectors, limit(corpus.vectors), n, corpus.dim).withColumn("method", F.lit("cosine")))
    columns = ["query_id", "method", "uid", "score", "rank"]
    found = out[0].select(*columns)
    for o in out[1:]:
        found = found.unionByName(o.select(*columns))
    return found


def fuse(results: DataFrame, config: Config, k: int) -> DataFrame:
    if config.fusion == "average":
        return fusion.average(results, k)
    if config.fusion == "weighted" and config.weights:
        return fusion.weighted(results, config.weights, k, config.normalization)
    return fusion.rrf(results, k, config.constant)


def expand(results: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Results with up to k // 2 neighbours of theirs in the graph, at a score of 0.3, that aren't results themselves."""
    near = results.select("query_id", F.col("uid").alias("u")).join(edges, F.col("u") == F.col("src")).select("query_id", F.col("dst").alias("uid"), "edge_id")
    near = near.unionByName(results.select("query_id", F.col("uid").alias("u")).join(edges, F.col("u") == F.col("dst")).select("query_id", F.col("src").alias("uid"), "edge_id"))
    new = near.groupBy("query_id", "uid").agg(F.min("edge_id").alias("edge_id")).join(results.select("query_id", "uid"), ["query_id", "uid"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("edge_id", "uid")
    added = new.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k // 2).select("query_id", "uid", F.lit(0.3).alias("score"))
    return top_k(results.select("query_id", "uid", "score").unionByName(added), ["query_id"], k)


def smart_search(corpus: Corpus, texts: DataFrame, vectors: DataFrame | None = None, sparse: DataFrame | None = None, config: Config | None = None, k: int = 10, within: DataFrame | None = None, rerank=None, edges: DataFrame | None = None) -> DataFrame:
    """Recall by every method, fusion, optionally ``rerank`` (a function from results with texts to a score column), optionally expansion in the graph. All queries in one job; texts are joined after the cut."""
    config = config or Config()
    out = fuse(recall(corpus, texts, vectors, sparse, config, k, within), config, k if rerank is None else max(k, 100))
    if rerank is not None:
        full = out.join(corpus.units.select("uid", "text"), "uid").join(texts, "query_id")
        out = top_k(full.withColumn("score", rerank(F.col("query"), F.col("text"))).select("query_id", "uid", "score"), ["query_id"], k)
    return expand(out, edges, k) if edges is not None else out


def layered(results: DataFrame, layers: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The best of each layer: ``layers`` (``uid, layer``), ``sizes`` of each layer; ``query_id, layer, uid, score, rank``."""
    limit = F.coalesce(*[F.when(F.col("layer") == n, k) for n, k in sizes.items()], F.lit(0))
    return top_k(results.select("query_id", "uid", "score").join(layers, "uid"), ["query_id", "layer"], limit)


def fused_layers(layered_results: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """The best score times layer weight of each unit."""
    w = F.coalesce(*[F.when(F.col("layer") == n, float(v)) for n, v in weights.items()], F.lit(1.0))
    return top_k(layered_results.groupBy("query_id", "uid").agg(F.max(F.col("score") * w).alias("score")), ["query_id"], k)


# Notations of time in results, besides the standard one, in the order in which they are tried.
TIME_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "d MMMM, yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def adapted(rows: DataFrame, ranks: dict[str, str | None]) -> DataFrame:
    """Results (``uid, text, time`` as text, and ranks by method: name -> column, or None) as chunks: ``chunk_id`` (made of the text where there is no uid), ``text, tokens, ts`` (epoch seconds in UTC; 0 if it
    can't be read, the first of January of a year that is all that can), ``entity_ids`` (capitalised phrases and quoted strings), and ranks, 9999 where there are none."""
    stated = F.trim("time")
    # A pattern must fit the whole text; an instant of the standard notation may have a zone.
    standard = F.when(stated.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(stated))
    read = F.coalesce(standard, *[F.try_to_timestamp(stated, F.lit(p)) for p in TIME_PATTERNS])
    year = F.nullif(F.regexp_extract(stated, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    seconds = F.coalesce(F.unix_micros(read) / 1_000_000, F.unix_date(F.make_date(year.cast("int"), F.lit(1), F.lit(1))).cast("double") * 86_400, F.lit(0.0))
    return rows.select(
        F.coalesce(F.nullif("uid", F.lit("")), labels.generated_id(F.col("text"))).alias("chunk_id"), "text", token_estimate(F.col("text")).alias("tokens"), seconds.alias("ts"), labels.title_phrases(F.col("text")).alias("entity_ids"),
        *((F.coalesce(F.col(c), F.lit(9999)) if c else F.lit(9999)).alias(name) for name, c in ranks.items()),
    )


def tower_candidates(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several towers (``query_id, uid, score``) as chunks: scores scaled over the query's candidates (1 if equal), ranks within the tower, positions."""
    union = None
    for tower, df in parts.items():
        x = df.select("query_id", "uid", "score", F.lit(tower).alias("tower"))
        union = x if union is None else union.unionByName(x)
    q = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(q), F.max("score").over(q)
    scaled = union.withColumn("s", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0)).drop("score").withColumnRenamed("s", "score")
    ranked = scaled.withColumn("tower_rank", F.row_number().over(Window.partitionBy("query_id", "tower").orderBy(*by_score("score", "uid"))))
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("tower", "tower_rank")))


def cascade(chunks: DataFrame, max_tokens: int, now: float, max_drops: int | None = None, mode: str = "BUDGET_MAX") -> DataFrame:
    """Chunks pruned in three stages: scores far below the median, what other towers say already, and packing into the budget. ``query_id, chunk_id, place``.
    Chunks are written before they are used several times, and those that are left before they are packed, so that one step's shuffle files are gone in the next."""
    kept = prune.mad_filter(written(chunks, "chunks"))
    judged = prune.disambiguate(prune.arbitration(kept, F.lit(0.0), now), max_drops)
    left = written(judged.where("not dropped").drop("dropped", "reason", "keeper", "arbitration"), "judged")
    return prune.pack_mmr(left, max_tokens, mode=mode)
