"""BM25 over an inverted index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators import blocks
from palimpsest.operators.products import Method, best_in_blocks, best_products
from palimpsest.operators.ranking import top_k
from palimpsest.session import brief_shuffles, shared_path, ship, written


@dataclass
class Index:
    """``postings`` (term, uid, tf, len), ``documents`` (uid, len), ``frequencies`` (term, df) and one row of ``totals`` (n, avgdl)."""

    postings: DataFrame
    documents: DataFrame
    frequencies: DataFrame
    totals: DataFrame
    #: ``uid, text``: the documents' texts, where the index is made of texts.
    texts: DataFrame | None = None
    #: The stored index of texts in blocks, of which the tables are made where they are needed as rows.
    blocks: DataFrame | None = None

    def save(self, folder: str) -> None:
        """Write the index. Postings are sorted by term in each file, so that a search for few terms reads few row groups."""
        self.postings.sortWithinPartitions("term").write.parquet(f"{folder}/postings")
        for name in ("documents", "frequencies", "totals"):
            getattr(self, name).write.parquet(f"{folder}/{name}")

    def stored(self) -> Index:
        """The index written to the shared folder and read from there. One of texts is written as blocks, each text read once and no posting made a row of Spark; of another,
        documents are written among the postings, as rows without a term, so that both are made by one pass. Then what is counted from them."""
        folder, spark = shared_path(self.postings.sparkSession, "index"), ship(self.postings.sparkSession)
        with brief_shuffles(spark):
            if self.texts is not None:
                made = blocks.blocks_of(self.texts)
                made.write.parquet(f"{folder}/rows")
                kept = spark.read.schema(made.schema).parquet(f"{folder}/rows")
                documents = blocks.documents(kept)
                _totals(documents).write.parquet(f"{folder}/totals")
                return Index(blocks.postings(kept), documents, blocks.frequencies(kept), spark.read.parquet(f"{folder}/totals"), blocks=kept)
            rows = self.postings.select("term", "uid", "tf", "len").unionByName(self.documents.select(F.lit(None).cast("string").alias("term"), "uid", F.lit(1).cast("bigint").alias("tf"), "len"))
            rows.sortWithinPartitions("term").write.parquet(f"{folder}/rows")
            counted = _counted(*_apart(spark.read.parquet(f"{folder}/rows")))
            for name in ("frequencies", "totals"):
                getattr(counted, name).write.parquet(f"{folder}/{name}")
        return Index(counted.postings, counted.documents, spark.read.parquet(f"{folder}/frequencies"), spark.read.parquet(f"{folder}/totals"))


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "documents", "frequencies", "totals")))


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings, and the documents that stand among them as rows without a term."""
    return rows.where("term is not null"), rows.where("term is null").select("uid", "len")


def _counted(postings: DataFrame, documents: DataFrame) -> Index:
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings, documents, frequencies, _totals(documents))


def _totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("n"), F.sum("len").cast("double").alias("total")).select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl"))


def build_index(units: DataFrame, uid: str = "uid", text: str = "text") -> Index:
    """The index of units; those without a term are documents all the same. A repeated uid is one unit with all its terms; a null uid is none. Units
    are shuffled once, by uid, as texts, which take less room than their terms."""
    texts = units.select(F.col(uid).alias("uid"), F.col(text).alias("text")).where("uid is not null")
    docs = texts.groupBy("uid").agg(F.collect_list("text").alias("texts")).select("uid", F.flatten(F.transform("texts", tokens)).alias("terms"))
    rows = docs.select("uid", F.size("terms").cast("bigint").alias("len"), F.explode("terms").alias("term")).groupBy("uid", "term", "len").agg(F.count("*").alias("tf")).select("term", "uid", "tf", "len")
    index = _counted(rows, docs.select("uid", F.size("terms").cast("bigint").alias("len")))
    index.texts = texts
    return index


def remove_documents(index: Index, uids: DataFrame) -> Index:
    """The index without the given uids (``uid``); unknown ones are skipped. Frequencies lose what the removed postings counted."""
    gone = uids.select("uid").distinct()
    left = index.frequencies.select("term", "df").unionByName(index.postings.join(gone, "uid", "left_semi").groupBy("term").agg((-F.count("*")).alias("df")))
    documents = index.documents.join(gone, "uid", "left_anti")
    return Index(index.postings.join(gone, "uid", "left_anti"), documents, left.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), _totals(documents))


def add_documents(index: Index, units: DataFrame, uid: str = "uid", text: str = "text") -> Index:
    """The index with more units; one whose uid is known takes the old one's place. Frequencies are counted for the new postings only."""
    new = build_index(units, uid, text)
    kept = remove_documents(index, new.documents)
    frequencies = kept.frequencies.unionByName(new.frequencies).groupBy("term").agg(F.sum("df").alias("df"))
    documents = kept.documents.unionByName(new.documents)
    return Index(kept.postings.unionByName(new.postings), documents, frequencies, _totals(documents))


def bm25(index: Index, queries: DataFrame, k: int, candidates: DataFrame | None = None, query_id: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, uid, score, rank``: the k best units of every query, all queries in one job.

    A term counts as often as it occurs in the query. ``candidates`` (``uid``, or ``query_id, uid``) restricts what is
    found, not the statistics, which are of the whole corpus; an empty one finds nothing. Scores up to 1e-6 are dropped.
    An index in blocks is searched as it is; of another, postings of other terms than the queries' are left out before anything is shuffled, and frequencies are joined to the queries' terms, not to the postings.
    Pairs of candidates by query are scored one by one; else every query meets every unit in blocks.
    """
    if index.blocks is not None and (candidates is None or "query_id" not in candidates.columns):
        found = search(index, queries, [("bm25", k)], candidates, query_id, query, k1, b)
        if found is not None:
            return found[0]
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    n, avgdl = index.totals.select("n", "avgdl").first()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asked = written(asked.join(index.frequencies, "term").select("query_id", "term", (F.col("qtf") * idf).alias("qw")), "query-terms")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avgdl))
    postings = index.postings.select("uid", "term", (F.col("tf") * (k1 + 1) / norm).alias("uw"))
    if candidates is None or "query_id" not in candidates.columns:
        weigh = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
        return best_products(asked, postings, int(n * avgdl), k, 1e-6, candidates, index.blocks, weigh)
    wanted = candidates.select("query_id", "uid").distinct()
    scored = postings.join(wanted, "uid").join(asked, ["query_id", "term"]).groupBy("query_id", "uid").agg(F.sum(F.col("qw") * F.col("uw")).alias("score"))
    return top_k(scored.where("score > 1e-6"), ["query_id"], k)


def search(index: Index, queries: DataFrame, wanted: list[tuple[str, int]], candidates: DataFrame | None = None, query_id: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> list[DataFrame] | None:
    """The results of several methods over an index in blocks, all from one meeting of queries and units: ``wanted`` are names, "bm25" or "sparse" (the dot product of weights 1 + ln(tf)), and k. None if there are too many different terms."""
    n, avgdl = index.totals.select("n", "avgdl").first()
    log = lambda tf, _: 1 + np.log(tf)
    ways = {
        "bm25": (1e-6, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl)), lambda tf, df: tf * np.log((n - df + 0.5) / (df + 0.5) + 1)),
        "sparse": (0.0, log, log),
    }
    texts = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("text"))
    return best_in_blocks(index.blocks, texts, int(n * avgdl), [Method(k, *ways[name]) for name, k in wanted], candidates)


def keyword_scores(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Overlap of term sets over the root of the product of their sizes, plus a half if the text contains the query;
    rounded to four decimals. ``query_id, uid, score, rank``."""
    u = units.select("uid", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.array_distinct(tokens(F.col("text"))).alias("ut"))
    q = queries.select("query_id", F.lower("query").alias("qlow"), F.array_distinct(tokens(F.col("query"))).alias("qt"))
    pairs = q.withColumn("term", F.explode("qt")).join(u.withColumn("term", F.explode("ut")), "term").groupBy("query_id", "uid").agg(F.count("*").alias("overlap"))
    full = pairs.join(q.select("query_id", "qlow", F.size("qt").alias("nq")), "query_id").join(u.select("uid", "low", F.size("ut").alias("nu")), "uid")
    score = F.round(F.col("overlap") / F.sqrt(F.col("nq") * F.col("nu")) + F.when(F.contains("low", "qlow"), 0.5).otherwise(0.0), 4)
    return top_k(full.select("query_id", "uid", score.alias("score")), ["query_id"], k)
