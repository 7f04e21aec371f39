"""Queries of the text preparation problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, conversations, names, near_duplicates, packing, splitting, toxicity
from palimpsest.sources.tables import path, table


#: Statement of problem 1: alike from six tenths of all words on.
FACT_SIMILARITY = 0.6


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.Duplicates(table(spark, folder, "episodic_facts"), FACT_SIMILARITY).pairs()


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.Duplicates(table(spark, folder, "episodic_facts"), FACT_SIMILARITY).groups()


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild_conversations(spark, path(folder, "memory_units"), table(spark, folder, "chat_samples"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_turns(spark, folder).select("session_id", "turn_no", "uid")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_units(table(spark, folder, "memory_units"), table(spark, folder, "chat_samples"), table(spark, folder, "orchestrator_configs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    # Every oversized unit has a first piece, and one only.
    return p4_pieces(spark, folder).where("piece_no = 1").select("uid")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.same_pairs(table(spark, folder, "extracted_entities"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_entities(table(spark, folder, "extracted_entities"))


def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_profiles"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(p8_assignment(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each document's ids."""
    return bpe.decode_column(p7_ids(spark, folder), "doc_id", "ids", "byte_bpe_50k")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(p9_scores(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p3_found, p3_turns, p4_found, p4_pieces, p6_found, p6_groups, p7_ids, p7_round_trip, p8_assignment, p8_report, p9_found, p9_scores, p9_rates)
}
