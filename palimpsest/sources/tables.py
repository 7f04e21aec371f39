"""Named parquet tables in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings memory_units activity_log "
    "extracted_entities entity_mentions episodic_facts chat_samples orchestrator_configs pack_profiles doc_labels"
).split()


def path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: a parquet file or a folder of them."""
    return spark.read.parquet(path(folder, name))
