"""Deferred writes: a stream of units merged into a stored table in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.units import upsert
from palimpsest.sources.store import read_version, write_version


def merge_stream(spark: SparkSession, requests: DataFrame, store: str, checkpoint: str, order: str, every: str | None = None):
    """Merge a stream of units into the versioned table at ``store``, one version a micro-batch; a repeated batch writes its version again, so
    each request counts once. Returns the started query; without ``every`` it ends when what is there has been merged."""

    def merge(batch: DataFrame, number: int) -> None:
        before = read_version(spark, store, before=f"batch-{number:012d}")
        write_version(upsert(before, batch, order) if before is not None else upsert(batch.limit(0), batch, order), store, f"batch-{number:012d}")

    writer = requests.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
