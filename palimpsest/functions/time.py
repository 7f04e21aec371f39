"""Time expressions that don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 UTC of a timestamp column; one without a zone is taken to be in UTC."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.expr(f"extract(second from `{name}`)")
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000 + (seconds * 1_000_000).cast("bigint")
