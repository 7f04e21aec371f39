"""Labels told from metadata and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def layer(metadata: Column, uid: Column) -> Column:
    """l0, l1 or l2: what the metadata says, else what the id begins with or contains, else l0."""
    said = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("layer")), F.try_element_at(metadata, F.lit("memory_layer"))))
    low = F.lower(uid.cast("string"))
    return F.when(said.rlike("l?[012]$"), F.concat(F.lit("l"), F.substring(said, -1, 1))).when(low.rlike("(^|[_:])l2([_:]|$)|insight"), "l2").when(low.rlike("(^|[_:])l1([_:]|$)|summary|digest"), "l1").otherwise("l0")


def time_text(*fields: Column) -> Column:
    """The first of several time fields that isn't blank."""
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields])


def title_phrases(text: Column) -> Column:
    """Capitalised phrases of several words and quoted strings of 2 to 50 characters, each once."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), 0), F.regexp_extract_all(t, F.lit('"([^"\n]{2,50})"'), 1)))


def generated_id(text: Column) -> Column:
    """An id made from a text."""
    return F.concat(F.lit("gen_"), F.substring(F.md5(text), 1, 10))
