"""Long texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import ship

#: Where a piece may end, from the strongest boundary to the weakest: after the match. Characters come last, without a pattern.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n(?=#{1,6} )|\n[-=*_]{3,}[ \t]*\n|\f",  # sections
        r"\r?\n[ \t]*(?:\r?\n[ \t]*)+",  # paragraphs
        r"\n",  # lines
        r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*|[؟۔।]+\s*",  # sentences
        r"[;:,、，；：]\s+|[、，；：]",  # clauses
        r"\s+",  # words
    )
)
PIECES = "uid string, piece_no int, start int, end int, piece string"


def _leaves(text: str, limit: int) -> Iterator[tuple[int, int, bool]]:
    """Consecutive spans of at most ``limit`` characters, each cut at the strongest boundary that does; and, marked so,
    longer ones without a boundary, which may be cut anywhere."""
    todo = [(0, len(text), 0)]
    cuts: list[list[int] | None] = [None] * len(LEVELS)
    while todo:
        start, end, level = todo.pop()
        if end - start <= limit:
            yield start, end, False
        elif level == len(LEVELS):
            yield start, end, True
        else:
            if cuts[level] is None:
                cuts[level] = [m.end() for m in LEVELS[level].finditer(text)]
            at = cuts[level]
            inner = at[bisect_left(at, start + 1) : bisect_left(at, end)]
            edges = [start, *inner, end]
            todo += [(a, b, level + 1) for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True)]


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """The spans of the pieces of a text: none longer than ``size``, each after the first beginning
    ``overlap`` characters before its predecessor's end, together covering the text.

    A recursive hierarchy (section, paragraph, line, sentence, clause, word, character) gives spans of at
    most ``size - overlap`` characters, and these are packed greedily. The overlap is held between 0 and
    ``size - 1``. An empty text has no piece.
    """
    overlap = max(0, min(overlap, size - 1))
    out: list[tuple[int, int]] = []
    start = end = 0
    for _, b, anywhere in _leaves(text, size - overlap):
        while b - start > size:
            if anywhere:
                end = start + size
            out.append((start, end))
            start = end - overlap
        end = b
    if end > 0:
        out.append((start, end))
    return out


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (uid, i, a, b, text[a:b])
            for uid, text, size, overlap in zip(batch["uid"], batch["text"], batch["size"], batch["overlap"], strict=True)
            for i, (a, b) in enumerate(split_text(text, int(size), int(overlap)), 1)
        ]
        yield pd.DataFrame(rows, columns=["uid", "piece_no", "start", "end", "piece"])


def oversized(units: DataFrame, samples: DataFrame, configs: DataFrame) -> DataFrame:
    """``uid, text, size, overlap`` of the units longer than their configuration's ``chunk_size``, in code
    points, each uid once. Units without a uid, text or configuration are none; a null overlap is 0."""
    limits = (
        samples.select("sample_id", "config_id").dropna().dropDuplicates(["sample_id"])
        .join(configs.where("chunk_size >= 1").select("config_id", F.col("chunk_size").alias("size"), F.coalesce("chunk_overlap", F.lit(0)).alias("overlap")).dropDuplicates(["config_id"]), "config_id")
        .drop("config_id")
    )
    long = units.select("uid", "sample_id", F.col("text_content").alias("text"), F.length("text_content").alias("_n")).where("uid is not null").join(limits, "sample_id").where("_n > size")
    return long.select("uid", "text", "size", "overlap").dropDuplicates(["uid"])


def split_units(units: DataFrame, samples: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces ``uid, piece_no, start, end, piece`` of every oversized unit (see ``split_text``); offsets
    count code points of the text as stored."""
    ship(units.sparkSession)
    return oversized(units, samples, configs).mapInPandas(_split_batches, PIECES)
