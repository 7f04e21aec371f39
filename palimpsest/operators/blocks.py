"""A lexical index in blocks: few rows that hold the postings of many units, unit after unit."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import STOP_WORDS, WORD

#: Most postings, and units, of a block: numbers within it take two bytes.
BLOCK = 65_536

Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(values)], values)


def coded(values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Different values, sorted, and which of them each is, in two bytes, or four if there are more."""
    different, code = np.unique(values, return_inverse=True)
    return different, code.astype(np.uint16 if len(different) <= BLOCK else np.uint32).tobytes()


def decoded(different: np.ndarray, codes: bytes, n: int) -> np.ndarray:
    return different[np.frombuffer(codes, dtype=np.uint16 if len(codes) == 2 * n else np.uint32)]


def _parts(count: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Units and postings of each block, as first and end: whole units, except where one alone has more postings than a block holds."""
    end = np.cumsum(count)
    start = 0
    while start < len(count):
        before = int(end[start] - count[start])
        if count[start] > BLOCK:
            for p in range(before, int(end[start]), BLOCK):
                yield start, start + 1, p, min(p + BLOCK, int(end[start]))
            start += 1
            continue
        last = min(int(np.searchsorted(end, before + BLOCK, side="right")), start + BLOCK)
        yield start, last, before, int(end[last - 1])
        start = last


_in_jvm: dict[str, np.ndarray] = {}


@functools.cache
def in_words() -> np.ndarray:
    """Of each character, whether it belongs to a word, by Python's own tables."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" or c == ord("_") for c in range(0x110000)])


def _in_words_of(spark: SparkSession) -> np.ndarray:
    """Of each character, whether it belongs to a word for Spark: ``functions.text.WORD`` asked once of the driver's JVM, whose tables may be of another Unicode version than Python's."""
    app = spark.sparkContext.applicationId
    if app not in _in_jvm:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        others = spark._jvm.java.util.regex.Pattern.compile(WORD).matcher(every).replaceAll("")
        found = np.ones(0x110000, dtype=bool)
        found[np.frombuffer(others.encode("utf-32-le"), dtype=np.uint32)] = False
        found[0xD800:0xE000] = False
        _in_jvm[app] = found
    return _in_jvm[app]


def _inside(raw: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether its character belongs to a word."""
    inside = (raw < 0x80) & of_word[raw]
    for least, most, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        at = np.flatnonzero((raw >= least) & (raw < most))
        if len(at):
            code = (raw[at] & (0x3F >> more)).astype(np.int64)
            for i in range(1, more + 1):
                code = code << 6 | (raw[at + i] & 0x3F)
            at = at[of_word[code]]
            for i in range(more + 1):
                inside[at + i] = True
    return inside


def _plain_terms(texts: pa.Array, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of lower-cased texts, as ``functions.text.tokens`` makes them: each one's text, its number among the different terms, and these; none of a null."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), pa.array([], pa.string())
    if data is None or starts[-1] == starts[0]:
        return none
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    inside = _inside(raw, of_word)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = starts[(starts > 0) & (starts < len(raw))]
    first[border], last[border - 1] = inside[border], inside[border - 1]  # a text begins anew
    begin = np.flatnonzero(first)
    if not len(begin):
        return none
    size, head = np.flatnonzero(last) - begin + 1, raw[begin]
    cut = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(cut), pa.py_buffer(raw[inside])).dictionary_encode()
    stop = pc.is_in(words.dictionary, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)
    code = words.indices.to_numpy()
    keep = ~stop[code] & ((size > 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0)) | ((head >= 48) & (head <= 57)))
    return (np.searchsorted(starts, begin[keep], side="right") - 1), code[keep].astype(np.int64), words.dictionary


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of texts sorted by ``uid``, all of one's texts in the same batch, and the number of each text's unit within its batch."""
    held: list[pa.RecordBatch] = []

    def numbered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        return batch, np.append(0, np.cumsum(_changes(batch.column("uid")))).astype(np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[-1].column("uid")[-1] != batch.column("uid")[0]:
            yield numbered(pa.concat_batches(held))
            held = []
        change = np.flatnonzero(_changes(batch.column("uid")))
        if len(change) and held:
            yield numbered(pa.concat_batches([*held, batch.slice(0, change[-1] + 1)]))
            held = [batch.slice(change[-1] + 1)]
        elif len(change):
            yield numbered(batch.slice(0, change[-1] + 1))
            held = [batch.slice(change[-1] + 1)]
        else:
            held.append(batch)
    if held:
        yield numbered(pa.concat_batches(held))


def _changes(uid: pa.Array) -> np.ndarray:
    """Where the next uid is another one."""
    code = uid.dictionary_encode("encode").indices.to_numpy()
    return code[1:] != code[:-1]


def _blocked(batches: Iterator[pa.RecordBatch], packed: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """``packed``: bits of the characters of words."""
    of_word = in_words() if packed is None else np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
    for batch, number in _once(batches):
        owner, code, words = _plain_terms(batch.column("plain"), of_word)
        owner = number[owner]
        begin = pa.array(np.flatnonzero(np.diff(number, prepend=-1)))
        uid, place = (batch.column(c).take(begin) for c in ("uid", "place"))
        length = np.bincount(owner, minlength=len(uid))
        key, tf = np.unique(owner * max(len(words), 1) + code, return_counts=True)
        unit, word = np.divmod(key, max(len(words), 1))
        count = np.bincount(unit, minlength=len(length))
        done = -1
        for a, b, p, q in _parts(count):
            terms, code = np.unique(word[p:q], return_inverse=True)
            tfs, tf_at = coded(tf[p:q])
            again = int(done == a)  # a unit of several blocks is counted as a document in the first
            done = b - 1
            sizes = count[a:b] if b - a > 1 else np.array([q - p])
            columns = [_list(uid.slice(a, b - a)), _list(place.slice(a, b - a)), _list(pa.array(length[a:b], pa.int64())), _list(pa.array(sizes, pa.int32())), pa.array([again], pa.int32()), _list(words.take(pa.array(terms))), _list(pa.array(np.bincount(code, minlength=len(terms)), pa.int32())), _list(pa.array(tfs, pa.int64())), pa.array([code.astype(np.uint16).tobytes()], pa.binary()), pa.array([tf_at], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["uids", "places", "lens", "sizes", "again", "terms", "dfs", "tfs", "term_at", "tf_at"])


def place(uid) -> F.Column:
    """The number by which units are spread over groups, whatever their number."""
    return F.pmod(F.xxhash64(uid), F.lit(2**31 - 1)).cast("int")


def cut(docs: DataFrame) -> DataFrame:
    """Texts (``uid, text``) as ``uid, place, plain``: those of a uid one after the other in the same partition, lower-cased by Spark, whose rules of case these are."""
    together = docs.select("uid", "text").repartition("uid").sortWithinPartitions("uid")
    return together.select("uid", place("uid").alias("place"), F.lower("text").alias("plain"))


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of texts (``uid, text``), each uid one unit, which are cut into terms in Python by Spark's table of characters."""
    kind = docs.schema["uid"].dataType.simpleString()
    schema = f"uids array<{kind}>, places array<int>, lens array<bigint>, sizes array<int>, again int, terms array<string>, dfs array<int>, tfs array<bigint>, term_at binary, tf_at binary"
    packed = np.packbits(_in_words_of(docs.sparkSession)).tobytes()
    return cut(docs).mapInArrow(lambda batches: _blocked(batches, packed), schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of each block, and the unit, the term and the frequency of each posting."""
    for batch in batches:
        for i in range(batch.num_rows):
            lists = {c: batch.column(c)[i].values for c in ("uids", "places", "lens", "terms")}
            sizes, tfs = (batch.column(c)[i].values.to_numpy() for c in ("sizes", "tfs"))
            unit = np.repeat(np.arange(len(sizes)), sizes)
            yield lists, unit, np.frombuffer(batch.column("term_at")[i].as_buffer(), dtype=np.uint16), decoded(tfs, batch.column("tf_at")[i].as_py(), len(unit))


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lists, unit, term, tf in _rows(batches):
        at = pa.array(unit)
        yield pa.RecordBatch.from_arrays([lists["terms"].take(pa.array(term)), lists["uids"].take(at), pa.array(tf), lists["lens"].take(at)], names=["term", "uid", "tf", "len"])


def postings(blocks: DataFrame) -> DataFrame:
    """``term, uid, tf, len``: a row for each posting."""
    kind = blocks.schema["uids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_unrolled, f"term string, uid {kind}, tf bigint, len bigint")


def documents(blocks: DataFrame) -> DataFrame:
    """``uid, len``, each document once."""
    own = lambda c: F.slice(c, F.col("again") + 1, F.size(c)).alias(c)
    return blocks.select(F.explode(F.arrays_zip(own("uids"), own("lens"))).alias("x")).select(F.col("x.uids").alias("uid"), F.col("x.lens").alias("len"))


def frequencies(blocks: DataFrame) -> DataFrame:
    """``term, df``."""
    return blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))


def weighed(batches: Iterator[pa.RecordBatch], asked: pa.Table, weigh: Weigh, groups: int) -> Iterator[pa.RecordBatch]:
    """Postings of the terms ``asked`` (``term, tid``) as ``u, uid, tid, uw``: the unit's group, its id, the term's number, and what ``weigh`` makes of frequency and length."""
    numbers = asked["tid"].to_numpy()
    known = asked["term"].combine_chunks()
    for lists, unit, term, tf in _rows(batches):
        at = pc.fill_null(pc.index_in(lists["terms"], value_set=known), -1).to_numpy(zero_copy_only=False)[term]
        keep = np.flatnonzero(at >= 0)
        if not len(keep):
            continue
        unit = unit[keep]
        uw = weigh(tf[keep].astype(np.float64), lists["lens"].to_numpy()[unit].astype(np.float64))
        u = (lists["places"].to_numpy() % groups)[unit]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), lists["uids"].take(pa.array(unit)), pa.array(numbers[at[keep]], pa.int64()), pa.array(uw)], names=["u", "uid", "tid", "uw"])


def counted(batches: Iterator[pa.RecordBatch], asked: pa.Table) -> Iterator[pa.RecordBatch]:
    """``tid, df``: in how many units of each block the terms ``asked`` occur."""
    numbers, known = asked["tid"].to_numpy(), asked["term"].combine_chunks()
    for batch in batches:
        at = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        keep = at >= 0
        tid, which = np.unique(numbers[at[keep]], return_inverse=True)
        df = np.bincount(which, batch.column("dfs").flatten().to_numpy()[keep], minlength=len(tid)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tid, pa.int64()), pa.array(df)], names=["tid", "df"])


def numbered(batches: Iterator[pa.RecordBatch], asked: pa.Table, shares: int) -> Iterator[pa.RecordBatch]:
    """Units with terms as ``query_id, place, m, tids, qws``: id, place, share, numbers of the terms ``asked`` and their frequencies. A unit of several blocks is as many rows."""
    numbers, known = asked["tid"].to_numpy(), asked["term"].combine_chunks()
    for lists, unit, term, tf in _rows(batches):
        at = pc.index_in(lists["terms"], value_set=known).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(unit, minlength=len(lists["uids"])))), pa.int32())
        columns = [lists["uids"], lists["places"], pa.array(lists["places"].to_numpy() % shares, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (numbers[at[term]], tf))]
        batch = pa.RecordBatch.from_arrays(columns, names=["query_id", "place", "m", "tids", "qws"])
        yield batch.filter(pc.greater(pc.list_value_length(batch.column("tids")), 0))
