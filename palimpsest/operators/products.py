"""Exact best scores of sparse products: queries' term weights times units' term weights, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.blocks import Weigh, blocks_of, coded, counted, decoded, numbered, place, weighed
from palimpsest.operators.ranking import top_k
from palimpsest.session import bounded_broadcast, setting, ship, written

#: Most rows of terms that are sent to the postings; more are joined by shuffling both.
TERMS = 300_000
#: Postings, and queries, that one task holds; smaller groups are made only to occupy every core.
GROUP_POSTINGS, LEAST_POSTINGS, GROUP_QUERIES = 3_000_000, 50_000, 65_536
#: Postings that a task holds while it packs them by group, and most in a row: numbers within a row take two bytes.
PACK, PACKED = 1_000_000, 65_536
#: Units and queries whose scores are in memory at once.
UNITS, QUERIES = 32_768, 128
#: Terms that this share of a block's units have, at most so many, are multiplied as a dense matrix.
DENSE_SHARE, DENSE_TERMS = 1 / 16, 256
#: Shares of the queries in which the groups' results are merged.
SHARES = 48
#: Scores that differ by less may be equal at nine decimals.
NEAR = 2e-9
#: Bits of a unit's length in the number that stands for it and a frequency.
LENGTH_BITS = 31


@dataclass(frozen=True)
class Method:
    """A way of scoring: the ``k`` best units above ``least`` by weights that ``unit`` makes of a term's frequency and the unit's length, and ``query`` of its frequency in the query and the number of units that have it."""

    k: int
    least: float
    unit: Weigh
    query: Weigh


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Integers of which Spark's hash partitioning into n puts one into each partition."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < n:
        ids = spark.range(start, start + 64 * n, numPartitions=1).select(F.col("id").cast("int").alias("i"))
        for i, place in ids.select("i", F.pmod(F.hash("i"), F.lit(n))).collect():
            found.setdefault(place, i)
        start += 64 * n
    return [found[i] for i in range(n)]


def _pack(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Postings (``u, uid, tid, uw``) as few rows for each group ``u``: different units, terms and weights, and for each posting their numbers."""
    rows = rows.combine_chunks()
    u, tid, uw = (rows[c].to_numpy() for c in ("u", "tid", "uw"))
    order = np.argsort(u, kind="stable")
    begin = np.flatnonzero(np.diff(u[order], prepend=-1))
    for a, b in zip(begin, [*begin[1:], len(u)]):
        for start in range(a, b, PACKED):
            at = order[start : min(start + PACKED, b)]
            uid = rows["uid"].take(pa.array(at)).combine_chunks()
            uid = (uid if isinstance(uid, pa.Array) else pa.concat_arrays(uid.chunks)).dictionary_encode("encode")
            (terms, term), (weights, weight) = coded(tid[at]), coded(uw[at])
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (uid.dictionary, pa.array(terms), pa.array(weights))]
            codes = [pa.array([x], pa.binary()) for x in (uid.indices.to_numpy().astype(np.uint16).tobytes(), term, weight)]
            yield pa.RecordBatch.from_arrays([pa.array([u[at[0]]], pa.int32()), *lists, *codes], names=["u", "uids", "terms", "weights", "uid_at", "term_at", "weight_at"])


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= PACK:
            yield from _pack(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _pack(pa.Table.from_batches(held))


def _unpacked(rows: pa.Table, restricted: bool = False) -> pa.Table:
    """The postings (``uid, tid, uw``) of packed rows. ``restricted``: only of units in rows without postings."""
    kind = rows.schema.field("uids").type.value_type
    is_list = rows["uid_at"].is_null()
    packed, listed = rows.filter(pc.invert(is_list)), rows.filter(is_list)
    schema = pa.schema([("uid", kind), ("tid", pa.int64()), ("uw", pa.float64())])
    if not packed.num_rows or restricted and not listed.num_rows:
        return schema.empty_table()

    def values(column: str, codes: str) -> tuple[pa.Array, np.ndarray]:
        lists = packed[column].combine_chunks()
        before = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return lists.flatten(), np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16).astype(np.int64) + n for x, n in zip(packed[codes], before)])

    uids, at = values("uids", "uid_at")
    coded = uids.dictionary_encode("encode")
    unit, ids = coded.indices.to_numpy()[at], coded.dictionary
    (terms, term), (weights, weight) = values("terms", "term_at"), values("weights", "weight_at")
    term, weight = terms.to_numpy()[term], weights.to_numpy()[weight]
    if restricted:
        allowed = pc.is_in(ids, value_set=listed["uids"].combine_chunks().flatten(), skip_nulls=True).to_numpy(zero_copy_only=False)
        keep = allowed[unit]
        unit, term, weight, ids = (np.cumsum(allowed) - 1)[unit[keep]], term[keep], weight[keep], ids.filter(pa.array(allowed))
        if not len(unit):
            return schema.empty_table()
    return pa.table({"uid": pa.DictionaryArray.from_arrays(pa.array(unit.astype(np.int32)), ids), "tid": term, "uw": weight})


def _cut(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k best, all that may be equal to the last of them at nine decimals, and the k-th score. Where these surely are equal, those of the first ids suffice."""
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    keep = scores >= kth - NEAR
    scores, ids = scores[keep], ids[keep]
    if len(scores) > 2 * k:
        tied = scores <= kth + NEAR
        scaled = scores[tied] * 1e9
        whole = np.rint(scaled)
        if (whole == whole[0]).all() and (np.abs(scaled - whole) < 0.49).all():
            first = np.sort(ids[tied])[k - 1]
            keep = ~tied | (ids <= first)
            scores, ids = scores[keep], ids[keep]
    return scores, ids, kth


def _block(n: int, unit: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Terms of a block of n units, sorted, the first posting and number of postings of each (none for dense terms), units and weights by term, the dense terms' numbers and their matrix."""
    order = np.argsort(term, kind="stable")
    terms, begin, count = np.unique(term[order], return_index=True, return_counts=True)
    unit, weight = unit[order], weight[order]
    dense = np.flatnonzero(count >= max(n * DENSE_SHARE, 2))
    dense = dense[np.argsort(-count[dense], kind="stable")[:DENSE_TERMS]]
    matrix = np.zeros((len(dense), -(-n // 64) * 64))
    for row, t in enumerate(dense):
        at = slice(begin[t], begin[t] + count[t])
        np.add.at(matrix[row], unit[at], weight[at])
    count[dense] = 0
    return terms, begin, count, unit, weight, dense, matrix


def _best(k: int, least: float, units: pa.Table, queries: pa.Table) -> pa.Table:
    """The k best units of this group for each of the queries, with those that may be equal to the last."""
    kind = units.schema.field("uid").type
    schema = pa.schema([("query_id", queries.schema.field("query_id").type), ("uid", kind.value_type if pa.types.is_dictionary(kind) else kind), ("score", pa.float64())])
    if not (units.num_rows and queries.num_rows):
        return schema.empty_table()
    coded = units["uid"].combine_chunks()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    uids, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))  # units are numbered in the order of their ids
    unit, term, weight = place[coded.indices.to_numpy()], units["tid"].to_numpy(), units["uw"].to_numpy()
    lists = [queries[c].combine_chunks() for c in ("tids", "qws")]
    offset = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())])
    asked, asked_weight = (x.flatten().to_numpy() for x in lists)
    nq = queries.num_rows
    kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * nq
    theta = np.full(nq, -np.inf)
    lowest = np.nextafter(least, np.inf)

    for base in range(0, len(uids), UNITS):
        n = min(UNITS, len(uids) - base)
        inside = slice(None) if n == len(uids) else (unit >= base) & (unit < base + n)
        terms, begin, count, by_term, weights, dense, matrix = _block(n, unit[inside] - base, term[inside], weight[inside])
        width = matrix.shape[1]
        at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        known = terms[at] == asked
        first, length = begin[at], np.where(known, count[at], 0)
        column = np.full(len(terms), -1)
        column[dense] = np.arange(len(dense))
        column = np.where(known, column[at], -1)
        out = np.empty((QUERIES, width))
        for q0 in range(0, nq, QUERIES):
            m = min(QUERIES, nq - q0)
            span = slice(offset[q0], offset[q0 + m])
            of_query = np.repeat(np.arange(m), np.diff(offset[q0 : q0 + m + 1]))
            factors = np.zeros((m, len(dense)))
            hit = column[span] >= 0
            np.add.at(factors, (of_query[hit], column[span][hit]), asked_weight[span][hit])
            np.matmul(factors, matrix, out=out[:m])
            for i in range(m):
                q, row = q0 + i, out[i]
                mine = np.flatnonzero(length[offset[q] : offset[q + 1]]) + offset[q]
                if len(mine):
                    parts = [slice(s, s + c) for s, c in zip(first[mine].tolist(), length[mine].tolist())]
                    w = np.concatenate([weights[p] for p in parts])
                    w *= np.repeat(asked_weight[mine], length[mine])
                    row += np.bincount(np.concatenate([by_term[p] for p in parts]), w, minlength=width)
                bound = theta[q]
                if bound == -np.inf and width >= 64 * k:
                    # The k-th of the greatest of parts isn't above the k-th of all.
                    top = row.reshape(64, -1).max(axis=0)
                    bound = np.partition(top, len(top) - k)[len(top) - k]
                found = np.flatnonzero(row >= max(bound - NEAR, lowest))
                if len(found):
                    scores, ids = row[found], found + base
                    if kept[q] is not None:
                        scores, ids = np.concatenate([kept[q][0], scores]), np.concatenate([kept[q][1], ids])
                    if len(scores) >= k:
                        scores, ids, theta[q] = _cut(scores, ids, k)
                    kept[q] = scores, ids
    some = [q for q in range(nq) if kept[q] is not None]
    if not some:
        return schema.empty_table()
    of = np.repeat(some, [len(kept[q][0]) for q in some])
    ids = queries["query_id"].combine_chunks().take(pa.array(of))
    return pa.table([ids, uids.take(pa.array(np.concatenate([kept[q][1] for q in some]))), pa.array(np.concatenate([kept[q][0] for q in some]))], schema=schema)


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (``query_id, m, tids, qws``) as few rows: the queries' ids, shares of the merging and numbers of terms; different terms and weights, and for each term of each query their numbers."""
    for batch in batches:
        length = pc.list_value_length(batch.column("tids")).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(length)
        start = 0
        while start < len(length):
            stop = max(start + 1, int(np.searchsorted(end, end[start] - length[start] + PACKED, side="right")))
            part = batch.slice(start, stop - start)
            (terms, term), (weights, weight) = (coded(part.column(c).flatten().to_numpy()) for c in ("tids", "qws"))
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (part.column("query_id"), part.column("m"), pa.array(length[start:stop], pa.int32()), pa.array(terms), pa.array(weights))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([term], pa.binary()), pa.array([weight], pa.binary())], names=["query_ids", "ms", "sizes", "terms", "weights", "term_at", "weight_at"])
            start = stop


def _unpacked_queries(rows: pa.Table) -> pa.Table:
    """``query_id, m, tids, qws`` of packed rows."""
    parts = []
    for i in range(rows.num_rows):
        sizes = rows["sizes"][i].values.to_numpy()
        n, offsets = int(sizes.sum()), pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(decoded(rows[c][i].values.to_numpy(), rows[codes][i].as_py(), n))) for c, codes in (("terms", "term_at"), ("weights", "weight_at"))]
        parts.append(pa.table([rows["query_ids"][i].values, rows["ms"][i].values, *lists], names=["query_id", "m", "tids", "qws"]))
    return pa.concat_tables(parts)


def _pack_found(found: pa.Table, queries: pa.Table) -> pa.Table:
    """Results (``query_id, uid, score``, in the order of the queries) as a row for each share of the merging."""
    ids = found["query_id"].combine_chunks()
    share = queries["m"].to_numpy()[pc.index_in(ids, value_set=queries["query_id"].combine_chunks()).to_numpy(zero_copy_only=False)]
    order = np.argsort(share, kind="stable")
    ms, begin = np.unique(share[order], return_index=True)
    offsets = pa.array(np.append(begin, len(order)), pa.int32())
    at = pa.array(order)
    return pa.table([pa.array(ms, pa.int32()), *(pa.ListArray.from_arrays(offsets, found[c].combine_chunks().take(at)) for c in ("query_id", "uid", "score"))], names=["m", "query_ids", "uids", "scores"])


def _merged(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of what the groups found, the k best for each query and all that may be equal to the last at nine decimals."""

    def run(rows: pa.Table) -> pa.Table:
        ids, uids, scores = (pa.concat_arrays([x.flatten() for x in rows[c].chunks]) for c in ("query_ids", "uids", "scores"))
        value, query = scores.to_numpy(), ids.dictionary_encode("encode").indices.to_numpy()
        order = np.lexsort((-value, query))
        value, query = value[order], query[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        count = np.diff(np.append(begin, len(query)))
        last = np.repeat(value[begin + np.minimum(count, k) - 1], count)
        at = pa.array(order[value >= last - NEAR])
        return pa.table([ids.take(at), uids.take(at), scores.take(at)], names=["query_id", "uid", "score"])

    return run


def best_products(asked: DataFrame, postings: DataFrame, size: int, k: int, least: float, within: DataFrame | None = None, blocks: DataFrame | None = None, weigh: Weigh | None = None) -> DataFrame:
    """``query_id, uid, score, rank``: the k units of the greatest sums over shared terms of ``asked`` (``query_id, term, qw``) times ``postings`` (``uid, term, uw``), of those above ``least``, written to the shared folder.
    ``within`` (``uid``) restricts what is found. ``blocks`` has the postings in blocks, if there are any; ``weigh`` makes weights of their frequencies and lengths.

    Exact: every pair's sum is made in double precision, none is left out beforehand. Weights must be positive. Units are spread over groups by hash and every group meets
    all queries in one task (beyond 65,536 queries, groups of them): scores stay in its memory, terms of many units are multiplied as matrices, others added posting by
    posting, and only k rows a query and group are shuffled. Postings, queries and results are shuffled packed, a few bytes each, and the units of ``within`` beside them. ``size`` is about the number of postings.
    """
    spark = ship(asked.sparkSession)
    terms = written(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    near = bounded_broadcast(terms, TERMS)
    cores = spark.sparkContext.defaultParallelism
    ug = max(1, -(-size // GROUP_POSTINGS), min(cores, -(-size // LEAST_POSTINGS)))
    kinds = (asked.schema["query_id"].dataType.simpleString(), postings.schema["uid"].dataType.simpleString())
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    listed = asked.join(near, "term").groupBy("query_id").agg(F.collect_list(F.struct("tid", "qw")).alias("x")).select("query_id", hashed("query_id", SHARES).alias("m"), F.col("x.tid").alias("tids"), F.col("x.qw").alias("qws"))
    packed_query = f"query_ids array<{kinds[0]}>, ms array<int>, sizes array<int>, terms array<bigint>, weights array<double>, term_at binary, weight_at binary"
    qg = max(1, -(-asked.select("query_id").distinct().count() // GROUP_QUERIES))
    queries = written(listed.select("*", hashed("query_id", qg).alias("q")).mapInArrow(_packing_queries, f"q int, {packed_query}"), "queries")
    keys = F.array(*[F.lit(i) for i in _keys(spark, ug * qg)])
    group = lambda u, q: F.element_at(keys, (u * qg + q + 1).cast("int")).alias("g")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit_group = lambda c: F.pmod(place(c), F.lit(ug)).cast("int").alias("u")
    packed_unit = f"u int, uids array<{kinds[1]}>, terms array<bigint>, weights array<double>, uid_at binary, term_at binary, weight_at binary"
    if blocks is not None and near is not terms:
        known = spark.sparkContext.broadcast(terms.toArrow())
        packed = blocks.mapInArrow(_weighing(known, weigh, ug), packed_unit)
    else:
        packed = postings.join(near, "term").select(unit_group("uid"), "uid", "tid", F.col("uw").cast("double").alias("uw")).mapInArrow(_packing, packed_unit)
    if within is not None:
        allowed = within.select(F.col("uid").cast(kinds[1]).alias("uid")).where("uid is not null")
        packed = packed.unionByName(allowed.select(unit_group("uid"), F.array("uid").alias("uids")), allowMissingColumns=True)
    left = packed.select("*", spread(qg).alias("q")).withColumn("g", group(F.col("u"), F.col("q"))).drop("u", "q")
    right = queries.select("*", spread(ug).alias("u")).withColumn("g", group(F.col("u"), F.col("q"))).drop("u", "q")
    run = _matching(k, least, within is not None)
    # One group a partition: keys are chosen for as many partitions as groups, which are not put together again.
    with setting(spark, spark__sql__shuffle__partitions=str(ug * qg), spark__sql__adaptive__coalescePartitions__enabled="false"):
        found = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(run, f"m int, query_ids array<{kinds[0]}>, uids array<{kinds[1]}>, scores array<double>")
        merged = found.groupBy("m").applyInArrow(_merged(k), f"query_id {kinds[0]}, uid {kinds[1]}, score double")
        return written(top_k(merged, ["query_id"], k), "found")


def _packing_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q = batch.column("q").to_numpy()
        for g in np.unique(q):
            for row in _pack_queries(iter([batch.filter(pa.array(q == g))])):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *row.columns], names=["q", *row.schema.names])


def _weighing(known, weigh: Weigh, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _packing(weighed(batches, known.value, weigh, groups))


def _matching(k: int, least: float, restricted: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(units: pa.Table, packed: pa.Table) -> pa.Table:
        if not (units.num_rows and packed.num_rows):
            kinds = units.schema.field("uids").type, packed.schema.field("query_ids").type
            return pa.schema([("m", pa.int32()), ("query_ids", kinds[1]), ("uids", kinds[0]), ("scores", pa.list_(pa.float64()))]).empty_table()
        wanted = _unpacked_queries(packed)
        return _pack_found(_best(k, least, _unpacked(units, restricted), wanted), wanted)

    return run


def best_in_blocks(stored: DataFrame, queries: DataFrame, size: int, methods: list[Method], within: DataFrame | None = None) -> list[DataFrame] | None:
    """For each method ``query_id, uid, score, rank`` as ``best_products`` gives it, of texts as queries (``query_id, text``) over ``stored`` blocks of about ``size`` postings. None if the queries have too many terms to be sent to every task.

    Queries become blocks as well, so that no term of theirs is a row of Spark but in the list of different terms. Units and queries are shuffled once for all methods, with
    frequencies and lengths instead of weights, and every method's weights are made of them where they meet.
    """
    spark = ship(stored.sparkSession)
    asked = written(blocks_of(queries.select(F.col("query_id").alias("uid"), "text")), "query-blocks")
    terms = written(asked.select(F.explode("terms").alias("term")).distinct(), "terms")
    if bounded_broadcast(terms, TERMS) is terms:
        return None
    words = terms.toArrow()["term"]
    known = spark.sparkContext.broadcast(pa.table([words, pa.array(np.arange(len(words)))], names=["term", "tid"]))
    counts = stored.select("terms", "dfs").mapInArrow(lambda batches: counted(batches, known.value), "tid bigint, df bigint").groupBy("tid").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[counts["tid"].to_numpy()] = counts["df"].to_numpy()
    dfs = spark.sparkContext.broadcast(df)
    ug = max(1, -(-size // GROUP_POSTINGS), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_POSTINGS)))
    qg = max(1, -(-(asked.agg(F.sum(F.size("uids"))).first()[0] or 0) // GROUP_QUERIES))
    kinds = tuple(x.schema["uids"].dataType.elementType.simpleString() for x in (asked, stored))
    packed_query = f"q int, query_ids array<{kinds[0]}>, ms array<int>, sizes array<int>, terms array<bigint>, weights array<bigint>, term_at binary, weight_at binary"
    packed_unit = f"u int, uids array<{kinds[1]}>, terms array<bigint>, weights array<bigint>, uid_at binary, term_at binary, weight_at binary"
    right = asked.mapInArrow(_numbering(known, qg), packed_query)
    left = stored.mapInArrow(_weighing(known, _one_number, ug), packed_unit)
    if within is not None:
        allowed = within.select(F.col("uid").cast(kinds[1]).alias("uid")).where("uid is not null")
        left = left.unionByName(allowed.select(F.pmod(place("uid"), F.lit(ug)).cast("int").alias("u"), F.array("uid").alias("uids")), allowMissingColumns=True)
    keys = F.array(*[F.lit(i) for i in _keys(spark, ug * qg)])
    meeting = lambda df, n, other: df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)).withColumn("g", F.element_at(keys, (F.col("u") * qg + F.col("q") + 1).cast("int"))).drop("u", "q")
    run = _matching_methods(dfs, methods, within is not None)
    with setting(spark, spark__sql__shuffle__partitions=str(ug * qg), spark__sql__adaptive__coalescePartitions__enabled="false"):
        found = meeting(left, qg, "q").groupBy("g").cogroup(meeting(right, ug, "u").groupBy("g")).applyInArrow(run, f"m int, query_ids array<{kinds[0]}>, uids array<{kinds[1]}>, scores array<double>")
        merged = found.groupBy("m").applyInArrow(_merged_methods([x.k for x in methods]), f"method int, query_id {kinds[0]}, uid {kinds[1]}, score double")
        best = written(top_k(merged, ["method", "query_id"], max(x.k for x in methods)), "found")
    return [best.where((F.col("method") == i) & (F.col("rank") <= x.k)).drop("method") for i, x in enumerate(methods)]


def _one_number(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return tf.astype(np.int64) << LENGTH_BITS | length.astype(np.int64)


def _numbering(known, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in numbered(batches, known.value, SHARES):
            q = pa.array(x.column("place").to_numpy() % groups, pa.int32())
            yield from _packing_queries(iter([x.append_column("q", q)]))

    return run


def _whole(queries: pa.Table) -> pa.Table:
    """Queries that came in several parts as one each."""
    number = queries["query_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    if len(number) == number.max() + 1:
        return queries
    order = np.argsort(number, kind="stable")
    rows = queries.take(pa.array(order)).combine_chunks()
    begin = np.flatnonzero(np.diff(number[order], prepend=-1))
    ends = np.append(0, np.cumsum(pc.list_value_length(rows["tids"].combine_chunks()).to_numpy()))
    offsets = pa.array(ends[np.append(begin, len(order))], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, rows[c].combine_chunks().flatten()) for c in ("tids", "qws")]
    first = rows.take(pa.array(begin))
    return pa.table([first["query_id"], first["m"], *lists], names=["query_id", "m", "tids", "qws"])


def _matching_methods(dfs, methods: list[Method], restricted: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(units: pa.Table, packed: pa.Table) -> pa.Table:
        rows = _unpacked(units, restricted) if units.num_rows and packed.num_rows else None
        if rows is None or not rows.num_rows:
            kinds = units.schema.field("uids").type, packed.schema.field("query_ids").type
            return pa.schema([("m", pa.int32()), ("query_ids", kinds[1]), ("uids", kinds[0]), ("scores", pa.list_(pa.float64()))]).empty_table()
        wanted = _whole(_unpacked_queries(packed))
        numbers = rows["uw"].to_numpy()
        tf, length = (numbers >> LENGTH_BITS).astype(np.float64), (numbers & (1 << LENGTH_BITS) - 1).astype(np.float64)
        tids, qtf = (wanted[c].combine_chunks() for c in ("tids", "qws"))
        df, qtfs = dfs.value[tids.flatten().to_numpy()], qtf.flatten().to_numpy().astype(np.float64)
        offsets = pa.array(np.append(0, np.cumsum(pc.list_value_length(tids).to_numpy())), pa.int32())
        out = []
        for i, method in enumerate(methods):
            weights = pa.ListArray.from_arrays(offsets, pa.array(method.query(qtfs, df)))
            asked = pa.table([wanted["query_id"], pc.add(wanted["m"], pa.scalar(i * SHARES, pa.int32())), tids, weights], names=["query_id", "m", "tids", "qws"])
            out.append(_pack_found(_best(method.k, method.least, rows.set_column(2, "uw", pa.array(method.unit(tf, length))), asked), asked))
        return pa.concat_tables(out)

    return run


def _merged_methods(ks: list[int]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        method = rows["m"][0].as_py() // SHARES
        best = _merged(ks[method])(rows)
        return best.add_column(0, "method", pa.array(np.full(best.num_rows, method, dtype=np.int32)))

    return run
