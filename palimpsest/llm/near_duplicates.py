"""Near-duplicate records: an exact similarity join by pigeonhole blocks and Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.session import ship, written

#: Counters of the frequency sketch that is sent to the workers: its size is fixed, whatever the vocabulary.
SKETCH = 1 << 20
#: How many records may be expected to share a block by chance; the cheapest is taken.
SHARES = (4, 8, 16, 32, 64, 128, 256)
#: Bits of the folded fingerprint that travels with a block.
FOLD = 128
MAX_WIDTH = 4
#: Rows of blocks that a task compares at a time.
ROWS_TOGETHER = 200_000
_MASK = (1 << 64) - 1


def words_of(content: Column, keys: Column) -> Column:
    """The distinct words of a record, hashed to 64 bits and sorted: runs of letters and digits of the
    lower-cased content and keys together. Null parts are empty."""
    joined = F.lower(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.array_join(F.coalesce(keys, F.array().cast("array<string>")), " ")))
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.xxhash64(w))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int32).reshape(-1, k)


def _holes(widths: np.ndarray, need: int) -> int:
    """How many of the first words must be taken so that ``need`` misses can't empty every block."""
    seen = [0] * (MAX_WIDTH + 1)
    have = 0
    for j, k in enumerate(widths.tolist()):
        seen[k] += 1
        if seen[k] >= k:
            have += 1
            if have >= need:
                return j + 1
    return len(widths)


def _schemes(n: int, similarity: float) -> Iterator[tuple[int, bool]]:
    """Records of up to ``few`` words, and of more than ``many``, take single words; each pair of alike records
    falls into one of three schemes by its smaller record, and both its records take part in it."""
    few, many = int(np.ceil(7 / similarity)), 64
    for scheme, lowest, highest, wide in ((1, 1, few / similarity, False), (2, few + 1, many / similarity, True), (3, many + 1, np.inf, False)):
        if lowest <= n <= highest:
            yield scheme, wide


def _widths(words: np.ndarray, counts: np.ndarray, members: float, similarity: float, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The words from the rarest on, how many of each kind make a block, and the misses to hold out against, plus one."""
    order = np.lexsort((words, counts))
    rate = np.minimum(np.maximum(counts[order], 1) / members, 0.999999)
    width = np.clip(np.ceil(np.log(max(members / share, 1.0000001)) / -np.log(rate) - 1e-9), 1, MAX_WIDTH).astype(np.int64)
    return order, width, len(words) - int(np.ceil(similarity * len(words) - 1e-9)) + 1


def _record_blocks(words: np.ndarray, counts: np.ndarray, members: float, salt: int, similarity: float, share: float) -> list[np.ndarray]:
    order, width, need = _widths(words, counts, members, similarity, share)
    mixed = _mix(words[order])
    out = []
    for scheme, wide in _schemes(len(words), similarity):
        w = width if wide else np.ones_like(width)
        upto = _holes(w, need)
        for k in np.unique(w[:upto]).tolist():
            of = mixed[:upto][w[:upto] == k]
            if len(of) >= k:
                joint = of[_choices(len(of), k)].sum(axis=1, dtype=np.uint64) if k > 1 else of
                out.append(_mix(joint + np.uint64((scheme * 8 + k) * 0x9E3779B97F4A7C15 & _MASK) + np.uint64(salt & _MASK)))
    return out


def _slots(words: np.ndarray, salt: int) -> np.ndarray:
    return ((words ^ np.uint64(salt & _MASK)) % np.uint64(SKETCH)).astype(np.int64)


def _best_share(records: DataFrame, sketch: np.ndarray, similarity: float, look_at: int = 1000) -> float:
    """The share that needs the fewest blocks and comparisons for some records. Every share gives the same pairs."""
    cost = dict.fromkeys(SHARES, 0.0)
    for r in records.select("salt", "members", "words").limit(look_at).collect():
        words = np.array(r.words, dtype=np.int64).view(np.uint64)
        for share in cost:
            _, width, need = _widths(words, sketch[_slots(words, r.salt)], r.members, similarity, share)
            for _, wide in _schemes(len(words), similarity):
                w = width if wide else np.ones_like(width)
                n = np.bincount(w[: _holes(w, need)], minlength=MAX_WIDTH + 1)
                cost[share] += sum(comb(int(n[k]), k) for k in range(1, MAX_WIDTH + 1)) * (1 + share / 300)
    return min(cost, key=cost.get)


def _fold(words: np.ndarray) -> list[int]:
    """The fingerprint (one bit for each word there is) folded by parity to FOLD bits: the distance of two
    folded fingerprints is never more than that of the whole ones."""
    bits = np.bincount((words % FOLD).astype(np.int64), minlength=FOLD).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[first], b[first]


def _near(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs within the blocks of rows sorted by block whose folded fingerprints are near enough. Rows are taken ``ROWS_TOGETHER`` at a
    time, and a block that goes on beyond them is kept for the next time."""
    waiting: list[list[np.ndarray]] = []
    rows = 0
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal held
        block, ids, n, f0, f1 = columns
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sizes = np.diff(np.r_[starts, len(block)])
        end = np.repeat(starts + sizes, sizes)
        # Each row meets the next rows of its block, one step further in each round.
        left = np.flatnonzero(end - np.arange(len(block)) > 1)
        step = 1
        while len(left):
            right = left + step
            apart = sum(np.bitwise_count((f[left] ^ f[right]).view(np.uint64)).astype(np.int32) for f in (f0, f1))
            keep = (apart <= limit * (n[left] + n[right]) + 1e-9) & (ids[left] != ids[right])
            if keep.any():
                x, y = ids[left[keep]], ids[right[keep]]
                out.append((np.minimum(x, y), np.maximum(x, y)))
                held += len(x)
                if held > 1_000_000:
                    yield emit()
            step += 1
            left = left[left + step < end[left]]

    def emit() -> pa.RecordBatch:
        nonlocal held
        a, b = _once(*(np.concatenate(side) for side in zip(*out, strict=True)))
        out.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        rows += batch.num_rows
        if rows < ROWS_TOGETHER:
            continue
        columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last block may go on
        if cut:
            yield from pairs([x[:cut] for x in columns])
        waiting = [[x[cut:] for x in columns]]
        rows = len(columns[0]) - cut
    if waiting:
        yield from pairs([np.concatenate(x) for x in zip(*waiting, strict=True)])
    if held:
        yield emit()


def _blocks(records: DataFrame, sketch: np.ndarray, similarity: float, share: float) -> DataFrame:
    """``block, id, n, f0, f1`` for records ``salt, members, id, words``."""
    sent = ship(records.sparkSession).sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            salts, members, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lists.offsets.to_numpy()
            blocks, rows, folds, sizes = [], [], [], []
            for i in range(len(ids)):
                words = flat[offsets[i] : offsets[i + 1]]
                salt = int(salts[i]) & _MASK
                own = counts[_slots(words, salt)]
                found = np.concatenate(_record_blocks(words, own, float(members[i]), salt, similarity, share))
                blocks.append(found.view(np.int64))
                rows.append(len(found))
                folds.append(_fold(words))
                sizes.append(len(words))
                if sum(rows) > 200_000 or i == len(ids) - 1:
                    at = np.repeat(np.arange(i + 1 - len(rows), i + 1), rows)
                    f = np.repeat(np.array(folds, dtype=np.int64), rows, axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(blocks)), pa.array(ids[at]), pa.array(np.repeat(np.array(sizes, dtype=np.int32), rows)), *(pa.array(np.ascontiguousarray(f[:, c])) for c in range(2))],
                        names=["block", "id", "n", "f0", "f1"],
                    )
                    blocks, rows, folds, sizes = [], [], [], []

    return records.select("salt", "members", "id", "words").mapInArrow(run, "block bigint, id bigint, n int, f0 bigint, f1 bigint")


def _frequencies(records: DataFrame) -> np.ndarray:
    """The frequency sketch: how many words of all records fall on each counter. Any counts give a right
    result; good ones make blocks rare."""
    words = records.select("salt", F.explode("words").alias("word"))
    found = words.groupBy(F.pmod(F.col("word").bitwiseXOR(F.col("salt")), F.lit(SKETCH)).alias("slot")).count().toArrow()
    sketch = np.zeros(SKETCH, dtype=np.int32)
    sketch[found.column("slot").to_numpy()] = np.minimum(found.column("count").to_numpy(), 2**31 - 1)
    return sketch


def _in_parts(blocks: DataFrame, crowded: DataFrame, hot: int) -> DataFrame:
    """The rows of crowded blocks as blocks of two parts each, so that every two parts, and all of each, meet."""
    parts = F.ceil(F.col("count") / hot).cast("int")
    part = blocks.join(crowded.select("block", parts.alias("parts")), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    both = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(2)) - 1)))
    return both.select(F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "id", "n", "f0", "f1")


def alike(sets: DataFrame, similarity: float = 0.8, hot: int = 20_000, depth: int = 2) -> DataFrame:
    """Pairs ``a < b`` of ``sets`` (``id bigint, words array<bigint>``, the words distinct and sorted, ids
    and word sets distinct) of which at least ``similarity`` of all words are in both. Exact; empty sets
    are never alike.

    The fingerprint of a set has a bit for each word of the vocabulary. Two sets of ``m`` and ``n``
    words are alike exactly if their Hamming distance is at most ``(1-s)/(1+s) (m+n)``. Blocks of a
    fingerprint are combinations of its rarer words: a rare word is a block by itself, commoner words form a block by twos, threes or fours. A set of n
    words can lack at most ``d = n - ceil(s n)`` of them in its partner, so blocks are taken from the
    rarest words on until d misses can't hit them all (k words in blocks of i hold out against k - i
    misses); the same order of words for all sets makes the pair share a block. Candidates from the
    join on blocks pass the distance of folded fingerprints, which is a lower bound, inside the join, and
    the exact distance afterwards.

    A block shared by more than ``hot`` sets (a phrase that a third of all records contain) is not
    joined but divided again, by frequencies within it, up to ``depth`` times. What is still crowded then, since
    its sets differ in few words only, is split into parts of about ``hot`` sets, and every two parts are
    compared in a task of their own.
    """
    rows = sets.where(F.size("words") > 0).select("id", "words")
    total = max(rows.count(), 1)
    level = rows.select(F.lit(0).cast("bigint").alias("salt"), F.lit(float(total)).alias("members"), "id", "words")
    limit = (1 - similarity) / (1 + similarity)
    found = None
    for step in range(depth + 1):
        sketch = _frequencies(level)
        share = _best_share(level, sketch, similarity)
        blocks = _blocks(level, sketch, similarity, share)
        crowded = None
        if total > hot:
            # Which blocks are divided changes no result, so a count over a sixteenth of the records will do.
            part = _blocks(level.where(F.pmod("id", F.lit(16)) == 0), sketch, similarity, share)
            crowded = written(part.groupBy("block").count().select("block", F.col("count") * 16).toDF("block", "count").where(F.col("count") > hot), "crowded")
            if crowded.isEmpty():
                crowded = None
        calm = blocks.join(crowded.select("block"), "block", "left_anti") if crowded is not None else blocks
        if crowded is not None and step == depth:
            calm = calm.unionByName(_in_parts(blocks, crowded, hot))
        # One sort brings a block's records together; the pairs are made from them batch by batch.
        together = calm.repartition("block").sortWithinPartitions("block")
        pairs = together.mapInArrow(lambda batches, limit=limit: _near(batches, limit), "a bigint, b bigint").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None or step == depth:
            break
        level = blocks.join(crowded, "block").select(F.xxhash64("block").alias("salt"), F.col("count").cast("double").alias("members"), "id").join(rows, "id").select("salt", "members", "id", "words")
    verified = (
        found.distinct()
        .join(rows.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        .join(rows.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        .withColumn("both", F.size(F.array_intersect("wa", "wb")))
        .withColumn("distance", F.size("wa") + F.size("wb") - 2 * F.col("both"))
    )
    return verified.where(F.col("distance") <= F.lit(limit) * (F.size("wa") + F.size("wb")) + 1e-9).select("a", "b", "distance")


class Duplicates:
    """Classes of equal word sets and the links between them, written to the shared folder once."""

    def __init__(self, facts: DataFrame, similarity: float = 0.6):
        rows = facts.where("fact_id is not null").select("fact_id", words_of(F.col("content"), F.col("retrieval_keys")).alias("words"))
        # Rows of a repeated id count once; equal sets form a class, named by its smallest id.
        once = rows.groupBy("fact_id").agg(F.min("words").alias("words"))
        worded = once.select("fact_id", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
        worded = written(worded, "words")
        classes = worded.where(F.size("words") > 0).groupBy("h1", "h2").agg(F.min("fact_id").alias("class_id"), F.count("*").alias("copies"), F.min("words").alias("words"))
        self.classes = written(classes.select("class_id", "copies", "h1", "h2", F.xxhash64("class_id").alias("id"), "words"), "classes")
        self.facts = worded.select("fact_id", "h1", "h2").join(self.classes.select("h1", "h2", "class_id", "id"), ["h1", "h2"], "left").select("fact_id", F.coalesce("class_id", "fact_id").alias("class_id"), "id")
        links = alike(self.classes.select("id", "words"), similarity)
        self.links = written(links.select("a", "b"), "alike")

    def pairs(self) -> DataFrame:
        """All pairs ``fact_id_a < fact_id_b`` of alike facts, copies among them."""
        members = self.facts.where("id is not null").select("fact_id", "id")
        both = self.links.select(F.col("a").alias("p"), F.col("b").alias("q")).unionByName(self.classes.where("copies > 1").select(F.col("id").alias("p"), F.col("id").alias("q")))
        left = members.select(F.col("fact_id").alias("x"), F.col("id").alias("p"))
        right = members.select(F.col("fact_id").alias("y"), F.col("id").alias("q"))
        out = both.join(left, "p").join(right, "q").where((F.col("p") != F.col("q")) | (F.col("x") < F.col("y")))
        return out.select(F.least("x", "y").alias("fact_id_a"), F.greatest("x", "y").alias("fact_id_b"))

    def groups(self) -> DataFrame:
        """One row for each fact: its class of equal texts, the number of facts alike to it, and the group of
        facts connected by likeness, named by its smallest class."""
        size = self.classes.select("id", "copies", "class_id")
        ends = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = ends.join(size.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
        named = self.links.join(size.select(F.col("id").alias("a"), F.col("class_id").alias("ca")), "a").join(size.select(F.col("id").alias("b"), F.col("class_id").alias("cb")), "b")
        group = connected_components(named, "ca", "cb")
        per_class = (
            size.join(degree.withColumnRenamed("a", "id"), "id", "left")
            .join(group.withColumnRenamed("node", "class_id"), "class_id", "left")
            .select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("group_id"))
        )
        return self.facts.select("fact_id", "class_id").join(per_class, "class_id", "left").select(
            "fact_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id")
        )
