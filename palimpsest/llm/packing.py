"""Documents packed into containers of fixed capacity, every stretch of containers in the target mixture."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import DEFAULT_FOLDER, count_columns
from palimpsest.operators.running import running_sum
from palimpsest.session import ship, written

#: Containers a lane aims at, and items it holds at most on average: the unit of work of a task.
LANE_CONTAINERS = 2048
LANE_ITEMS = 50_000
#: Lanes whose deficits are summed in one task.
LANES_PER_BUCKET = 4096
#: Containers filled in one round of the queues.
WINDOW_CONTAINERS = 256
ASSIGNMENT = "profile string, container_id string, capacity_tokens int, lane int, window_no int, source string, doc_id bigint, piece_no int, token_start bigint, n_tokens int"


def token_sizes(documents: DataFrame, tokenizers: list[str], folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``doc_id, source, tokenizer, n`` of every document for each tokenizer; null and empty texts have 0."""
    keyed = documents.select(F.struct("doc_id", "source").alias("doc"), "text")
    return count_columns(keyed, "doc", "text", tokenizers, folder).select("doc.doc_id", "doc.source", "tokenizer", "n")


class _Bins:
    """Open containers by free space; best fit."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.made = capacity, [], 0

    def place(self, size: int) -> int:
        """The number of the container that takes an item: the fullest that can, else a new one."""
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            free, k = self.free.pop(i)
        else:
            free, k = self.capacity, self.made
            self.made += 1
        insort(self.free, (free - size, k))
        return k

    def close(self, below: int, most: int) -> None:
        """Forget containers with less free space than ``below``, and the fullest of more than ``most``."""
        i = max(bisect_left(self.free, (below, -1)), len(self.free) - most)
        del self.free[:i]


def _fill_lane(rows: pd.DataFrame) -> pd.DataFrame:
    """One lane: deficit round-robin over the sources' queues fills windows, and each window's items go into containers, the largest first."""
    profile, lane, capacity = rows["profile"].iat[0], int(rows["lane"].iat[0]), int(rows["capacity_tokens"].iat[0])
    rows = rows.sort_values(["source", "turn", "doc_id", "piece_no"], na_position="first")
    queues: dict[str, deque] = {}
    share: dict[str, float] = {}
    deficit: dict[str, float] = {}
    for i, (source, s, d) in enumerate(zip(rows["source"], rows["share"], rows["carried"], strict=True)):
        queues.setdefault(source, deque()).append(i)
        share[source], deficit[source] = float(s), float(d)
    size = rows["n_tokens"].to_numpy()
    bins, window = _Bins(capacity), 0
    container, at_window = [0] * len(rows), [0] * len(rows)
    smallest = max(1, int(size[size > 0].min())) if (size > 0).any() else 1
    while queues:
        taken: list[int] = []
        left = sum(share[s] for s in queues)
        for source in list(queues):
            q = queues[source]
            # What emptied queues no longer use goes to the others in proportion; the deficit is carried to the next window.
            deficit[source] += WINDOW_CONTAINERS * capacity * (share[source] / left if left > 0 else 1 / len(queues))
            while q and size[q[0]] <= deficit[source]:
                i = q.popleft()
                deficit[source] -= size[i]
                taken.append(i)
            if not q:
                del queues[source]
        for i in sorted(taken, key=lambda i: -size[i]):
            container[i], at_window[i] = bins.place(int(size[i])), window
        bins.close(smallest, 4 * WINDOW_CONTAINERS)
        window += 1
    out = rows[["profile", "capacity_tokens", "lane", "source", "doc_id", "piece_no", "token_start", "n_tokens"]].copy()
    out["window_no"] = at_window
    out["container_id"] = [f"{profile}-{lane:06d}-{k:06d}" for k in container]
    return out[["profile", "container_id", "capacity_tokens", "lane", "window_no", "source", "doc_id", "piece_no", "token_start", "n_tokens"]]


def pack(documents: DataFrame, profiles: DataFrame, folder: str = DEFAULT_FOLDER, weights: DataFrame | None = None, lane_containers: int = LANE_CONTAINERS) -> DataFrame:
    """Every document in containers of each profile: one row for each piece (see ASSIGNMENT).

    A document is in one piece unless it has more tokens than a container; then its pieces fill whole
    containers and the rest is an item as others. Null and empty texts are items of 0 tokens. A null source is a source
    of its own. Profiles without a tokenizer or with a capacity below 1 are left out.

    Mixture-controlled packing: items go to lanes by hash, so a source of any size is spread over all
    lanes, and each lane is one bounded task. In a lane, deficit round-robin over the sources' queues
    fills every window of containers to the target proportions of tokens: ``weights`` (``source,
    weight``), or each source's share of all tokens. What a source didn't get is carried to the next window; what earlier lanes
    gave it too little or too much is carried into the lane. A window's items are placed by best fit, largest
    first, in containers that stay open over windows as long as anything may fit.
    """
    spark = ship(documents.sparkSession)
    known = profiles.where("profile is not null and tokenizer is not null and capacity_tokens >= 1").select("profile", "tokenizer", "capacity_tokens").dropDuplicates(["profile"])
    tokenizers = sorted(r[0] for r in known.select("tokenizer").distinct().collect())  # a setting: a few names
    if not tokenizers:
        return spark.createDataFrame([], ASSIGNMENT)
    sizes = written(token_sizes(documents, tokenizers, folder).withColumn("source", F.coalesce("source", F.lit(""))), "token-sizes")
    sized = sizes.join(known, "tokenizer")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens"))).cast("int")
    items = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(1), pieces))).select(
        "profile", "capacity_tokens", "source", "doc_id", "piece_no",
        ((F.col("piece_no") - 1).cast("bigint") * F.col("capacity_tokens")).alias("token_start"),
        F.least(F.col("capacity_tokens"), F.col("n") - (F.col("piece_no") - 1) * F.col("capacity_tokens")).cast("int").alias("n_tokens"),
    )
    totals = items.groupBy("profile").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("items"), F.max("capacity_tokens").alias("c"))
    lanes = totals.select("profile", "total", F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("c") * lane_containers)), F.ceil(F.col("items") / LANE_ITEMS)).cast("int").alias("lanes"))
    turn = F.xxhash64("doc_id", "piece_no")
    laned = items.join(lanes, "profile").withColumn("turn", turn).withColumn("lane", F.pmod(F.xxhash64("turn"), F.col("lanes")).cast("int"))
    by_source = laned.groupBy("profile", "lane", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = by_source.groupBy("profile", "source").agg(F.sum("tokens").alias("t"))
    if weights is None:
        aim = whole.withColumn("w", F.col("t").cast("double"))
    else:
        aim = whole.join(weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("w")), "source", "left").fillna(0.0, ["w"])
    share = aim.select("profile", "source", F.coalesce(F.try_divide("w", F.sum("w").over(Window.partitionBy("profile"))), F.lit(0.0)).alias("share"))
    # Deficits at a lane's start: what its sources should have had in the lanes before, less what they had.
    in_lane = by_source.groupBy("profile", "lane").agg(F.sum("tokens").alias("lane_tokens"))
    grid = in_lane.join(share, "profile").join(by_source, ["profile", "lane", "source"], "left").fillna(0, ["tokens"])
    owed = F.col("share") * F.col("lane_tokens") - F.col("tokens")
    grid = written(grid.withColumn("bucket", F.floor(F.col("lane") / LANES_PER_BUCKET)), "lanes")
    upto = running_sum(grid, ["profile", "source"], "bucket", [F.col("lane")], owed, "upto")
    carried = upto.select("profile", "lane", "source", "share", (F.col("upto") - owed).alias("carried"))
    ready = laned.join(carried, ["profile", "lane", "source"]).drop("lanes", "total")
    return ready.groupBy("profile", "lane").applyInPandas(_fill_lane, ASSIGNMENT)


def container_report(assignment: DataFrame) -> DataFrame:
    """By profile: containers, tokens, the share of space used, the fewest containers possible by volume, and the fullest."""
    each = assignment.groupBy("profile", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("profile", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.col("capacity_tokens")), 6).alias("used_share"), F.ceil(F.sum("used") / F.col("capacity_tokens")).alias("least_containers"),
    )
