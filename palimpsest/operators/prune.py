"""Context pruning: filters, conflicts and packing of retrieved chunks.

Chunks: ``query_id, chunk_id, pos, score, tower, tokens, ts`` (epoch seconds, 0 unknown), ``entity_ids, source_ids`` and per-method ranks.
What a query retrieved is bounded by its top-k, so the sequential choices work on one query in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import ship

# Trust in the towers.
TOWER_TRUST = {"hierarchical": 1.0, "episodic": 0.8, "kg": 0.6}
OTHER_TRUST = 0.5


def mad_filter(chunks: DataFrame, factor: float = 2.5) -> DataFrame:
    """Chunks of at least the query's median score less ``factor`` median absolute deviations; all if there is one chunk or hardly a deviation."""
    mid = chunks.groupBy("query_id").agg(F.median("score").alias("mid"), F.count("*").alias("n"))
    spread = chunks.join(mid, "query_id").groupBy("query_id").agg(F.median(F.abs(F.col("score") - F.col("mid"))).alias("mad"), F.first("mid").alias("mid"), F.first("n").alias("n"))
    return chunks.join(spread, "query_id").where((F.col("n") < 2) | (F.col("mad") < 1e-6) | (F.col("score") >= F.col("mid") - factor * F.col("mad"))).drop("mad", "mid", "n")


def arbitration(chunks: DataFrame, query_time: Column, now: float) -> DataFrame:
    """Chunks with ``arbitration``: half the score, 0.3 of the tower's trust, 0.2 of recency. Recency falls by e in 720 hours from the reference time (the
    query's, else the newest chunk's, else ``now``), a fifth of that for chunks after it, 0.5 for unknown times."""
    newest = F.max(F.when(F.col("ts") > 0, F.col("ts"))).over(Window.partitionBy("query_id"))
    ref = F.coalesce(F.when(query_time > 0, query_time), newest, F.lit(float(now)))
    hours = F.abs(ref - F.col("ts")) / 3600
    recency = F.when(F.col("ts") > 0, F.exp(-hours / 720) * F.when(F.col("ts") > ref, 0.2).otherwise(1.0)).otherwise(0.5)
    trust = F.coalesce(*[F.when(F.col("tower") == t, v) for t, v in TOWER_TRUST.items()], F.lit(OTHER_TRUST))
    return chunks.withColumn("arbitration", 0.5 * F.col("score") + 0.3 * trust + 0.2 * recency)


def disambiguate(chunks: DataFrame, max_drops: int | None = None, stale_hours: float = 720.0) -> DataFrame:
    """Chunks that stay when other towers say the same: ``chunks`` with ``dropped`` (bool), ``reason``, ``keeper``.

    In order of arbitration (then position), a chunk is in conflict if one of its entities, else one of its sources, was accepted from
    other towers only. It is dropped while fewer than ``max_drops`` were: STALE if the keeper is newer by more than ``stale_hours``, LOW_SCORE below half the
    keeper's score, else REDUNDANT. What is dropped blocks nothing.
    """
    ship(chunks.sparkSession)

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        holder: dict[tuple[str, str], list[int]] = {}
        dropped, reason, keeper, n = [False] * len(rows), [None] * len(rows), [None] * len(rows), 0
        ids, tower, ts, score, entities, sources = (rows[c].tolist() for c in ("chunk_id", "tower", "ts", "score", "entity_ids", "source_ids"))
        for i in rows.sort_values(["arbitration", "pos"], ascending=[False, True], kind="stable").index.tolist():
            hit = None
            keys = [("e", str(x)) for x in (entities[i] if entities[i] is not None else [])] + [("s", str(x)) for x in (sources[i] if sources[i] is not None else [])]
            for key in keys:
                held = holder.get(key, [])
                if held and all(tower[j] != tower[i] for j in held):
                    hit = held[0]
                    break
            if hit is not None and (max_drops is None or n < max_drops):
                n += 1
                dropped[i], keeper[i] = True, ids[hit]
                newer = ts[hit] - ts[i] if ts[i] > 0 and ts[hit] > 0 else 0
                reason[i] = "STALE" if newer > stale_hours * 3600 else "LOW_SCORE" if score[i] < 0.5 * score[hit] else "REDUNDANT"
                continue
            for key in keys:
                holder.setdefault(key, []).append(i)
        return pd.DataFrame({"query_id": rows.query_id, "chunk_id": rows.chunk_id, "dropped": dropped, "reason": reason, "keeper": keeper})

    q, c = (chunks.schema[x].dataType.simpleString() for x in ("query_id", "chunk_id"))
    out = chunks.groupBy("query_id").applyInPandas(judge, f"query_id {q}, chunk_id {c}, dropped boolean, reason string, keeper {c}")
    return chunks.join(out, ["query_id", "chunk_id"])


def pack_mmr(chunks: DataFrame, max_tokens: int, separator: int = 2, mode: str = "BUDGET_MAX", absolute_min: float = 0.0, cliff: float = 2.0, min_chunks: int = 2, fraction: float = 0.8, reserve: dict[str, float] | None = None) -> DataFrame:
    """``query_id, chunk_id, place``: chunks chosen one by one for 0.6 score less 0.4 redundancy, as long as they fit into ``max_tokens`` (separators included).

    Redundancy of two chunks: 0.4 Jaccard of entities, 0.15 more if they share any; 0.4 of the candidate's shared sources, 0.2 more if any; 0.2 for the same
    tower. ``reserve`` first fills each tower's share of the budget by score, the smallest share first. Modes: STRICT keeps scores of at least ``absolute_min``; CLIFF stops after a chunk more than ``cliff`` below the
    best; DYNAMIC_ADAPTIVE stops at ``min_chunks`` and ``fraction`` of the budget; BUDGET_MAX goes on while anything fits.
    """
    ship(chunks.sparkSession)

    def redundancy(a, b) -> float:
        ea, eb, sa, sb = set(a.entity_ids), set(b.entity_ids), set(a.source_ids), set(b.source_ids)
        out = 0.0
        if ea | eb and (j := len(ea & eb) / len(ea | eb)) > 0:
            out += 0.4 * j + 0.15
        if sa and (s := len(sa & sb) / len(sa)) > 0:
            out += 0.4 * s + 0.2
        return out + (0.2 if a.tower == b.tower else 0.0)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        items = list(rows.itertuples())
        items = [x._replace(entity_ids=list(x.entity_ids) if x.entity_ids is not None else [], source_ids=list(x.source_ids) if x.source_ids is not None else []) for x in items]
        budget = min(max_tokens, sum(int(x.tokens) for x in items) + separator * max(0, len(items) - 1))
        chosen: list = []
        used = 0
        cost = lambda x: int(x.tokens) + (separator if chosen else 0)
        for tower, share in sorted((reserve or {}).items(), key=lambda x: (x[1], x[0])):
            part = 0
            for x in sorted((x for x in items if x.tower == tower), key=lambda x: (-x.score, x.pos)):
                if part + cost(x) <= share * budget and used + cost(x) <= budget:
                    part, used = part + cost(x), used + cost(x)
                    chosen.append(x)
        left = [x for x in items if x not in chosen and (mode != "STRICT" or x.score >= absolute_min)]
        worst = {x.Index: max([redundancy(x, y) for y in chosen], default=0.0) for x in left}
        best = max((x.score for x in items), default=0.0)
        while True:
            fit = [x for x in left if used + cost(x) <= budget]
            if not fit:
                break
            x = max(fit, key=lambda x: (0.6 * x.score - 0.4 * worst[x.Index], -x.pos))
            left.remove(x)
            used += cost(x)
            chosen.append(x)
            for y in left:
                worst[y.Index] = max(worst[y.Index], redundancy(y, x))
            if (mode == "CLIFF" and best - x.score > cliff) or (mode == "DYNAMIC_ADAPTIVE" and len(chosen) >= min_chunks and used >= int(max_tokens * fraction)):
                break
        if not chosen:
            return rows[["query_id", "chunk_id"]].iloc[:0].assign(place=pd.Series(dtype="int32"))
        return pd.DataFrame({"query_id": [x.query_id for x in chosen], "chunk_id": [x.chunk_id for x in chosen], "place": range(1, len(chosen) + 1)})

    q, c = (chunks.schema[x].dataType.simpleString() for x in ("query_id", "chunk_id"))
    return chunks.groupBy("query_id").applyInPandas(choose, f"query_id {q}, chunk_id {c}, place int")


def pack_by_score(chunks: DataFrame, max_tokens: int, separator: int = 2) -> DataFrame:
    """``query_id, chunk_id, place``: the best chunks in order of score until one doesn't fit; exact as a running sum."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "pos")
    upto = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) + separator * (F.row_number().over(w) - 1)
    x = chunks.withColumn("place", F.row_number().over(w)).withColumn("upto", upto)
    fits = F.max(F.when(F.col("upto") > max_tokens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    return x.withColumn("fits", fits).where("fits").select("query_id", "chunk_id", "place")


def confidence(chunks: DataFrame, ranks: list[str], high: float = 0.7, low: float = 0.3, near: int = 10, minmax: bool = False) -> DataFrame:
    """Chunks with ``level``: HIGH, MED or DROP, and ``promoted``: a middling score whose rank is good in at least two methods becomes HIGH."""
    s = F.col("score")
    if minmax:
        w = Window.partitionBy("query_id")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        s = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(1.0)
    good = sum((F.when(F.col(r) <= near, 1).otherwise(0) for r in ranks), F.lit(0))
    promoted = (s < high) & (s >= low) & (good >= 2)
    return chunks.withColumn("promoted", promoted).withColumn("level", F.when(s < low, "DROP").when((s >= high) | promoted, "HIGH").otherwise("MED"))


def cumulative_stop(chunks: DataFrame, target: float = 2.5, decay: float = 0.9) -> DataFrame:
    """Chunks of HIGH and MED in order of score until their decayed scores (score * decay^i) sum to ``target``; the one that reaches it is kept."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "pos")
    kept = chunks.where("level <> 'DROP'").withColumn("i", F.row_number().over(w) - 1)
    before = F.coalesce(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return kept.withColumn("before", before).where(F.round("before", 9) < target).drop("before", "i")


def joined_context(chunks: DataFrame, order: str = "place", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """``query_id, context``: the chunks' texts in order; null texts are left out."""
    rows = chunks.where(F.col(text).isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x.t), separator).alias("context"))


def fact_context(facts: DataFrame, order: str, label: str = "Fact") -> DataFrame:
    """``query_id, context``: numbered lines ``Fact i: [time] text``, unknown times named so; blank texts are skipped."""
    w = Window.partitionBy("query_id").orderBy(order)
    rows = facts.where(F.trim("text") != "").withColumn("i", F.row_number().over(w))
    line = F.concat(F.lit(f"{label} "), F.col("i").cast("string"), F.lit(": ["), F.coalesce(F.nullif("time", F.lit("")), F.lit("time unknown")), F.lit("] "), F.col("text"))
    return joined_context(rows.withColumn("line", line), "i", "line", "\n")


def truncated(texts: DataFrame, max_tokens: int, estimate) -> DataFrame:
    """``uid, text``: the longest run of last lines whose token counts (each line with its line break, 1 at least) fit into ``max_tokens``; texts that fit stay whole."""
    lines = texts.where("text is not null").select("uid", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = F.greatest(F.lit(1), estimate(F.concat("line", F.lit("\n"))))
    w = Window.partitionBy("uid").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("upto", F.sum(n).over(w)).where(F.col("upto") <= max_tokens)
    joined = kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r")).select("uid", F.array_join(F.transform("r", lambda x: x.line), "\n").alias("t"))
    whole = texts.where("text is not null").select("uid", F.col("text").alias("whole"), (estimate(F.col("text")) <= max_tokens).alias("fits"))
    return whole.join(joined, "uid", "left").select("uid", F.when(F.col("fits"), F.col("whole")).otherwise(F.coalesce("t", F.lit(""))).alias("text"))
