"""Operators over messages and facts in order: replies, pairs, timelines, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.time import utc_micros

# What counts as a repeatable action, in order, and its name.
ACTIONS = [("organized", "organized"), ("won", "won"), ("played", "played"), ("visited", "visited"), ("met", "met"), ("recommended", "recommended"), ("shared", "shared"), ("went to", "visited"), ("attended", "attended")]


#: Positions of a session that one task puts in order.
STRETCH = 4096


def reply_edges(messages: DataFrame, thread: str = "sample_id", order: tuple[str, ...] = ("ts", "uid")) -> DataFrame:
    """``src, dst``: each assistant message and the latest user message before it in the thread, over sessions; blank messages are skipped.

    ``messages``: thread, uid, role, text and the order columns. A thread of any length is cut by day of ``ts``: the last user message of earlier days is joined in.
    """
    x = messages.where(F.col("text").rlike(r"[^\s\x{a0}]")).withColumn("_day", F.floor(F.col(order[0]) / 86400))
    user = F.when(F.col("role") == "user", F.col("uid"))
    day = Window.partitionBy(thread, "_day").orderBy(*order)
    latest = x.withColumn("_in_day", F.last(user, ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, -1)))
    ends = x.where("role = 'user'").groupBy(thread, "_day").agg(F.max_by("uid", F.struct(*order)).alias("_end"))
    days = x.select(thread, "_day").distinct().join(ends, [thread, "_day"], "left")
    before = days.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(thread).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))).select(thread, "_day", "_before")
    return latest.where("role = 'assistant'").join(before, [thread, "_day"]).select(F.col("uid").alias("src"), F.coalesce("_in_day", "_before").alias("dst")).where("dst is not null")


def with_previous(messages: DataFrame, value: str, session: str = "session_id", order: str = "message_index") -> DataFrame:
    """Messages that have a session and a place, with ``previous``: the value of the message before in the session, null for the first. A long session is cut into stretches of ``order``; the last
    message of the stretch before is joined in."""
    x = messages.where(F.col(session).isNotNull() & F.col(order).isNotNull()).withColumn("_part", F.floor(F.col(order) / STRETCH))
    within = Window.partitionBy(session, "_part").orderBy(order, "uid")
    near = x.withColumn("_before", F.lag(value).over(within)).withColumn("_i", F.row_number().over(within))
    lasts = x.groupBy(session, "_part").agg(F.max_by(value, F.struct(order, "uid")).alias("_last"))
    earlier = lasts.select(session, "_part", F.lag("_last").over(Window.partitionBy(session).orderBy("_part")).alias("_earlier"))
    return near.join(earlier, [session, "_part"]).withColumn("previous", F.when(F.col("_i") == 1, F.col("_earlier")).otherwise(F.col("_before"))).select(*messages.columns, "previous")


def message_pairs(messages: DataFrame, session: str = "session_id", order: str = "message_index") -> DataFrame:
    """``src, dst, distance``: consecutive messages of a session."""
    return with_previous(messages.select("uid", session, order), "uid", session, order).where("previous is not null").select(F.col("previous").alias("src"), F.col("uid").alias("dst"), F.lit(1).alias("distance"))


def gaps(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Events with ``gap_minutes`` since the key's event before; null for the first, 0 for one out of order."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    x = events.withColumn("_us", utc_micros(events, ts))
    return x.withColumn("gap_minutes", F.greatest(F.lit(0.0), (F.col("_us") - F.lag("_us").over(w)) / 6e7)).drop("_us")


def accumulations(facts: DataFrame, types: tuple[str, ...] = ("EVENT", "ACHIEVEMENT", "ACTIVITY")) -> DataFrame:
    """``subject, action, count, time_span_start, time_span_end``: what a participant did at least twice, by the first verb found in each fact."""
    low = F.lower("content")
    action = F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(a)) for p, a in ACTIONS])
    x = facts.where(F.col("fact_type").isin(*types)).select(F.explode("participants").alias("who"), action.alias("action"), F.nullif(F.trim("start"), F.lit("")).alias("start")).where("action is not null")
    out = x.groupBy(F.lower("who").alias("subject"), "action").agg(F.count("*").alias("count"), F.coalesce(F.min("start"), F.lit("")).alias("time_span_start"), F.coalesce(F.max("start"), F.lit("")).alias("time_span_end"))
    return out.where(F.col("count") >= 2)


def timelines(facts: DataFrame, least: int = 3) -> DataFrame:
    """``subject, fact_ids``: facts of a participant who has at least ``least``, in order of start (unknown last), as many as a person has."""
    x = facts.select(F.explode("participants").alias("who"), F.coalesce(F.nullif("start", F.lit("")), F.lit("9999-99-99")).alias("t"), "fact_id")
    rows = x.groupBy(F.lower("who").alias("subject")).agg(F.array_sort(F.collect_list(F.struct("t", "fact_id"))).alias("r")).where(F.size("r") >= least)
    return rows.select("subject", F.transform("r", lambda x: x.fact_id).alias("fact_ids"))


def state_changes(facts: DataFrame) -> DataFrame:
    """``subject, from_fact, to_fact, from_text, to_text``: consecutive facts of the type STATE_CHANGE of a participant, by start; 100 characters of text."""
    x = facts.where("fact_type = 'STATE_CHANGE'").select(F.explode("participants").alias("who"), F.coalesce(F.nullif("start", F.lit("")), F.lit("9999-99-99")).alias("t"), "fact_id", "content")
    x = x.withColumn("subject", F.lower("who"))
    w = Window.partitionBy("subject").orderBy("t", "fact_id")
    return x.select("subject", F.col("fact_id").alias("from_fact"), F.lead("fact_id").over(w).alias("to_fact"), F.substring("content", 1, 100).alias("from_text"), F.substring(F.lead("content").over(w), 1, 100).alias("to_text")).where("to_fact is not null")


def temporal_index(facts: DataFrame) -> DataFrame:
    """``month, facts``: facts by year and month of their start, as counts."""
    return facts.where(F.length("start") >= 7).groupBy(F.substring("start", 1, 7).alias("month")).agg(F.count("*").alias("facts"), F.min("fact_id").alias("first_fact"))


def participant_index(facts: DataFrame) -> DataFrame:
    """``participant, facts``: facts by participant."""
    return facts.select(F.explode("participants").alias("participant"), "fact_id").groupBy("participant").agg(F.count_distinct("fact_id").alias("facts"), F.min("fact_id").alias("first_fact"))


def fixed_chunks(texts: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """``uid, chunk_no, chunk``: windows of ``size`` characters, each beginning ``overlap`` before the last one's end. Empty texts have none."""
    step = max(1, size - overlap)
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int"))
    rows = texts.where(F.length("text") > 0).select("uid", "text", F.explode(starts).alias("i"))
    return rows.select("uid", F.col("i").alias("chunk_no"), F.expr(f"substring(text, i * {step} + 1, {size})").alias("chunk"))


def without_overlap(chunks: DataFrame, overlap: int) -> DataFrame:
    """``uid, text``: chunks of a text put together again, in order, without the part each repeats."""
    part = F.when(F.col("chunk_no") == 0, F.col("chunk")).otherwise(F.expr(f"substring(chunk, {overlap + 1})"))
    rows = chunks.select("uid", "chunk_no", part.alias("part")).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))).alias("r"))
    return rows.select("uid", F.array_join(F.transform("r", lambda x: x.part), "").alias("text"))


def similar_sessions(vectors: DataFrame, dim: int, threshold: float, least: int = 3) -> DataFrame:
    """``session_a, session_b, cosine``: pairs of sessions (``session_id, v`` of each unit; ``least`` units at least) whose mean vectors have a cosine of at least ``threshold``."""
    from palimpsest.operators.dense import near_pairs

    long = vectors.select("session_id", F.posexplode("v").alias("i", "x"))
    big = vectors.groupBy("session_id").count().where(F.col("count") >= least).select("session_id")
    mean = long.join(big, "session_id", "left_semi").groupBy("session_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    centres = mean.select(F.col("session_id").alias("uid"), F.transform("r", lambda e: e.x).alias("v"))
    return near_pairs(centres, dim, threshold).where("uid < other").select(F.col("uid").alias("session_a"), F.col("other").alias("session_b"), "cosine")


def mixed_pool(parts: dict[str, DataFrame], limit: int, seed: int = 42) -> DataFrame:
    """``layer, uid``: units of several layers, in an order by a digest of seed, unit and layer, the first ``limit``."""
    union = None
    for name, df in parts.items():
        x = df.select(F.lit(name).alias("layer"), "uid")
        union = x if union is None else union.unionByName(x)
    return union.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "uid", "layer")), "uid", "layer").limit(limit)


def session_status(messages: DataFrame, session: str, ts: str, now: float, idle_minutes: float = 30.0) -> DataFrame:
    """``session_id, units, first_ts, last_ts, active``: sessions and whether their last message is recent."""
    out = messages.where(F.col(session).isNotNull()).groupBy(F.col(session).alias("session_id")).agg(F.count("*").alias("units"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.withColumn("active", F.col("last_ts") >= now - idle_minutes * 60)
