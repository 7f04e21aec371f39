"""Conversations rebuilt from message rows, by a stateful stream."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.running import running_sum
from palimpsest.session import drop_shared, setting, shared_path, written

# Ways of writing the roles, besides the names of the sample's user and agent.
USER_ROLES = ("user", "human", "usr", "customer", "client", "prompter", "questioner")
ASSISTANT_ROLES = ("assistant", "ai", "bot", "model", "agent", "gpt", "chatbot", "llm", "asst")
SYSTEM_ROLES = ("system", "sys", "developer")

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECES = "session_id string, piece bigint, rows array<struct<uid:string,at:bigint,ts:double,role:string,blank:boolean>>, n_rows int"
#: Positions, and seconds for conversations without positions, that one state value holds: its size is bounded by these, not by the session's.
PIECE_POSITIONS = 4096
PIECE_SECONDS = 600
#: Pieces of a conversation whose turns are numbered in one task.
PIECES_PER_BUCKET = 1024
#: Bytes of message files in one micro-batch.
BATCH_BYTES = 256 << 30
#: The instant that closes a stream: later than any arrival.
CLOSING = datetime.datetime(9000, 1, 1)


def blank(text: Column) -> Column:
    """Whether a text is null or only white space, no-break spaces included."""
    return ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def role_of(role: Column, user_name: Column, agent_name: Column) -> Column:
    """'user', 'assistant' or 'system'; null where it can't be told. The sample's names are compared
    first, so that a user named like a role word is still the user."""
    trim = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    said = trim(role)
    return (
        F.when(said == "", None)
        .when(said == trim(user_name), "user")
        .when(said == trim(agent_name), "assistant")
        .when(said.isin(*USER_ROLES), "user")
        .when(said.isin(*ASSISTANT_ROLES), "assistant")
        .when(said.isin(*SYSTEM_ROLES), "system")
    )


def _slim(messages: DataFrame, samples: DataFrame) -> DataFrame:
    """What a conversation's soundness depends on; texts stay in their table."""
    names = samples.select("sample_id", "user_name", "agent_name").where("sample_id is not null").dropDuplicates(["sample_id"])
    ts = F.col("timestamp")
    return (
        messages.select("uid", "session_id", "sample_id", "role", "message_index", "timestamp", "text_content", "ingested_at")
        .where("session_id is not null")
        .join(names, "sample_id", "left")
        .select(
            "session_id", F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0))).alias("arrived"), "uid",
            F.col("message_index").cast("bigint").alias("at"), F.when((ts != 0) & ~F.isnan(ts), ts).alias("ts"),
            role_of(F.col("role"), F.col("user_name"), F.col("agent_name")).alias("role"), blank(F.col("text_content")).alias("blank"),
        )
    )


def conversation_stream(messages: DataFrame, samples: DataFrame, timeout: str, lateness: str) -> DataFrame:
    """The streaming plan: rows are buffered in keyed state and leave it when the watermark has passed the last arrival
    by ``timeout`` (their conversation is closed). The event time is that of arrival; rows arriving up to
    ``lateness`` behind the newest one are kept. The key is the session and the piece of it, a stretch of positions or of time, so
    that a session of any size is many bounded state values."""
    slim = _slim(messages, samples).withWatermark("arrived", lateness)
    piece = F.coalesce(F.floor(F.col("at") / PIECE_POSITIONS), F.floor(F.col("ts") / PIECE_SECONDS), F.lit(0)).cast("bigint").alias("piece")
    buffered = slim.groupBy("session_id", piece, F.session_window("arrived", timeout)).agg(F.collect_list(F.struct("uid", "at", "ts", "role", "blank")).alias("rows"))
    return buffered.select("session_id", "piece", "rows", F.size("rows").alias("n_rows"))


def validated(closed: DataFrame) -> DataFrame:
    """The turns ``session_id, turn_no, uid, role`` of the sound conversations among closed pieces (``PIECES``).

    A piece that was closed and opened again by a late row is put together first. A piece is sorted and summed up in arrays; a
    conversation is judged by the sums of its pieces, and its turns are numbered by running sums over them. No step gathers
    a conversation in one place.
    """
    # Each step is a column of its own, so that no sort is repeated in a later one.
    x = closed.groupBy("session_id", "piece").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    x = x.select("session_id", "piece", F.sort_array("rows").alias("sorted"))  # by uid first
    x = x.select("session_id", "piece", F.filter("sorted", lambda r, i: r.uid.isNull() | (i == 0) | ~r.uid.eqNullSafe(F.get(F.col("sorted"), i - 1)["uid"])).alias("once"))
    shape = lambda r: F.struct(r["at"].alias("at"), r.ts.alias("ts"), r.uid.alias("uid"), r.role.alias("role"), r.blank.alias("blank"))
    # Where all rows have a position, no two of a sound conversation have the same; else the time decides, then the uid.
    x = x.select("session_id", "piece", F.sort_array(F.transform("once", shape)).alias("rows"))
    x = x.select("session_id", "piece", "rows", F.get("rows", F.lit(0))["at"].alias("low"), F.filter("rows", lambda r: ~r.blank).alias("turns"))
    x = x.select("*", F.filter("turns", lambda r: r.role != "system").alias("spoken"))
    all_of = lambda test: F.forall("rows", test)
    in_place = F.col("low").isNotNull() & F.forall(F.transform("rows", lambda r, i: r["at"].eqNullSafe(F.col("low") + i)), lambda ok: ok)
    last = F.get("spoken", F.size("spoken") - 1)["role"]
    pieces = written(
        x.select(
            "session_id", "piece", "low", F.size("rows").alias("n"), all_of(lambda r: r.role.isNotNull()).alias("told"), all_of(lambda r: r["at"].isNull() & r.ts.isNotNull()).alias("timed"), in_place.alias("in_place"),
            F.get("spoken", F.lit(0))["role"].alias("first"), last.alias("last"), F.size("turns").alias("n_turns"), F.transform("turns", lambda r: F.struct(r.uid.alias("uid"), r.role.alias("role"))).alias("turns"),
        ),
        "conversation-pieces",
    )
    at = F.when(F.col("first").isNotNull(), F.col("piece"))
    judged = pieces.groupBy("session_id").agg(
        F.sum("n").alias("n"), F.bool_and("told").alias("told"), F.bool_and("timed").alias("timed"), F.bool_and("in_place").alias("in_place"), F.min("low").alias("low"),
        F.max(F.col("low") + F.col("n") - 1).alias("high"), F.min_by("first", at).alias("first"), F.max_by("last", at).alias("last"),
    )
    # Positions of different pieces differ, and those of a piece follow each other: n of them from 0 to n - 1 are all of them.
    sound = judged.where("told and (timed or (in_place and low = 0 and high = n - 1)) and first = 'user' and last = 'assistant'").select("session_id")
    slim = pieces.select("session_id", "piece", F.floor(F.col("piece") / PIECES_PER_BUCKET).alias("bucket"), "n_turns").join(sound, "session_id")
    offset = running_sum(slim, ["session_id"], "bucket", [F.col("piece")], F.col("n_turns"), "upto").select("session_id", "piece", (F.col("upto") - F.col("n_turns")).alias("before"))
    numbered = pieces.select("session_id", "piece", "turns").join(offset, ["session_id", "piece"]).select("session_id", "before", F.posexplode("turns").alias("i", "turn"))
    return numbered.select("session_id", (F.col("before") + F.col("i") + 1).cast("int").alias("turn_no"), "turn.uid", "turn.role")


def arrival_disorder(messages: DataFrame) -> int:
    """By how many seconds a row can arrive behind one that an earlier micro-batch has read. A stream takes files
    in order of their modification, each as a whole; files of the same modification time may come in any order."""
    arrived = F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0)))
    files = messages.where("session_id is not null").select("_metadata.file_path", "_metadata.file_modification_time", F.unix_micros(arrived.cast("timestamp")).alias("us")).groupBy("file_path", "file_modification_time").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    times = files.groupBy("file_modification_time").agg(F.count("*").alias("files"), F.min("low").alias("low"), F.max("high").alias("high"))
    # One row for each modification time.
    earlier = F.max("high").over(Window.orderBy("file_modification_time").rowsBetween(Window.unboundedPreceding, -1))
    behind = times.select(F.greatest(earlier - F.col("low"), F.when(F.col("files") > 1, F.col("high") - F.col("low")), F.lit(0)).alias("us"))
    return math.ceil((behind.agg(F.max("us")).first()[0] or 0) / 1_000_000)


def rebuild_conversations(
    spark: SparkSession, messages_path: str, samples: DataFrame, timeout: str = "14 days", lateness: str | None = None, batch_bytes: int = BATCH_BYTES, files_per_batch: int | None = None, partitions: int | None = None
) -> DataFrame:
    """The turns ``session_id, turn_no, uid, role`` of each sound conversation of a table of messages.

    The parquet at ``messages_path`` is read as a stream in micro-batches of ``batch_bytes`` (or ``files_per_batch`` files) and buffered in
    keyed state with an event-time watermark; see ``conversation_stream``. A piece of a conversation leaves the
    state when nothing has arrived for it in ``timeout``; when the files are used up, a closing row moves
    the watermark past all that are still open. ``validated`` judges the closed conversations.

    No row is lost to the watermark: ``lateness`` is by default the disorder of the files (``arrival_disorder``),
    and if one given is too short, so that closed rows are fewer than stored ones, an error says how many. A row that comes
    after its conversation was closed opens it again, and both parts are judged together; so neither ``timeout`` nor ``lateness`` changes the result.

    Rows with a null session belong to none; rows of a repeated uid count once (rows with a null uid each
    count; rows of one uid that contradict each other by more than a piece of positions count once for each piece); a conversation without any
    message_index is ordered by timestamp, equal ones by uid; negative positions make a conversation
    unsound. Samples that aren't known have no names; roles are then judged by words alone. A null ``ingested_at`` is the earliest arrival.
    """
    static = spark.read.parquet(messages_path)
    out, state, closing = (shared_path(spark, f"conversations-{x}") for x in ("closed", "state", "closing"))
    fields = [f for f in static.schema if f.name in ("uid", "session_id", "sample_id", "role", "message_index", "timestamp", "text_content", "ingested_at")]
    schema = T.StructType(fields)
    spark.createDataFrame([], schema).write.parquet(closing)
    glob = f"{messages_path[:-1]}[{messages_path[-1]}]"  # a stream may read one file only by a pattern
    lateness = lateness or f"{arrival_disorder(static)} seconds"
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", batch_bytes)

    def close() -> None:
        row = {f.name: None for f in fields} | {"session_id": "", "ingested_at": CLOSING, "uid": ""}
        spark.createDataFrame([tuple(row[f.name] for f in fields)], schema).coalesce(1).write.mode("append").parquet(closing)

    def run() -> None:
        stream = spark.readStream.schema(static.schema).option(*limit).parquet(glob).select(*schema.fieldNames()).unionByName(spark.readStream.schema(schema).parquet(closing))
        pieces = conversation_stream(stream, samples, timeout, lateness)
        query = pieces.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).option("path", out).start()
        query.awaitTermination()

    with setting(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, **({"spark__sql__shuffle__partitions": str(partitions)} if partitions else {})):
        run()
        close()
        run()
    closed = spark.read.schema(PIECES).parquet(out)
    stored, found = static.where("session_id is not null").count(), closed.agg(F.sum("n_rows")).first()[0] or 0
    # The closing row never leaves the state itself.
    if stored != found:
        raise ValueError(f"{stored - found} of {stored} message rows arrived later than {lateness} behind others and were dropped; give a longer lateness")
    turns = validated(closed)
    for path in (state, closing, out):
        drop_shared(spark, path)
    return turns
