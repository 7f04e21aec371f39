"""Messages assigned to sessions by time, length, topic and participants: as a batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.sessions import US_PER_MINUTE, segments
from palimpsest.session import ship

# Phrases that announce a new topic.
NEW_TOPIC = ("另外", "换个话题", "还有一件事", "接下来", "帮我", "请你", "new topic", "another question", "by the way")


@dataclass(frozen=True)
class Rules:
    hard_gap: float = 180.0
    soft_gap: float = 45.0
    topic: float = 0.42
    boundary: float = 0.65
    most_units: int = 80
    most_chars: int = 12_000
    few_units: int = 2
    few_chars: int = 200


@dataclass
class Open:
    """The session that is open: counts, last time (microseconds), participants, and the sum of its unit vectors."""

    units: int = 0
    chars: int = 0
    last: int = 0
    people: set = field(default_factory=set)
    topic: np.ndarray | None = None

    def splits(self, r: Rules, t: int, text: str, who: str | None, vector: np.ndarray | None) -> bool:
        """Whether a message begins a new session."""
        if not self.units or self.units >= r.most_units or self.chars + len(text) > r.most_chars:
            return True
        gap = max(0.0, (t - self.last) / US_PER_MINUTE)
        if gap >= r.hard_gap:
            return True
        new_day = t // 86_400_000_000 != self.last // 86_400_000_000
        grown = self.units >= r.few_units or self.chars >= r.few_chars
        if not grown:
            return False
        if new_day:
            return True
        score = 0.25 + min(0.10, 0.10 * (gap - r.soft_gap) / max(1.0, r.hard_gap - r.soft_gap)) if gap >= r.soft_gap else 0.0
        if vector is not None and self.topic is not None:
            norms = np.linalg.norm(vector) * np.linalg.norm(self.topic)
            if norms > 0 and 1 - float(vector @ self.topic) / norms >= r.topic:
                score += 0.35
        if who and self.people and who not in self.people:
            score += 0.12
        if any(p in text.lower() for p in NEW_TOPIC):
            score += 0.10
        return score >= r.boundary

    def add(self, t: int, text: str, who: str | None, vector: np.ndarray | None) -> None:
        self.units, self.chars, self.last = self.units + 1, self.chars + len(text), t
        if who:
            self.people.add(who)
        if vector is not None:
            self.topic = vector if self.topic is None else self.topic + vector


def _starts(rows: pd.DataFrame, r: Rules, state: Open) -> tuple[list[bool], Open]:
    out = []
    for t, text, who, v in zip(rows["t"], rows["text"], rows["who"], rows["v"], strict=True):
        text = text if isinstance(text, str) else ""
        who = who if isinstance(who, str) else None
        vector = np.asarray(v, dtype=np.float64) if v is not None and not isinstance(v, float) else None
        new = state.splits(r, int(t), text, who, vector)
        if new:
            state = Open()
        state.add(int(t), text, who, vector)
        out.append(new)
    return out, state


def _prepared(messages: DataFrame) -> DataFrame:
    v = F.col("v").cast("array<double>") if "v" in messages.columns else F.lit(None).cast("array<double>")
    return messages.select("sample_id", "uid", F.col("t").cast("bigint").alias("t"), "text", "who", v.alias("v")).where("sample_id is not null and uid is not null and t is not null")


def session_name(sample: str = "sample_id", start: str = "start", number: str = "number") -> F.Column:
    return F.concat(F.regexp_replace(sample, r"[^A-Za-z0-9_.:-]+", "_"), F.lit("::auto_session::"), F.date_format(F.timestamp_micros(start), "yyyyMMdd"), F.lit("_"), F.lpad(F.col(number).cast("string"), 4, "0"))


def assign_batch(messages: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``sample_id, uid, session_id``: messages (``sample_id, uid, t`` in microseconds, ``text, who``, optionally a vector ``v``) in order of time, then uid.

    A gap of ``hard_gap`` begins a session whatever came before, so a sample is first cut there (``segments``), and each piece is one task: a
    busy sample is many tasks. Messages of unknown time are left out.
    """
    ship(messages.sparkSession)
    rows = _prepared(messages)
    pieces = segments(rows, "sample_id", "t", int(rules.hard_gap * US_PER_MINUTE))
    cut = rows.join(pieces, ["sample_id", "t"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Pieces come one after the other, in order of time; a piece may go on in the next batch.
        key, state, number = None, Open(), 0
        for b in batches:
            within = np.zeros(len(b), dtype=np.int64)
            keys = list(zip(b["sample_id"], b["segment"], strict=True))
            i = 0
            while i < len(b):
                j = i
                while j < len(b) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key:
                    key, state, number = keys[i], Open(), 0
                starts, state = _starts(b.iloc[i:j], rules, state)
                within[i:j] = number + np.cumsum(starts)
                number = int(within[j - 1])
                i = j
            yield pd.DataFrame({"sample_id": b["sample_id"], "segment": b["segment"], "uid": b["uid"], "t": b["t"], "within": within})

    ordered = cut.repartition("sample_id", "segment").sortWithinPartitions("sample_id", "segment", "t", "uid")
    placed = ordered.mapInPandas(run, "sample_id string, segment bigint, uid string, t bigint, within bigint")
    each = placed.groupBy("sample_id", "segment").agg(F.max("within").alias("n"))
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sample_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.join(before.select("sample_id", "segment", "before"), ["sample_id", "segment"]).withColumn("number", F.col("within") + F.col("before"))
    first = numbered.groupBy("sample_id", "number").agg(F.min("t").alias("start"))
    return numbered.join(first, ["sample_id", "number"]).select("sample_id", "uid", session_name().alias("session_id"))


STATE = "number long, start long, units long, chars long, last long, people array<string>, topic array<double>"


def assign_stream(messages: DataFrame, rules: Rules = Rules(), keep: str = "2 days") -> DataFrame:  # noqa: B008
    """The same over a stream, in keyed state; ``messages`` also has ``arrived`` for the watermark. Within a micro-batch rows are put in order of time; a row
    older than what was seen has a gap of 0. A sample's state is dropped when the watermark is ``keep`` past its last arrival, and its numbering begins anew."""
    ship(messages.sparkSession)
    v = F.col("v").cast("array<double>") if "v" in messages.columns else F.lit(None).cast("array<double>")
    rows = messages.withWatermark("arrived", "0 seconds").select("sample_id", "uid", F.col("t").cast("bigint").alias("t"), "text", "who", v.alias("v"), "arrived").where("sample_id is not null and uid is not null and t is not null")
    hold = pd.Timedelta(keep)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, start, current = 0, 0, Open()
        if state.exists:
            number, start, units, chars, last, people, topic = state.get
            current = Open(units, chars, last, set(people or ()), np.array(topic) if topic is not None else None)
        got = pd.concat(list(parts)).sort_values(["t", "uid"])
        begins, current = _starts(got, rules, current)
        numbers, firsts = [], []
        for t, new in zip(got["t"], begins, strict=True):
            if new:
                number, start = number + 1, int(t)
            numbers.append(number)
            firsts.append(start)
        state.update((number, start, current.units, current.chars, current.last, sorted(current.people), current.topic.tolist() if current.topic is not None else None))
        state.setTimeoutTimestamp(max(int((got["arrived"].max() + hold).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"sample_id": got["sample_id"], "uid": got["uid"], "start": firsts, "number": numbers})

    out = rows.groupBy("sample_id").applyInPandasWithState(run, "sample_id string, uid string, start long, number long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("sample_id", "uid", session_name().alias("session_id"))
