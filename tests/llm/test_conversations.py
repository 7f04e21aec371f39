import datetime as dt
import time

import pytest

from palimpsest.llm import conversations
from palimpsest.llm.conversations import arrival_disorder, rebuild_conversations
from palimpsest.session import shared_path

SCHEMA = "uid string, sample_id string, session_id string, role string, message_index int, timestamp double, text_content string, ingested_at timestamp_ntz, blank string"


def row(uid, session, role, at=None, ts=None, text="hello", sample="s", minute=0):
    return (uid, sample, session, role, at, ts, text, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), None)


ROWS = [
    # in order of position, with a redelivered row, a late one, a system turn and a blank one that still counts
    row("a2", "A", "AI", 2, 5.0, minute=900), row("a0", "A", "Human", 0), row("a1", "A", " system", 1), row("a0", "A", "Human", 0, minute=50), row("a3", "A", "USER", 3, text=" \n"), row("a4", "A", "Tally", 4),
    # by time; the user goes by name
    row("b2", "B", "assistant", ts=20.0), row("b1", "B", "Ann", ts=10.0),
    row("c0", "C", "user", 0), row("c2", "C", "assistant", 2),  # lost row
    row("d0", "D", "user", 0), row("d1", "D", "narrator", 1),  # unknown role
    row("e0", "E", "user", ts=1.0), row("e1", "E", "assistant", ts=0.0),  # unknown time
    row("f0", "F", "assistant", 0), row("f1", "F", "user", 1),  # wrong ends
    row("g0", "G", "user", 0), row("g1", "G", "assistant", 1, text=None),  # unanswered
    row("h0", "H", "system", 0),  # only a system turn
    row("i0", "I", "user", 0), row("i1", "I", "assistant", None),  # a position missing
    row("j0", None, "user", 0), row("j1", None, "assistant", 1),
    row("k0", "K", "user", 0, sample=None), row("k1", "K", "bot", 1, sample="unknown"),
    row("l0", "L", "user", 0), row("l1", "L", "assistant", 0), row("l2", "L", "assistant", 1),  # a position twice
]
WANT = [("A", 1, "a0"), ("A", 2, "a1"), ("A", 3, "a2"), ("A", 4, "a4"), ("B", 1, "b1"), ("B", 2, "b2"), ("K", 1, "k0"), ("K", 2, "k1")]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([("s", "Ann", "Tally"), ("s", "Ann", "Tally"), (None, "x", "y")], "sample_id string, user_name string, agent_name string")


def stored(spark, rows, files=1):
    path = shared_path(spark, "messages") + ".parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return path


def shown(df):
    return sorted((r.session_id, r.turn_no, r.uid) for r in df.collect())


def test_sound_conversations(spark, samples):
    assert shown(rebuild_conversations(spark, stored(spark, ROWS), samples)) == WANT


def in_turn(spark, parts):
    """A table whose files were written one after the other."""
    path = shared_path(spark, "messages") + ".parquet"
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_late_rows_in_bounded_batches(spark, samples):
    # a2 comes 15 hours after its conversation, behind rows of later ones; "Z" closes in between and opens again.
    later = [row("z0", "Z", "user", 0, minute=100), row("y0", "Y", "user", 0, minute=90_000), row("y1", "Y", "bot", 1, minute=90_001), row("z1", "Z", "bot", 1, minute=200_000), row("z0", "Z", "user", 0, minute=200_001)]
    parts = [ROWS[1:4], later[:3], later[3:], [ROWS[0], *ROWS[4:]]]
    path = in_turn(spark, parts)
    want = sorted([*WANT, ("Y", 1, "y0"), ("Y", 2, "y1"), ("Z", 1, "z0"), ("Z", 2, "z1")])
    assert arrival_disorder(spark.read.parquet(path)) == 200_001 * 60
    assert shown(rebuild_conversations(spark, path, samples, timeout="1 hour", files_per_batch=1)) == want
    with pytest.raises(ValueError, match="of 31 message rows arrived later"):
        rebuild_conversations(spark, path, samples, timeout="1 hour", lateness="1 minute", files_per_batch=1)


def test_conversations_in_many_pieces(spark, samples, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_POSITIONS", 2)
    monkeypatch.setattr(conversations, "PIECE_SECONDS", 5)
    monkeypatch.setattr(conversations, "PIECES_PER_BUCKET", 2)
    long = [row(f"m{i:02d}", "M", "user" if i % 2 == 0 else "bot", i, minute=(i * 7) % 20) for i in range(20)]
    long += [row(f"n{i}", "N", "user" if i % 2 == 0 else "bot", ts=3.0 * i + 1, text="" if i == 2 else "x") for i in range(6)] + [row(f"o{i}", "O", "user" if i % 2 == 0 else "bot", i) for i in range(8) if i != 5]
    want = sorted([*WANT, *(("M", i + 1, f"m{i:02d}") for i in range(20)), *(("N", i + 1, u) for i, u in enumerate(["n0", "n1", "n3", "n4", "n5"]))])
    assert shown(rebuild_conversations(spark, stored(spark, ROWS + long), samples)) == want


def test_empty_table(spark, samples):
    assert shown(rebuild_conversations(spark, stored(spark, []), samples)) == []
