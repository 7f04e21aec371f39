import datetime as dt
import random

import pytest

from palimpsest.session import shared_path
from palimpsest.sources.store import load, manifest, read_version, save
from palimpsest.streaming.assignment import Open, Rules, assign_batch, assign_stream
from palimpsest.streaming.writes import merge_stream

DAY = 86_400_000_000


def random_messages(n=400, seed=6):
    rng = random.Random(seed)
    t, out = dict.fromkeys("ab", 19_000 * DAY), []
    for i in range(n):
        s = rng.choice("ab")
        t[s] += int(rng.choice([1, 3, 20, 50, 100, 170, 180, 400]) * 60_000_000 * rng.random() * 2)
        out.append((s, f"u{i:04d}", t[s], rng.choice(["by the way, ", ""]) + "x" * rng.choice([5, 50, 150, 4000]), rng.choice(["Ann", "Bob", None]), rng.choice([[1.0, 0.0], [0.0, 1.0], [0.7, 0.7], None])))
    return out


def by_hand(messages):
    out, state, number, name = {}, {}, {}, {}
    for s, uid, t, text, who, v in sorted(messages, key=lambda m: (m[0], m[2], m[1])):
        import numpy as np

        vector = np.array(v) if v else None
        current = state.get(s, Open())
        if current.splits(Rules(), t, text, who, vector):
            current, number[s] = Open(), number.get(s, 0) + 1
            name[s] = f"{s}::auto_session::{dt.datetime.fromtimestamp(t / 1e6, dt.UTC):%Y%m%d}_{number[s]:04d}"
        current.add(t, text, who, vector)
        state[s], out[uid] = current, name[s]
    return out


SCHEMA = "sample_id string, uid string, t bigint, text string, who string, v array<double>"


def test_batch_against_a_loop(spark):
    messages = random_messages()
    got = {r.uid: r.session_id for r in assign_batch(spark.createDataFrame(messages, SCHEMA)).collect()}
    assert got == by_hand(messages) and len(set(got.values())) > 20


def test_rules():
    long, now = "x" * 250, 19_000 * DAY + 3600_000_000
    s = Open()
    assert s.splits(Rules(), now, "hi", None, None)
    s.add(now, long, "Ann", None)
    assert not s.splits(Rules(), now + 179 * 60_000_000, "hi", "Ann", None)
    assert s.splits(Rules(), now + 180 * 60_000_000, "hi", "Ann", None)
    assert s.splits(Rules(), now + 1, "y" * 12_000, "Ann", None)
    assert not s.splits(Rules(), now - DAY // 48, "hi", "Ann", None)  # a late row has no gap
    s.units = 80
    assert s.splits(Rules(), now, "hi", "Ann", None)


def test_stream_agrees_with_batch(spark):
    messages = random_messages(120, 7)
    path, out = shared_path(spark, "stream-in"), shared_path(spark, "stream-out")
    ordered = sorted(messages, key=lambda m: m[2])
    rows = [(*m, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i, m in enumerate(ordered)]
    schema = SCHEMA + ", arrived timestamp"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = assign_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.uid: r.session_id for r in spark.read.parquet(out).collect()}
    assert got == by_hand(messages)


def test_merge_stream_and_snapshot(spark):
    path, store = shared_path(spark, "requests"), shared_path(spark, "store")
    schema = "uid string, text string, at int"
    for rows in ([("a", "1", 1), ("b", "1", 1)], [("a", "2", 3), ("a", "0", 2), ("c", "1", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        merge_stream(spark, spark.readStream.schema(schema).parquet(path), store, store + "-state", "at").awaitTermination()
    assert sorted(tuple(r) for r in read_version(spark, store).collect()) == [("a", "2", 3), ("b", "1", 1), ("c", "1", 1)]
    folder = shared_path(spark, "snapshot")
    save({"units": read_version(spark, store)}, folder, {"units": "at"}, {"stage": "done"})
    assert load(spark, folder)["units"].count() == 3 and manifest(spark, folder)["state"] == {"stage": "done"}
    with pytest.raises(FileNotFoundError):
        load(spark, folder + "-none")
