import random

from palimpsest.operators.sessions import _classes, activity_sessions, segments, sessionize


def brute(rows, gaps):
    out = []
    for key in {k for k, t in rows if k is not None and t is not None}:
        if gaps.get(key) is None:
            continue
        times = sorted(t for k, t in rows if k == key and t is not None)
        start = last = times[0]
        n = 0
        for t in times:
            if t - last >= gaps[key]:
                out.append((key, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, last, last - start, n))
    return sorted(out)


def test_random_events_against_a_loop(spark):
    rng = random.Random(4)
    gaps = {"a": 7, "b": 10, "c": 1, "d": 35}
    rows = [(rng.choice(list(gaps)), rng.choice([rng.randint(-300, 3000), rng.randint(0, 60)])) for _ in range(1500)]
    rows += [(None, 3), ("a", None), ("b", 5), ("b", 5)]
    df = spark.createDataFrame([(k, t, gaps.get(k), "x") for k, t in rows], "key string, t bigint, gap bigint, _key string")
    got = sorted(tuple(r) for r in sessionize(df, "key", "t", "gap").collect())
    assert got == brute(rows, gaps)


def test_gaps_without_a_small_common_multiple(spark):
    gaps = {"a": 1_800_000_007, "b": 3_600_000_011, "c": 10_800_000_019}
    assert len(_classes(list(gaps.values()), 2**52)) > 1
    rng = random.Random(5)
    rows = [(rng.choice("abc"), 1_600_000_000_000_000 + rng.randint(0, 400) * 600_000_001) for _ in range(400)]
    df = spark.createDataFrame([(k, t, gaps[k]) for k, t in rows], "key string, t bigint, gap bigint")
    assert sorted(tuple(r) for r in sessionize(df, "key", "t", "gap").collect()) == brute(rows, gaps)


def test_segments_number_the_sessions(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 15), ("a", 24), ("a", 40)], "key string, t bigint")
    got = sorted(tuple(r) for r in segments(df, "key", "t", 10).collect())
    assert got == [("a", 0, 1), ("a", 5, 1), ("a", 15, 2), ("a", 24, 2), ("a", 40, 3)]


SCHEMA = "activity_id bigint, sample_id string, event_time timestamp_ntz, arrived_at timestamp_ntz, op string, char_count int"


def _dimensions(spark):
    samples = spark.createDataFrame([("s", "c"), ("s", "c"), ("no gap", "d"), (None, "c")], "sample_id string, config_id string")
    return samples, spark.createDataFrame([("c", 30), ("d", None)], "config_id string, hard_gap_minutes int")


def test_redelivered_unknown_and_null_rows(spark):
    from datetime import datetime as D

    samples, configs = _dimensions(spark)
    rows = [
        (1, "s", D(2024, 1, 1, 0, 0), None, "x", None), (1, "s", D(2024, 1, 1, 0, 0), D(2024, 1, 2), "x", None), (2, "s", D(2024, 1, 1, 0, 30), None, None, 1), (3, "s", None, None, None, None),
        (4, "s", D(1970, 1, 1), None, None, None), (5, None, D(2024, 1, 1), None, None, None), (6, "no gap", D(2024, 1, 1), None, None, None), (7, "unknown", D(2024, 1, 1), None, None, None), (None, "s", D(2024, 1, 1, 0, 29), None, None, None),
    ]
    got = [tuple(r) for r in activity_sessions(spark.createDataFrame(rows, SCHEMA), samples, configs).collect()]
    start = 1_704_067_200_000_000
    assert got == [("s", start, start + 1_800_000_000, 1_800_000_000, 3)]


def test_times_dont_depend_on_the_session_zone(spark):
    from datetime import datetime as D

    samples, configs = _dimensions(spark)
    df = spark.createDataFrame([(1, "s", D(2024, 3, 10, 2, 30), None, None, None)], SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert activity_sessions(df, samples, configs).first().start_time_us == 1_710_037_800_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_table(spark):
    samples, configs = _dimensions(spark)
    assert activity_sessions(spark.createDataFrame([], SCHEMA), samples, configs).count() == 0
