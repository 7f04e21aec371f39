"""Sessions of activity: start-end pairing over distributed windows."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.time import utc_micros
from palimpsest.session import written

US_PER_MINUTE = 60_000_000
#: Largest scaled time that still leaves room for adding a gap in a bigint.
MAX_SCALED = 2**62
#: Width of a time bucket, in gaps. A bucket of a key is the unit of work; wider buckets copy fewer
#: border events, narrower ones bound the work of a busy key more tightly.
GAPS_PER_BUCKET = 16


def known_time_us(events: DataFrame, column: str = "event_time") -> Column:
    """Microseconds since 1970-01-01 UTC; null for null and for the instant 0, which means unknown."""
    us = utc_micros(events, column)
    return F.when(us != 0, us)


def sessionize(events: DataFrame, key: str, time_us: str, gap_us: str, count: str | None = None, horizon_us: int = 2**52, gaps: list[int] | None = None) -> DataFrame:
    """Split each key's events into sessions: a gap of at least ``gap_us`` starts a new one.

    ``events`` has a key, a bigint time, the key's gap in microseconds (one value per key), and
    optionally the number of operations a row stands for. ``gaps`` are the distinct gaps, if the caller knows them;
    else they are looked up in the events. Returns ``key, start_time_us, last_time_us,
    duration_us, unit_count``. Rows with a null key, time or gap, or a gap below 1, belong to no
    session. Equal times are one point in time with a count. Other columns are ignored.

    Method (start-end pairing): over distinct times, RANGE frames find times without a predecessor
    (starts) and without a successor (ends) nearer than the gap; starts and ends are numbered
    separately and joined by equal number (both lie in one table of borders, so the join is one aggregate by key and
    number); the number of operations is the difference of the running counts at the two. What the frames find is written to the
    shared folder, since numbers and bucket totals both need it. The gaps differ by key, but a frame needs one literal width: times are scaled
    so that every gap becomes the least common multiple of the distinct gaps. Gaps whose multiple
    would overflow form further classes, each handled in its own branch.

    A key may hold a third of all rows, so nothing is partitioned by the key alone: the frames run
    over (key, time bucket), with events near a border copied as silent witnesses to the bucket
    beside it, and the numbering adds prefix sums of bucket totals.
    """
    rows = events.select(
        F.col(key).alias("_key"), F.col(time_us).cast("bigint").alias("_t"), F.col(gap_us).cast("bigint").alias("_gap"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("_n")
    ).where("_key is not null and _t is not null and _gap >= 1")
    points = rows.groupBy("_key", "_gap", "_t").agg(F.sum("_n").alias("_n"))
    return _paired(points, key, horizon_us, gaps)


def segments(events: DataFrame, key: str, time_us: str, gap_us: int) -> DataFrame:
    """``key, time_us, segment``: each distinct time of a key with the number, from 1, of the session it falls into."""
    points = events.select(F.col(key).alias("_key"), F.col(time_us).cast("bigint").alias("_t"), F.lit(gap_us).cast("bigint").alias("_gap")).where("_key is not null and _t is not null").groupBy("_key", "_gap", "_t").agg(F.count("*").alias("_n"))
    return _numbered(points, gap_us).select(F.col("_key").alias(key), F.col("_t").alias(time_us), (F.col("_start_no") + F.col("_off_starts")).alias("segment"))


def _classes(gaps: list[int], horizon_us: int) -> list[tuple[int, list[int]]]:
    """Gaps in classes with a common multiple that keeps scaled times within a bigint."""
    out: list[tuple[int, list[int]]] = []
    for gap in sorted(gaps):
        for i, (common, members) in enumerate(out):
            joint = lcm(common, gap)
            if joint // min(members) * horizon_us <= MAX_SCALED:
                out[i] = (joint, [*members, gap])
                break
        else:
            out.append((gap, [gap]))
    return out


def _paired(points: DataFrame, key: str, horizon_us: int, gaps: list[int] | None) -> DataFrame:
    # The gaps are settings of configurations, not data: a handful of distinct values.
    known = sorted({g for g in gaps if g >= 1}) if gaps is not None else [r[0] for r in points.select("_gap").distinct().collect()]
    classes = _classes(known, horizon_us)
    parts = [_one_class(points if len(classes) == 1 else points.where(F.col("_gap").isin(members)), common) for common, members in classes]
    if not parts:
        parts = [_one_class(points, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("_key").alias(key), "start_time_us", "last_time_us", (F.col("last_time_us") - F.col("start_time_us")).alias("duration_us"), "unit_count")


def _numbered(points: DataFrame, common: int, borders_only: bool = False) -> DataFrame:
    """Distinct times with ``_is_start, _is_end``, running counts within the bucket and offsets of the buckets before."""
    width = common * GAPS_PER_BUCKET
    scaled = points.withColumn("_s", F.col("_t") * F.expr(f"{common} div _gap"))
    bucket = F.expr(f"cast(floor(_s / {width}D) as bigint)")
    # The double above may be off by one near a border of huge values; settle it in integers.
    bucket = bucket + F.when(F.col("_s") < bucket * width, -1).when(F.col("_s") >= (bucket + 1) * width, 1).otherwise(0)
    scaled = scaled.withColumn("_b", bucket)
    offset = F.col("_s") - F.col("_b") * width
    homes = F.array_compact(
        F.array(F.col("_b"), F.when(offset < common, F.col("_b") - 1), F.when(offset >= width - common, F.col("_b") + 1))
    )
    spread = scaled.withColumn("_home", F.explode(homes)).withColumn("_own", F.col("_home") == F.col("_b"))

    near = Window.partitionBy("_key", "_home").orderBy("_s")
    marked = (
        spread.withColumn("_before", F.count("*").over(near.rangeBetween(1 - common, -1)))
        .withColumn("_after", F.count("*").over(near.rangeBetween(1, common - 1)))
        .where("_own")
        .select("_key", F.col("_home").alias("_b"), "_t", "_n", (F.col("_before") == 0).alias("_is_start"), (F.col("_after") == 0).alias("_is_end"))
    )
    marked = written(marked, "session-borders")
    running = Window.partitionBy("_key", "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = marked.select(
        "*",
        F.sum("_n").over(running).alias("_upto"),
        F.sum(F.col("_is_start").cast("bigint")).over(running).alias("_start_no"),
        F.sum(F.col("_is_end").cast("bigint")).over(running).alias("_end_no"),
    )
    earlier = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_key", "_b").agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_is_start").cast("bigint")).alias("_starts"), F.sum(F.col("_is_end").cast("bigint")).alias("_ends")
    )
    offsets = totals.select("_key", "_b", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off{c}") for c in ("_n", "_starts", "_ends")))
    if borders_only:
        ranked = ranked.where("_is_start or _is_end")
    return ranked.join(offsets, ["_key", "_b"])


def _one_class(points: DataFrame, common: int) -> DataFrame:
    border = _numbered(points, common, borders_only=True)
    upto = F.col("_upto") + F.col("_off_n")
    nothing = F.lit(None).cast("bigint")
    shape = lambda no, start, before, last, upto: F.struct(no.alias("_no"), start.alias("start"), before.alias("before"), last.alias("last"), upto.alias("upto"))
    start = F.when(F.col("_is_start"), shape(F.col("_start_no") + F.col("_off_starts"), F.col("_t"), upto - F.col("_n"), nothing, nothing))
    end = F.when(F.col("_is_end"), shape(F.col("_end_no") + F.col("_off_ends"), nothing, nothing, F.col("_t"), upto))
    ends = border.select("_key", F.explode(F.array_compact(F.array(start, end))).alias("_x")).select("_key", "_x.*")
    pair = ends.groupBy("_key", "_no").agg(*(F.max(c).alias(c) for c in ("start", "before", "last", "upto")))
    return pair.select("_key", F.col("start").alias("start_time_us"), F.col("last").alias("last_time_us"), (F.col("upto") - F.col("before")).alias("unit_count"))


def activity_sessions(activity: DataFrame, samples: DataFrame, configs: DataFrame) -> DataFrame:
    """Sessions of each sample's operations: ``sample_id, start_time_us, last_time_us, duration_us,
    unit_count``.

    Redelivered rows (same ``activity_id``) count once, by their smallest known time; rows without an
    id can't be told from redeliveries of each other and each count. Operations of unknown time (null
    or 1970-01-01 00:00:00), and of samples without a gap, are left out.
    """
    gaps = samples.select("sample_id", "config_id").dropna().dropDuplicates(["sample_id"]).join(
        configs.select("config_id", (F.col("hard_gap_minutes").cast("bigint") * US_PER_MINUTE).alias("_gap_us")).dropna().dropDuplicates(["config_id"]), "config_id"
    ).select("sample_id", "_gap_us")
    known = activity.select("activity_id", "sample_id", known_time_us(activity).alias("_time_us")).where("_time_us is not null and sample_id is not null")
    with_id = known.where("activity_id is not null").groupBy("activity_id").agg(F.min(F.struct("_time_us", "sample_id")).alias("_x")).select("_x.sample_id", "_x._time_us")
    rows = with_id.unionByName(known.where("activity_id is null").select("sample_id", "_time_us"))
    settings = [r[0] for r in gaps.select("_gap_us").distinct().collect()]  # a few configurations
    return sessionize(rows.join(gaps, "sample_id"), "sample_id", "_time_us", "_gap_us", gaps=settings)
