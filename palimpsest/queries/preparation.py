"""The general preparation problems: times (2) and sessions (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.sessions import activity_sessions
from palimpsest.operators.timestamps import normal_times
from palimpsest.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = normal_times(table(spark, folder, "entity_mentions"), table(spark, folder, "episodic_facts"), table(spark, folder, "chat_samples"))
    return found.where("normal_form is not null").select("record_id", "field_name", "normal_form")


def p2_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Values without a normal form, by field."""
    found = normal_times(table(spark, folder, "entity_mentions"), table(spark, folder, "episodic_facts"), table(spark, folder, "chat_samples"))
    return found.groupBy("field_name").agg({"*": "count", "normal_form": "count"}).withColumnsRenamed({"count(1)": "stated", "count(normal_form)": "readable"})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_sessions(spark, folder).select("sample_id", "start_time_us", "last_time_us", "unit_count")


def p5_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return activity_sessions(table(spark, folder, "activity_log"), table(spark, folder, "chat_samples"), table(spark, folder, "orchestrator_configs"))


QUERIES = {"p2_found": p2_found, "p2_unreadable": p2_unreadable, "p5_found": p5_found, "p5_sessions": p5_sessions}

_SESSIONS = """
with known as (
  select activity_id, min(epoch_us(event_time)) as t, any_value(sample_id) as sample_id from activity_log
  where event_time is not null and epoch_us(event_time) <> 0 group by activity_id),
placed as (
  select k.sample_id, k.t, k.activity_id, c.hard_gap_minutes * 60000000::bigint as gap
  from known k join chat_samples s using (sample_id) join orchestrator_configs c using (config_id)),
marked as (
  select *, case when t - lag(t) over w < gap then 0 else 1 end as begins from placed window w as (partition by sample_id order by t, activity_id)),
numbered as (
  select *, sum(begins) over (partition by sample_id order by t, activity_id rows unbounded preceding) as no from marked)
"""
ORACLES = {
    "p5_found": _SESSIONS + "select sample_id, min(t) as start_time_us, max(t) as last_time_us, count(*) as unit_count from numbered group by sample_id, no",
    "p5_sessions": _SESSIONS + "select sample_id, min(t) as start_time_us, max(t) as last_time_us, max(t) - min(t) as duration_us, count(*) as unit_count from numbered group by sample_id, no",
}
