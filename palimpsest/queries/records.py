"""Messages, facts and entities in order; merging; summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import normalized_answer
from palimpsest.functions.time import utc_micros
from palimpsest.operators import dialogue, merging, metrics, sessions, units
from palimpsest.queries.retrieval import DIM
from palimpsest.queries.stores import edges, nodes
from palimpsest.sources.tables import table
from palimpsest.streaming.assignment import assign_batch


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each message once, with its role in lower case and its time, which may be unknown (null or 0)."""
    m = units.deduplicated(table(spark, folder, "memory_units"), "ingested_at")
    return m.select("uid", "sample_id", "session_id", F.lower(F.trim("role")).alias("role"), "message_index", F.col("timestamp").alias("ts"), F.col("text_content").alias("text"))


def timed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages for what orders by time: those of unknown time are left out."""
    return messages(spark, folder).where("ts > 0")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact once, participants by first name; its start is the stated absolute date, if it begins with a year."""
    f = table(spark, folder, "episodic_facts").dropDuplicates(["fact_id"])
    date = F.col("time_info.absolute_date")
    return f.select("fact_id", "sample_id", "content", "fact_type", F.transform("participants", lambda p: F.split(p, " ")[0]).alias("participants"), "retrieval_keys", "source_unit_uids", "confidence", F.when(date.rlike("^[0-9]{4}-[0-9]{2}"), date).alias("start"))


def reply_asof(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.reply_edges(timed_messages(spark, folder))


def message_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.message_pairs(messages(spark, folder))


def event_gaps(spark: SparkSession, folder: str) -> DataFrame:
    e = dialogue.gaps(table(spark, folder, "events"), "user_id", "ts")
    return e.select("event_id", F.round("gap_minutes", 9).alias("gap_minutes"))


def sessions_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of events with a gap of three hours, by user."""
    e = table(spark, folder, "events")
    x = e.select("user_id", utc_micros(e, "ts").alias("t"), F.lit(180 * sessions.US_PER_MINUTE).alias("gap"))
    return sessions.sessionize(x, "user_id", "t", "gap")


def sessions_full(spark: SparkSession, folder: str) -> DataFrame:
    m = timed_messages(spark, folder)
    return assign_batch(m.select("sample_id", "uid", (F.col("ts") * 1_000_000).cast("bigint").alias("t"), "text", F.col("role").alias("who")))


def accumulations(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.accumulations(facts(spark, folder))


def timelines(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.timelines(facts(spark, folder)).select("subject", F.array_join("fact_ids", ",").alias("fact_ids"))


def state_changes(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.state_changes(facts(spark, folder))


def temporal_index(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.temporal_index(facts(spark, folder))


def participant_index(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.participant_index(facts(spark, folder))


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("uid"), "text")
    return dialogue.fixed_chunks(d).select("uid", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("digest"))


def chunks_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("uid"), "text")
    return dialogue.without_overlap(dialogue.fixed_chunks(d), 50).select("uid", F.md5("text").alias("digest"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_entities").dropDuplicates(["entity_id"])


def name_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return merging.first_per_name(_entities(spark, folder), "entity_id").select("entity_id", "name")


def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder).withColumn("low", F.lower(F.trim("name")))
    m = merging.merged_entities(e, ["entity_type", "low"], "entity_id")
    return m.select("entity_type", "low", "name", F.round("confidence", 6).alias("confidence"), "members", "first_member", "last_member", F.array_join("aliases", "|").alias("aliases"))


def fact_merge(spark: SparkSession, folder: str) -> DataFrame:
    f = merging.merged_facts(facts(spark, folder), ["sample_id", "fact_type"], "fact_id")
    return f.select("sample_id", "fact_type", F.md5("content").alias("digest"), "members", *(F.array_join(c, "|").alias(c) for c in ("participants", "retrieval_keys", "source_unit_uids")))


def fact_rules(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).where("sample_id is not null and fact_type is not null")
    x = f.select(F.col("sample_id").alias("cluster"), F.col("fact_type").alias("category"), F.substring("start", 1, 7).alias("date"), "content", F.get("source_unit_uids", F.lit(0)).alias("session"), "confidence", F.col("fact_id").alias("pos"))
    out = merging.aggregated_facts(x, "cluster", ["EVENT"], ["OPINION", "POSSESSION"])
    return out.select("cluster", "category", "date", F.md5("content").alias("digest"), "facts", "sessions", "stable", F.round("confidence", 6).alias("confidence"))


def cross_session_groups(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "entity_mentions").dropDuplicates(["mention_id"]).join(_entities(spark, folder).select("entity_id", "name"), "entity_id")
    return merging.cross_session_groups(m.select("name", "entity_id", "session_id"))


def entity_relations(spark: SparkSession, folder: str) -> DataFrame:
    return merging.built_relations(edges(spark, folder), nodes(spark, folder), "edge_id").select("edge_id", "src", "dst")


def relation_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = edges(spark, folder)
    s = _entities(spark, folder).select("entity_id", "sample_id")
    x = e.join(s.toDF("src", "src_session"), "src").join(s.toDF("dst", "dst_session"), "dst").withColumnRenamed("weight", "confidence")
    out = metrics.relation_statistics(x)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("confidence") else c for c in out.columns])


def resolve_names(spark: SparkSession, folder: str) -> DataFrame:
    e = _entities(spark, folder)
    refs = table(spark, folder, "entity_mentions").select(F.explode("aliases").alias("reference")).where("trim(reference) <> ''").distinct()
    return merging.resolve_names(refs, e)


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    out = metrics.latency_summary(e, "value", ["event_type"])
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p90", "p99")))


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "doc_labels").select("annotator", F.when(F.col("label").isNotNull(), (F.col("label") == "none").cast("double")).alias("score")).withColumn("correct", F.col("score") == 1)
    out = metrics.score_summary(l, "annotator")
    return out.select("annotator", "total", "evaluated", "correct", "wrong", *(F.round(c, 6).alias(c) for c in ("accuracy", "mean", "deviation")))


def metric_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    out = metrics.metric_aggregates(table(spark, folder, "events"), "value", "event_type")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "deviation", "min", "max", "median")))


def weighted_compare(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").groupBy("memory_space", "lang").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    out = metrics.weighted_comparison(d, "memory_space", "log")
    return out.select("category", F.round("weighted", 6).alias("weighted"))


def pre_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return metrics.pre_aggregated(d, "lang", "source", "n_chars")


def answer_em_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Each message against the one before it in its session, as if it were the answer expected."""
    m = dialogue.with_previous(messages(spark, folder).select("session_id", "uid", "message_index", "text"), "text").where("previous is not null")
    x = m.select("session_id", "uid", normalized_answer(F.col("previous")).alias("g"), normalized_answer(F.col("text")).alias("a"))
    return metrics.answer_scores(x, "session_id", "uid").select("uid", "em", F.round("f1", 6).alias("f1"))


def evidence_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a fact's sources are among the messages of its sample that a user wrote."""
    f = facts(spark, folder).select(F.col("fact_id").alias("query_id"), "sample_id", F.coalesce("source_unit_uids", F.array().cast("array<string>")).alias("evidence"))
    pairs = f.select("query_id", F.explode("evidence").alias("uid")).join(messages(spark, folder).where("role = 'user'").select("uid"), "uid").groupBy("query_id").agg(F.collect_set("uid").alias("retrieved"))
    out = metrics.evidence_recall(f.join(pairs, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>"))))
    return out.select("query_id", F.round("recall", 6).alias("recall"))


def leaders(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that join the first like them, within a label."""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("v"), F.col("label").alias("kind"))
    return merging.leaders(v, DIM, 0.3)


QUERIES = {
    f.__name__: f
    for f in (
        reply_asof, message_pairs, event_gaps, sessions_gap, sessions_full, accumulations, timelines, state_changes, temporal_index, participant_index, chunk_fixed, chunks_rejoined, name_dedup, entity_merge, fact_merge, fact_rules, cross_session_groups,
        entity_relations, relation_stats, resolve_names, latency_summary, score_summary, metric_aggregates, weighted_compare, pre_aggregate, answer_em_f1, evidence_recall, leaders,
    )
}

from palimpsest.queries.stores import GRAPH  # noqa: E402

_M = """m as (select uid, any_value(sample_id) as sample_id, any_value(session_id) as session_id, lower(trim(any_value(role))) as role, any_value(message_index) as message_index, any_value(timestamp) as ts, any_value(text_content) as text
  from memory_units group by uid having any_value(timestamp) > 0)"""
_ANY = _M.replace(" having any_value(timestamp) > 0", "")
_F = """f as (select fact_id, any_value(sample_id) as sample_id, any_value(content) as content, any_value(fact_type) as fact_type, list_transform(any_value(participants), lambda p: split_part(p, ' ', 1)) as participants, any_value(retrieval_keys) as retrieval_keys, any_value(source_unit_uids) as source_unit_uids,
  any_value(confidence) as confidence, case when regexp_matches(any_value(time_info.absolute_date), '^[0-9]{4}-[0-9]{2}') then any_value(time_info.absolute_date) end as start from episodic_facts group by fact_id)"""
_E = "e as (select entity_id, any_value(sample_id) as sample_id, any_value(name) as name, any_value(entity_type) as entity_type, any_value(confidence) as confidence, any_value(aliases) as aliases from extracted_entities group by entity_id)"
_ACTION = "case " + " ".join(f"when contains(lower(content), '{p}') then '{a}'" for p, a in dialogue.ACTIONS) + " end"
_CHUNKS = """c as (select doc_id as uid, text, unnest(range(greatest(0, cast(ceil((length(text) - 512) / 462.0) as bigint)) + 1)) as chunk_no from documents where length(text) > 0),
k as (select uid, chunk_no, substring(text, chunk_no * 462 + 1, 512) as chunk from c)"""
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(replace(coalesce({c}, ''), ',', '')), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the|and)\\b', ' ', 'g'), '\\s+'), lambda w: w <> '')"
ORACLES = {
    "leaders": """with recursive v as (select vec_id as uid, label as kind, cast(embedding as double[]) as v from embeddings),
n as (select uid, kind, v, sqrt(list_inner_product(v, v)) as norm from v),
items as (select uid, kind, row_number() over (partition by kind order by uid) as pos from v),
near as (select a.uid, b.uid as other from n a join n b on a.kind = b.kind and b.uid < a.uid where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.3 - 1e-9),
walk(uid, kind, pos, leader) using key (uid) as (select uid, kind, pos, uid from items where pos = 1 union
  select i.uid, i.kind, i.pos, coalesce(m.leader, i.uid) from walk w join items i on i.kind = w.kind and i.pos = w.pos + 1
  left join (select p.uid, min(p.other) as leader from near p join recurring.walk r on r.uid = p.other and r.leader = r.uid group by 1) m on m.uid = i.uid)
select uid, kind, leader from walk""",
    # Without vectors no sum of the softer signs reaches the boundary, so only the hard rules begin a session.
    "sessions_full": f"""with recursive {_M},
x as (select sample_id, uid, cast(trunc(ts * 1000000) as bigint) as t, length(coalesce(text, '')) as n, row_number() over (partition by sample_id order by cast(trunc(ts * 1000000) as bigint), uid) as pos from m where sample_id is not null),
w as (select sample_id, uid, pos, t, 1 as units, n as chars, t as start, 1 as number from x where pos = 1 union all
  select sample_id, uid, pos, t, case when s then 1 else units + 1 end, case when s then n else chars + n end, case when s then t else start end, number + s::int from (
    select x.*, w.units, w.chars, w.start, w.number, w.units >= 80 or w.chars + x.n > 12000 or x.t - w.t >= 10800000000
      or ((w.units >= 2 or w.chars >= 200) and floor(x.t / 86400000000) <> floor(w.t / 86400000000)) as s from w join x on x.sample_id = w.sample_id and x.pos = w.pos + 1) y)
select sample_id, uid, regexp_replace(sample_id, '[^A-Za-z0-9_.:-]+', '_', 'g') || '::auto_session::' || strftime(make_timestamp(start), '%Y%m%d') || '_' || lpad(cast(number as varchar), 4, '0') as session_id from w""",
    "reply_asof": f"""with {_M}, n as (select * from m where regexp_matches(text, '[^\\s\\x{{00a0}}]')),
x as (select uid, role, last_value(case when role = 'user' then uid end ignore nulls) over (partition by sample_id order by ts, uid rows between unbounded preceding and 1 preceding) as dst from n)
select uid as src, dst from x where role = 'assistant' and dst is not null""",
    "message_pairs": f"with {_ANY}, x as (select uid as src, lead(uid) over (partition by session_id order by message_index, uid) as dst from m where session_id is not null and message_index is not null) select src, dst, 1 as distance from x where dst is not null",
    "event_gaps": "select event_id, round(greatest(0, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 6e7), 9) as gap_minutes from events",
    "sessions_gap": """
with a as (select user_id, epoch_us(ts) as t, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 10800000000 then 0 else 1 end as b from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(b) over (partition by user_id order by t, event_id rows unbounded preceding) as no from a)
select user_id, min(t) as start_time_us, max(t) as last_time_us, max(t) - min(t) as duration_us, count(*) as unit_count from s group by user_id, no""",
    "accumulations": f"""with {_F}, x as (select lower(unnest(participants)) as subject, {_ACTION} as action, nullif(trim(start), '') as start from f where fact_type in ('EVENT', 'ACHIEVEMENT', 'ACTIVITY'))
select subject, action, count(*) as count, coalesce(min(start), '') as time_span_start, coalesce(max(start), '') as time_span_end from x where action is not null group by 1, 2 having count(*) >= 2""",
    "timelines": f"""with {_F}, x as (select lower(unnest(participants)) as subject, coalesce(nullif(start, ''), '9999-99-99') as t, fact_id from f)
select subject, string_agg(fact_id, ',' order by t, fact_id) as fact_ids from x group by 1 having count(*) >= 3""",
    "state_changes": f"""with {_F}, x as (select lower(unnest(participants)) as subject, coalesce(nullif(start, ''), '9999-99-99') as t, fact_id, content from f where fact_type = 'STATE_CHANGE'),
y as (select subject, fact_id as from_fact, lead(fact_id) over w as to_fact, substring(content, 1, 100) as from_text, substring(lead(content) over w, 1, 100) as to_text from x window w as (partition by subject order by t, fact_id))
select * from y where to_fact is not null""",
    "temporal_index": f"with {_F} select substring(start, 1, 7) as month, count(*) as facts, min(fact_id) as first_fact from f where length(start) >= 7 group by 1",
    "participant_index": f"with {_F}, x as (select unnest(participants) as participant, fact_id from f) select participant, count(distinct fact_id) as facts, min(fact_id) as first_fact from x group by 1",
    "chunk_fixed": f"with {_CHUNKS} select uid, chunk_no, md5(chunk) as digest from k",
    "chunks_rejoined": "select doc_id as uid, md5(text) as digest from documents where length(text) > 0",
    "name_dedup": f"with {_E} select entity_id, name from e where trim(name) <> '' qualify row_number() over (partition by lower(trim(name)) order by entity_id) = 1",
    "entity_merge": f"""with {_E}, x as (select *, lower(trim(name)) as low from e),
al as (select entity_type, low, string_agg(a, '|' order by a) as aliases from (select distinct entity_type, low, unnest(aliases) as a from x) group by 1, 2)
select x.entity_type, x.low, arg_min(name, (-length(name), entity_id)) as name, round(avg(confidence), 6) as confidence, count(*) as members, min(entity_id) as first_member, max(entity_id) as last_member, coalesce(any_value(al.aliases), '') as aliases
from x left join al on al.entity_type = x.entity_type and al.low = x.low group by 1, 2""",
    "fact_merge": f"""with {_F}, g as (select sample_id, fact_type, md5(arg_min(content, (-length(coalesce(content, '')), fact_id))) as digest, count(*) as members from f group by 1, 2),
p as (select sample_id, fact_type, string_agg(v, '|' order by v) as v from (select distinct sample_id, fact_type, unnest(participants) as v from f) group by 1, 2),
r as (select sample_id, fact_type, string_agg(v, '|' order by v) as v from (select distinct sample_id, fact_type, unnest(retrieval_keys) as v from f) group by 1, 2),
s as (select sample_id, fact_type, string_agg(v, '|' order by v) as v from (select distinct sample_id, fact_type, unnest(source_unit_uids) as v from f) group by 1, 2)
select g.*, coalesce(p.v, '') as participants, coalesce(r.v, '') as retrieval_keys, coalesce(s.v, '') as source_unit_uids
from g left join p using (sample_id, fact_type) left join r using (sample_id, fact_type) left join s using (sample_id, fact_type)""",
    "fact_rules": f"""with {_F}, x as (select sample_id as cluster, fact_type as category, substring(start, 1, 7) as date, coalesce(content, '') as content, source_unit_uids[1] as session, confidence, fact_id as pos from f where sample_id is not null and fact_type is not null),
y as (select *, case when category = 'EVENT' then date end as d from x),
bc as (select cluster, category, d, content, count(*) as n, min(pos) as first from y group by 1, 2, 3, 4),
c as (select cluster, category, d, max(n) as top, arg_min(content, (-n, first)) as modal, arg_min(content, (-length(content), first)) as longest from bc group by 1, 2, 3),
bd as (select cluster, category, d, date, count(*) as n, min(pos) as first from y where date is not null group by 1, 2, 3, 4),
dd as (select cluster, category, d, arg_min(date, (-n, first)) as modal_date from bd group by 1, 2, 3),
b as (select cluster, category, d, count(*) as facts, count(distinct session) as sessions, avg(coalesce(confidence, 0.95)) as confidence from y group by 1, 2, 3)
select b.cluster, b.category, case when b.category = 'EVENT' then b.d when b.category in ('OPINION', 'POSSESSION') then null else modal_date end as date, md5(case when top > 1 then modal else longest end) as digest, facts, sessions, sessions > 1 as stable, round(b.confidence, 6) as confidence
from b join c on c.cluster = b.cluster and c.category = b.category and c.d is not distinct from b.d left join dd on dd.cluster = b.cluster and dd.category = b.category and dd.d is not distinct from b.d""",
    "cross_session_groups": f"""with {_E}, mm as (select mention_id, any_value(entity_id) as entity_id, any_value(session_id) as session_id from entity_mentions group by 1)
select lower(trim(name)) as name, count(distinct entity_id) as entities, count(distinct session_id) as sessions from mm join e using (entity_id) where name <> '' group by 1 having count(distinct entity_id) > 1 and count(distinct session_id) > 1""",
    "entity_relations": "with " + GRAPH + " select max(edge_id) as edge_id, src, dst from edges semi join (select id as src from nodes) s using (src) group by src, dst",
    "relation_stats": "with " + GRAPH + f""", {_E}
select count(*) as relations, count(*) filter (a.sample_id <> b.sample_id) as cross_session, count(*) filter (a.sample_id = b.sample_id) as within_session, count(distinct type) as types, round(avg(weight), 6) as mean_confidence, round(min(weight), 6) as min_confidence, round(max(weight), 6) as max_confidence
from edges join e a on a.entity_id = src join e b on b.entity_id = dst""",
    "resolve_names": f"""with {_E}, a as (select distinct reference from (select unnest(aliases) as reference from entity_mentions) where trim(reference) <> ''),
n as (select entity_id, lower(trim(name)) as name from e where name <> ''),
x as (select reference, min(entity_id) as entity_id from a join n on lower(trim(reference)) = name group by 1),
p as (select reference, min(entity_id) as entity_id from a join n on contains(name, lower(trim(reference))) or contains(lower(trim(reference)), name) where reference not in (select reference from x) group by 1)
select * from x union all select * from p""",
    "latency_summary": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99 from events group by rollup (event_type)",
    "score_summary": """with l as (select annotator, case when label is not null then (label = 'none')::int::double end as score from doc_labels)
select annotator, count(*) as total, count(score) as evaluated, count(*) filter (score = 1) as correct, count(*) filter (score <> 1) as wrong, round(count(*) filter (score = 1) / count(score), 6) as accuracy, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as deviation
from l group by rollup (annotator)""",
    "metric_aggregates": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, round(min(value), 6) as min, round(max(value), 6) as max, round(median(value), 6) as median from events group by 1",
    "weighted_compare": """with d as (select memory_space, lang, avg(n_chars) as mean, count(*) as n from documents group by 1, 2)
select memory_space as category, round(sum(mean * n) / sum(n), 6) as weighted from d group by 1 union all select 'overall', round(sum(mean * n) / sum(n), 6) from d
union all select 'overall without log', round(sum(mean * n) / sum(n), 6) from d where memory_space <> 'log'""",
    "pre_aggregate": "select coalesce(nullif(trim(lang), ''), 'Other') as category, cast(sum(n_chars) as bigint) as total, count(distinct source) as names from documents group by 1",
    "answer_em_f1": f"""with {_ANY}, p as (select uid, text as answer, lag(text) over (partition by session_id order by message_index, uid) as gold from m where session_id is not null and message_index is not null),
w as (select uid, {_WORDS.replace('{c}', 'gold')} as g, {_WORDS.replace('{c}', 'answer')} as a from p where gold is not null), k as (select * from w),
gc as (select uid, w, count(*) as n from (select uid, unnest(g) as w from k) group by 1, 2), ac as (select uid, w, count(*) as n from (select uid, unnest(a) as w from k) group by 1, 2),
s as (select uid, sum(least(gc.n, ac.n)) as same from gc join ac using (uid, w) group by 1)
select k.uid, list_sort(list_distinct(g)) = list_sort(list_distinct(a)) as em, round(coalesce(2 * (same / len(a)) * (same / len(g)) / (same / len(a) + same / len(g)), 0), 6) as f1 from k left join s using (uid)""",
    "evidence_recall": f"""with {_F}, {_ANY}, x as (select fact_id, unnest(list_distinct(source_unit_uids)) as uid from f), c as (select fact_id, count(*) as n, count(m.uid) as hit from x left join m on m.uid = x.uid and m.role = 'user' group by 1)
select f.fact_id as query_id, round(coalesce(hit / n, 1), 6) as recall from f left join c using (fact_id)""",
}
