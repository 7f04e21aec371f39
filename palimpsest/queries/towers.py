"""Which towers a question is sent to, what each finds, and how it is handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import token_estimate
from palimpsest.operators import lexical, metrics, prune, ranking, route
from palimpsest.plans import rerank, search
from palimpsest.queries import retrieval as r
from palimpsest.queries import stores as s
from palimpsest.queries.context import QUESTIONS_CATEGORIES, QUESTIONS_LOCOMO, questions
from palimpsest.sources.tables import table


def route_longmemeval_towers(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).select("uid", "no", route.longmemeval_category(F.col("question")).alias("category"))
    return route.longmemeval_routed(q)


def tower_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Every question by its own category and, a second time, as one of category 5."""
    q = questions(spark, folder).select("uid", "no", route.locomo_category(F.col("question")).alias("category"))
    routes = route.routed(q.unionByName(q.withColumn("category", F.lit(5))))
    return route.tower_weights(routes).select("uid", "no", "category", "hierarchical_weight", "graph_weight", "episodic_weight")


def route_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions for every question: with a stated category for one data set, without one for the other, and without routing."""
    q = questions(spark, folder)
    stated = route.route_decisions(q.withColumn("category", (F.length("question") % 5 + 1).cast("int")), "locomo").withColumn("case", F.lit("stated"))
    told = route.route_decisions(q.withColumn("category", F.lit(None).cast("string")), "longmemeval", model="gpt-5", strategy="conservative").withColumn("case", F.lit("told"))
    off = route.route_decisions(q.withColumn("category", F.lit(None).cast("string")), "locomo", routing=False).withColumn("case", F.lit("off"))
    columns = ("case", "uid", "no", "active", *route.TOWER_SIZES, "final_k", "confidence", "reason")
    return stated.select(*columns).unionByName(told.select(*columns)).unionByName(off.select(*columns))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "episodic_facts").where("fact_id is not null").groupBy("fact_id").agg(F.min("content").alias("text"), F.min("time_info.absolute_date").alias("time"))
    return f.withColumnRenamed("fact_id", "uid")


def _fact_queries(facts: DataFrame) -> DataFrame:
    return facts.where("cast(regexp_extract(uid, '([0-9]+)', 1) as bigint) % 20 = 0").select(F.col("uid").alias("query_id"), F.col("text").alias("query"))


def _episodic(spark: SparkSession, folder: str) -> DataFrame:
    f = _facts(spark, folder)
    return lexical.bm25(lexical.build_index(f).stored(), _fact_queries(f), 5)


def episodic_tower(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by their content."""
    return r._shown(_episodic(spark, folder))


def episodic_context(spark: SparkSession, folder: str) -> DataFrame:
    """What the facts found read like, with their times."""
    found = _episodic(spark, folder).join(_facts(spark, folder), "uid")
    return prune.fact_context(found, "rank", "Episodic Fact").select("query_id", F.md5("context").alias("digest"))


def entity_tower(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by name, type and aliases."""
    e = table(spark, folder, "extracted_entities").groupBy(F.col("entity_id").alias("uid")).agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"), F.min("aliases").alias("aliases"))
    text = F.concat_ws(" ", "name", "entity_type", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    return r._shown(lexical.bm25(lexical.build_index(e.select("uid", text.alias("text"))).stored(), s.name_queries(spark, folder), 5))


def rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Results whose scorer failed keep their order."""
    out = rerank.in_given_order(r._bm25(spark, folder, 20))
    return out.select("query_id", "uid", F.round("score", 6).alias("score"), "rank")


def adapted_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as chunks, as an adapter makes them of results without ids, ranks and entities."""
    m = table(spark, folder, "memory_units").dropDuplicates(["uid"])
    rows = m.select(F.when(F.pmod(F.col("message_index"), F.lit(2)) == 0, F.col("uid")).alias("uid"), F.col("text_content").alias("text"), F.try_element_at("metadata", F.lit("created")).alias("time"))
    out = search.adapted(rows.where("text <> ''"), {"rank_bm25": None})
    return out.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"), F.max("rank_bm25").alias("rank_bm25"), F.max("ts").alias("ts"))


def type_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Messages against what the one before asked for, by role: how many are short enough."""
    m = table(spark, folder, "memory_units").dropDuplicates(["uid"]).select(F.lower(F.trim("role")).alias("role"), F.col("uid").alias("query_id"), token_estimate(F.col("text_content")).alias("tokens"))
    out = metrics.summary_by_type(m.withColumn("correct", F.col("tokens") < 40), "role")
    return out.select("role", "questions", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("mean_tokens", 6).alias("mean_tokens"), "tokens", "first_wrong")


def above_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The best five of those with half the best score or more."""
    found = r._dense(spark, folder, 20)
    return r._shown(ranking.above(found.drop("rank"), 0.6, 5, ["query_id"]))


QUERIES = {f.__name__: f for f in (route_longmemeval_towers, tower_weights, route_decisions, episodic_tower, episodic_context, entity_tower, rerank_fallback, adapted_chunks, type_summary, above_threshold)}

_LETTERS = "case category when 'multi-session' then '{0}' when 'temporal-reasoning' then '{1}' when 'knowledge-update' then '{2}' when 'single-session-user' then '{3}' when 'single-session-assistant' then '{4}' when 'single-session-preference' then '{5}' end"
_SIZES = "case when contains(t, 'S') then 60 else {off} end as hierarchical_k, case when contains(t, 'N') then 40 else {off} end as graph_k, case when contains(t, 'E') then 40 else {off} end as episodic_k"
_FACTS = """
fa as (select fact_id as uid, min(content) as text, min(time_info.absolute_date) as time from episodic_facts where fact_id is not null group by 1),
fq as (select uid as query_id, text from fa where cast(regexp_extract(uid, '([0-9]+)', 1) as bigint) % 20 = 0),""" + r.bm25_sql("fa", "fq")
_ESTIMATE = "cast(floor((length(regexp_replace({t}, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 2 - length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) + length({t}) * 4) / 10.0) as bigint)"
ORACLES = {
    "route_longmemeval_towers": QUESTIONS_CATEGORIES + f", t as (select uid, no, category, {_LETTERS.format('SE', 'SE', 'SN', 'EN', 'SEN', 'SEN')} as t from c) select uid, no, category, {_SIZES.replace('{off}', '0')}, 25 as final_k from t",
    "tower_weights": QUESTIONS_LOCOMO + """, d as (select uid, no, category from c union all select uid, no, 5 from c)
select uid, no, category, case category when 1 then 0.5 when 2 then 0.5 when 5 then 0 else 0.34 end::double as hierarchical_weight, case category when 1 then 0 when 2 then 0.5 when 5 then 0.5 else 0.33 end::double as graph_weight,
  case category when 1 then 0.5 when 2 then 0 when 5 then 0.5 else 0.33 end::double as episodic_weight from d""",
    "route_decisions": QUESTIONS_CATEGORIES + f""", st as (select uid, no, length(question) % 5 + 1 as k from c),
t as (select uid, no, {_LETTERS.format('SEN', 'SE', 'SN', 'SN', 'SE', 'SEN')} as t from c)
select 'stated' as case, uid, no, case k when 1 then 'hierarchical,episodic' when 2 then 'hierarchical,graph' when 5 then 'graph,episodic' else 'hierarchical,graph,episodic' end as active,
  case k when 5 then 20 else 15 end as hierarchical_k, case k when 1 then 20 else 30 end as graph_k, case k when 2 then 20 else 30 end as episodic_k, case k when 5 then 35 else 20 end as final_k, 0.9::double as confidence, 'category_router' as reason from st
union all select 'told', uid, no, case t when 'SEN' then 'hierarchical,graph,episodic' when 'SE' then 'hierarchical,episodic' else 'hierarchical,graph' end, {_SIZES.replace('{off}', '20')}, 50, 0.65, 'router_inferred_category' from t
union all select 'off', uid, no, 'hierarchical,graph,episodic', 20, 20, 20, 20, 1.0, 'search_mode_override' from c""",
    "episodic_tower": "with " + _FACTS + " select query_id, uid, round(score, 6) as score, rank from bm25 where rank <= 5",
    "episodic_context": "with " + _FACTS + """,
x as (select query_id, row_number() over (partition by query_id order by rank) as i, coalesce(nullif(time, ''), 'time unknown') as time, fa.text from bm25 join fa using (uid) where rank <= 5 and trim(fa.text) <> '')
select query_id, md5(string_agg('Episodic Fact ' || i || ': [' || time || '] ' || text, chr(10) order by i)) as digest from x group by 1""",
    "entity_tower": "with " + s.GRAPH + "," + s.NAME_QUERIES + """,
en as (select entity_id as uid, concat_ws(' ', min(name), min(entity_type), array_to_string(coalesce(min(aliases), []), ' ')) as text from extracted_entities group by 1),""" + r.bm25_sql("en", "(select query_id, query as text from q)") + " select query_id, uid, round(score, 6) as score, rank from bm25 where rank <= 5",
    "rerank_fallback": "with " + r.BM25.replace("{where}", "") + " select query_id, uid, round(0.01 - (rank - 1) * 0.00001, 6)::double as score, rank from bm25 where rank <= 20",
    "adapted_chunks": """with m as (select uid, any_value(message_index) as i, any_value(text_content) as text, any_value(metadata)['created'] as time from memory_units group by uid),
x as (select case when i % 2 = 0 then uid else 'gen_' || left(md5(text), 10) end as chunk_id, """ + _ESTIMATE.replace("{t}", "text") + """ as tokens, case when time is null then 0 else coalesce(epoch(try_cast(time as timestamp)), 0) end as ts from m where text <> '')
select chunk_id, count(*) as n, max(tokens) as tokens, 9999 as rank_bm25, max(ts)::double as ts from x group by 1""",
    "type_summary": """with m as (select uid, any_value(role) as role, any_value(text_content) as t from memory_units group by uid),
x as (select lower(trim(role)) as role, uid, """ + _ESTIMATE.replace("{t}", "coalesce(t, '')") + """ as tokens from m)
select role, count(*) as questions, count(*) filter (tokens < 40) as correct, round(count(*) filter (tokens < 40) / count(*), 6) as accuracy, round(avg(tokens), 6) as mean_tokens, cast(sum(tokens) as bigint) as tokens, min(uid) filter (tokens >= 40) as first_wrong
from x group by rollup (role)""",
    "above_threshold": "with " + r.VEC.replace("{where}", "") + " select query_id, uid, round(score, 6) as score, rank from cosine where rank <= 5 and score >= 0.6",
}
