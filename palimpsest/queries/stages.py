"""Second stages, labels, node searches and what else surrounds retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import labels
from palimpsest.operators import cluster, dialogue, fusion, graph, lexical, route
from palimpsest.plans import rerank, search
from palimpsest.queries import retrieval as r
from palimpsest.queries import stores as s
from palimpsest.queries.context import QUESTIONS_CATEGORIES, questions
from palimpsest.queries.records import timed_messages
from palimpsest.sources.store import evicted
from palimpsest.sources.tables import table


def rerank_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The best 100 results of each query ranked anew by the words of its whole text."""
    q = r.text_queries(spark, folder).where("trim(query) <> ''")
    return r._shown(rerank.rerank(r._bm25(spark, folder, 100), q, r.units(spark, folder), 10, threshold=0.1))


def rerank_scaled(spark: SparkSession, folder: str) -> DataFrame:
    return rerank.scaled(r._bm25(spark, folder, 20)).select("query_id", "uid", F.round("score", 6).alias("score"), "rank")


def rerank_split(spark: SparkSession, folder: str) -> DataFrame:
    sources = r.units(spark, folder).select("uid", F.col("memory_space").alias("source"))
    out = rerank.split_back(r._bm25(spark, folder, 20), sources)
    return out.select("query_id", "uid", "source", "rank", "source_rank")


def graph_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Entities found by their names, with neighbours of theirs that weren't found."""
    n = s.nodes(spark, folder).select(F.col("id").alias("uid"), "text")
    q = s.name_queries(spark, folder)
    found = lexical.bm25(lexical.build_index(n).stored(), q, 10)
    return r._shown(search.expand(found, s.edges(spark, folder), 10))


def node_search(spark: SparkSession, folder: str) -> DataFrame:
    """Entities by name and by their relations, the better score counts."""
    n = s.nodes(spark, folder).select(F.col("id").alias("uid"), "text")
    q = s.name_queries(spark, folder)
    text = lexical.bm25(lexical.build_index(n).stored(), q, 15)
    edges = graph.edge_search(s.edges(spark, folder), s.nodes(spark, folder), q, 10)
    return r._shown(graph.hybrid({"nodes": (0.05, text), "edges": (0.3, edges)}, 10))


def nodes_of_type(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nodes_of_type(s.nodes(spark, folder), "Optics").select("id")


def scored_paths(spark: SparkSession, folder: str) -> DataFrame:
    p = graph.simple_paths(s.edges(spark, folder), s.seeds(spark, folder), None)
    return graph.scored_paths(p, "length", 30).select(F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"))


def layers(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "memory_units").dropDuplicates(["uid"])
    return m.groupBy(labels.layer(F.col("metadata"), F.col("memory_space")).alias("layer")).agg(F.count("*").alias("units"))


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    d = r.units(spark, folder).select("uid", F.explode(labels.title_phrases(F.col("text"))).alias("phrase"))
    return d.groupBy("phrase").agg(F.count("*").alias("units")).where("units > 1")


def adaptive_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """The cut of every question by its category, and that of every kind of fact."""
    q = questions(spark, folder).select(F.concat_ws("#", "uid", "no").alias("item"), route.longmemeval_category(F.col("question")).alias("category"))
    f = table(spark, folder, "episodic_facts").dropDuplicates(["fact_id"]).select(F.col("fact_id").alias("item"), F.col("fact_type").alias("category"))
    return route.with_cut(q.unionByName(f))


def mixed_pool(spark: SparkSession, folder: str) -> DataFrame:
    u = r.units(spark, folder)
    return dialogue.mixed_pool({k: u.where(F.col("memory_space") == k) for k in ("chat", "digest", "insight", "card", "facts")}, 100)


def session_status(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.session_status(timed_messages(spark, folder), "session_id", "ts", 1_672_531_200.0, 60 * 24 * 365)


def similar_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose vectors point the same way on the whole."""
    v = table(spark, folder, "embeddings").select(F.col("label").alias("session_id"), F.col("embedding").alias("v"))
    return dialogue.similar_sessions(v, r.DIM, -1.0).select("session_a", "session_b", F.round("cosine", 6).alias("cosine"))


def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    v = r.vectors(spark, folder)
    out = cluster.silhouettes(v, v.select("uid", F.col("label").alias("cluster")), r.DIM)
    return out.select("cluster", "n", F.round("silhouette", 6).alias("silhouette"))


def dbscan_tuning(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.tuned(r.vectors(spark, folder), r.DIM)


def eviction(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("uid")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))
    return evicted(e, max(1, e.count()))


def result_intersection(spark: SparkSession, folder: str) -> DataFrame:
    """How many units all methods agree on, by query."""
    return fusion.in_all_methods(r.results(spark, folder, 20)).groupBy("query_id").agg(F.count("*").alias("units"))


QUERIES = {
    f.__name__: f
    for f in (rerank_lexical, rerank_scaled, rerank_split, graph_expansion, node_search, nodes_of_type, scored_paths, layers, phrases, adaptive_cuts, mixed_pool, session_status, similar_sessions, cluster_quality, dbscan_tuning, eviction, result_intersection)
}

_BM = "with " + r.BM25.replace("{where}", "")
ORACLES = {
    "rerank_lexical": _BM + """,
f as (select doc_id as query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') as ws from documents where doc_id % 20 = 0 and trim(text) <> ''),
s as (select b.query_id, b.uid, case when len(ws) > 0 then len(list_filter(ws, lambda w: contains(lower(d.text), w))) / len(ws) else 0 end as score from bm25 b join f using (query_id) join documents d on d.doc_id = b.uid where b.rank <= 100),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, uid) as rank from s where score >= 0.1)
select query_id, uid, round(score, 6) as score, rank from k where rank <= 10""",
    "rerank_scaled": _BM + """,
t as (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from bm25 where rank <= 20)
select query_id, uid, round(case when lo >= 0 and hi <= 1 then score when hi > lo then (score - lo) / (hi - lo) else 0.5 end, 6) as score, rank from t""",
    "rerank_split": _BM + " select query_id, uid, memory_space as source, rank, row_number() over (partition by query_id, memory_space order by rank) as source_rank from bm25 join documents on doc_id = uid where rank <= 20",
    "nodes_of_type": "with " + s.GRAPH + " select id from nodes where node_type = 'Optics' or contains(lower(text), 'optics')",
    "scored_paths": s.FIVE_NODES + "select path, round(score, 6) as score from (select source, target, path, 1 / len(nodes_) as score from pa where i <= 10) order by round(score, 9) desc, source, target, path limit 30",
    "layers": """with m as (select uid, any_value(metadata) as metadata, any_value(memory_space) as memory_space from memory_units group by uid),
l as (select lower(coalesce(metadata['layer'], metadata['memory_layer'])) as said, lower(memory_space) as low from m)
select case when regexp_matches(said, 'l?[012]$') then 'l' || right(said, 1) when regexp_matches(low, '(^|[_:])l2([_:]|$)|insight') then 'l2' when regexp_matches(low, '(^|[_:])l1([_:]|$)|summary|digest') then 'l1' else 'l0' end as layer, count(*) as units from l group by 1""",
    "mixed_pool": "select memory_space as layer, doc_id as uid from documents where memory_space in ('chat', 'digest', 'insight', 'card', 'facts') order by md5('42|' || doc_id || '|' || memory_space), doc_id, memory_space limit 100",
    "graph_expansion": "with " + s.GRAPH + "," + s.NAME_QUERIES + "," + r.bm25_sql("(select id as uid, text from nodes)", "(select query_id, query as text from q)") + """,
res as (select query_id, uid, score from bm25 where rank <= 10),
nb as (select query_id, dst as uid, edge_id from res join edges on src = uid union all select query_id, src, edge_id from res join edges on dst = uid),
nw as (select query_id, uid, min(edge_id) as edge_id from nb anti join res using (query_id, uid) group by 1, 2),
ad as (select query_id, uid, 0.3 as score from nw qualify row_number() over (partition by query_id order by edge_id, uid) <= 5),
al as (select * from res union all select * from ad), rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, uid) as rank from al)
select query_id, uid, round(score, 6) as score, rank from rk where rank <= 10""",
    "node_search": "with " + s.GRAPH + "," + s.NAME_QUERIES + "," + s.EDGES_FOUND + "," + r.bm25_sql("(select id as uid, text from nodes)", "(select query_id, query as text from q)") + """,
al as (select query_id, uid, 0.05 * score as score from bm25 where rank <= 15 union all select query_id, uid, 0.3 * score from er where rank <= 10),
mx as (select query_id, uid, max(score) as score from al group by 1, 2), rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, uid) as rank from mx)
select query_id, uid, round(score, 6) as score, rank from rk where rank <= 10""",
    "cluster_quality": """with l as (select vec_id as uid, label, cast(embedding as double[]) as v from embeddings where len(embedding) = 64 and label >= 0),
n as (select uid, label, list_transform(v, lambda x: coalesce(x / nullif(sqrt(list_inner_product(v, v)), 0), 0)) as v from l),
p as (select label, unnest(v) as x, unnest(range(len(v))) as i from n), m as (select label, i, avg(x) as x from p group by 1, 2), c0 as (select label, list(x order by i) as c from m group by 1),
c as (select label as other, list_transform(c, lambda x: coalesce(x / nullif(sqrt(list_inner_product(c, c)), 0), 0)) as c from c0),
d as (select uid, label, other, 1 - list_inner_product(v, c) as d from n, c),
e as (select uid, label, min(d) filter (other = label) as a, min(d) filter (other <> label) as b from d group by 1, 2)
select label as cluster, count(*) as n, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) as silhouette from e group by 1""",
    "phrases": """with p as (select distinct doc_id, unnest(list_concat(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), regexp_extract_all(text, '"([^"\\n]{2,50})"', 1))) as phrase from documents)
select phrase, count(*) as units from p group by 1 having count(*) > 1""",
    "session_status": """with m as (select uid, any_value(session_id) as session_id, any_value(timestamp) as ts from memory_units group by uid having any_value(timestamp) > 0)
select session_id, count(*) as units, min(ts) as first_ts, max(ts) as last_ts, max(ts) >= 1672531200 - 31536000 as active from m where session_id is not null group by 1""",
    "adaptive_cuts": QUESTIONS_CATEGORIES + """,
i as (select uid || '#' || no as item, category from c union all select fact_id, any_value(fact_type) from episodic_facts group by 1),
k as (select *, case when regexp_matches(lower(category), 'multi-session|multi_session|multisession|temporal-reasoning|temporal_reasoning|aggregation|adversarial') then 'EVIDENCE_CHAIN'
  when regexp_matches(lower(category), 'single-session-user|single-session-preference|single_session_user|single_session_preference|simple_fact|simplefact|open_domain|opendomain') then 'AGGRESSIVE_CUT' else 'MODERATE_CUT' end as cut from i)
select item, category, cut, case cut when 'AGGRESSIVE_CUT' then 0.6 when 'MODERATE_CUT' then 1.0 else 1.8 end::double as drop_factor, case cut when 'AGGRESSIVE_CUT' then 1.2 when 'MODERATE_CUT' then 1.8 else 2.5 end::double as stop_factor,
  case cut when 'AGGRESSIVE_CUT' then 2 when 'MODERATE_CUT' then 4 else 6 end::int as least_chunks, case cut when 'AGGRESSIVE_CUT' then 0.8 when 'MODERATE_CUT' then 0.9 else 1.0 end::double as budget_share, case cut when 'MODERATE_CUT' then 5 end::int as most_drops from k""",
    "similar_sessions": """with l as (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as i from embeddings), b as (select label from embeddings group by 1 having count(*) >= 3),
c as (select label, i, avg(x) as x from l semi join b using (label) group by 1, 2), v as (select label, list(x order by i) as v from c group by 1)
select a.label as session_a, b.label as session_b, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) as cosine from v a join v b on a.label < b.label""",
    "eviction": """with e as (select user_id as uid, count(*) as accesses, max(ts) as last_access from events group by 1)
select uid from e order by accesses, date_trunc('day', last_access), last_access, uid limit (select count(*) - cast(floor(0.7::double * count(*)) as bigint) from e)""",
    "result_intersection": r.RESULTS + """, r20 as (select * from res where rank <= 20)
select query_id, count(*) as units from (select query_id, uid from r20 r group by query_id, uid having count(distinct method) = (select count(distinct method) from r20 x where x.query_id = r.query_id)) group by 1""",
}
