"""Spaces, units and the entity graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import graph as g
from palimpsest.operators import units as u
from palimpsest.operators.cluster import cluster_nodes
from palimpsest.sources.tables import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumnRenamed("doc_id", "uid")


def members(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    parts = [d.select(F.concat(F.lit(f"{p}:"), c).alias("space"), "uid") for p, c in (("lang", "lang"), ("source", "source"), ("kind", "memory_space"))]
    return reduce(lambda a, b: a.unionByName(b), parts).where("space is not null")


def children(spark: SparkSession, folder: str) -> DataFrame:
    m = members(spark, folder).select("space").distinct()
    low = m.select(F.split("space", ":")[0].alias("parent"), F.col("space").alias("child"))
    top = spark.createDataFrame([("corpus", x) for x in ("lang", "source", "kind", "missing")], "parent string, child string")
    return low.unionByName(top)


def _names(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "space string")


def space_closure(spark: SparkSession, folder: str) -> DataFrame:
    return u.closure(children(spark, folder))


def space_stats(spark: SparkSession, folder: str) -> DataFrame:
    return u.space_statistics(members(spark, folder), children(spark, folder))


def space_units(spark: SparkSession, folder: str) -> DataFrame:
    return u.units_in_spaces(documents(spark, folder), members(spark, folder), _names(spark, "ms:lang", "kind:log", "nowhere"), children(spark, folder)).select("uid", "lang", "memory_space")


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = documents(spark, folder).select("uid", "lang", "memory_space", "n_chars")
    return d.where("lang = 'en'"), d.where("memory_space = 'chat'"), d.where("n_chars > 500")


def units_union(spark: SparkSession, folder: str) -> DataFrame:
    return u.union(*_sets(spark, folder))


def units_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return u.intersection(*_sets(spark, folder))


def units_difference(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = _sets(spark, folder)
    return u.difference(a.unionByName(a), b, c)


def units_by_spaces(spark: SparkSession, folder: str) -> DataFrame:
    d, m = documents(spark, folder), members(spark, folder)
    parts = [u.by_spaces(d, m, ["lang:en", "kind:chat"], mode).select("uid", F.lit(mode).alias("mode")) for mode in ("union", "intersection", "difference")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def filter_units(spark: SparkSession, folder: str) -> DataFrame:
    found = u.filter_units(documents(spark, folder), {"lang": {"ne": "fr", "nin": ["pt", "zh"]}, "n_chars": {"gte": 100, "lt": 2000}, "text": {"contain": "the", "not_contain": "teapot"}, "source": {"bogus": 1}})
    return found.select("uid", "lang", "n_chars")


def filter_units_json(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "memory_units")
    found = u.filter_units(m, {"node_type": {"in": ["user_message"]}, "created": {"gte": "2022-01-01", "contain": "-0"}, "memory_space": {"eq": "raw"}}, payload="metadata")
    return found.select("uid", "ingested_at")


def deduplicate_units(spark: SparkSession, folder: str) -> DataFrame:
    return u.deduplicated(table(spark, folder, "memory_units"), "ingested_at").select("uid", "ingested_at")


def aggregate_results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "memory_units").groupBy("uid").agg(F.count("*").alias("n"))


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, folder, "memory_units").select("uid", "role", "text_content", "ingested_at")
    return u.deduplicated(m.where("ingested_at < timestamp'2023-01-01'"), "ingested_at"), m.where("ingested_at >= timestamp'2022-07-01'")


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    stored, new = _halves(spark, folder)
    return u.upsert(stored, new, "ingested_at").select("uid", "ingested_at", F.md5("text_content").alias("digest"))


def merge_report(spark: SparkSession, folder: str) -> DataFrame:
    stored, new = _halves(spark, folder)
    return u.upsert_report(stored, new, ["role", "text_content"])


def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    gone = documents(spark, folder).where("uid % 7 = 0").select("uid")
    out = u.delete_units(gone, {"units": (documents(spark, folder), ["uid"]), "members": (members(spark, folder), ["uid"]), "vectors": (table(spark, folder, "embeddings").withColumnRenamed("vec_id", "uid"), ["uid"])})
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("rows"), F.sum("uid").alias("sum_uid")).withColumn("name", F.lit(n)) for n, df in out.items()])


def merged_stores(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = (x.select("uid") for x in _sets(spark, folder))
    return u.merged_stores([("en", a), ("chat", b), ("long", c)]).select("store", "uid", "new_uid")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extracted_entities")
    return e.groupBy(F.col("entity_id").alias("id")).agg(F.min("entity_type").alias("node_type"), F.min("name").alias("text"), F.max("confidence").alias("confidence"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Relations between entities; an edge's type is that of its target."""
    e = table(spark, folder, "extracted_entities").groupBy("entity_id").agg(F.max("related_entities").alias("related"))
    out = e.select(F.col("entity_id").alias("src"), F.posexplode("related").alias("pos", "dst"))
    n = nodes(spark, folder).select(F.col("id").alias("dst"), F.lower("node_type").alias("type"), F.coalesce("confidence", F.lit(0.5)).alias("weight"))
    return out.join(n, "dst").select(F.concat_ws("#", "src", F.lpad(F.col("pos").cast("string"), 3, "0")).alias("edge_id"), "src", "dst", "type", "weight")


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).where("cast(substring(id, 5) as bigint) % 20 = 0").select(F.col("id").alias("uid"))


def name_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the seeds as queries."""
    return nodes(spark, folder).where("cast(substring(id, 5) as bigint) % 20 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("query"))


def explicit_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return g.neighbours(edges(spark, folder), seeds(spark, folder), ["person", "organization"]).select("seed", "uid")


def traverse_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return g.traverse(edges(spark, folder), seeds(spark, folder))


def relation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return g.relation_summary(edges(spark, folder), seeds(spark, folder))


def relation_samples(spark: SparkSession, folder: str) -> DataFrame:
    return g.relation_samples(edges(spark, folder))


def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return g.graph_summary(nodes(spark, folder), edges(spark, folder))


def subgraph_density(spark: SparkSession, folder: str) -> DataFrame:
    return g.subgraph_statistics(edges(spark, folder), nodes(spark, folder).where("node_type = 'Person'").select(F.col("id").alias("uid")))


def hop_expand(spark: SparkSession, folder: str) -> DataFrame:
    return g.expand_by_hops(edges(spark, folder), seeds(spark, folder), 2, 3)


def simple_paths(spark: SparkSession, folder: str) -> DataFrame:
    p = g.simple_paths(edges(spark, folder), seeds(spark, folder), None)
    return p.select("source", "target", F.array_join("path", ">").alias("path"), F.round("weight", 6).alias("weight"))


def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    s = seeds(spark, folder).select(F.col("uid").alias("source"))
    found = g.shortest_paths(edges(spark, folder), s, weight="weight")
    return found.select("source", "target", "hops", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def semantic_paths(spark: SparkSession, folder: str) -> DataFrame:
    p = g.simple_paths(edges(spark, folder), seeds(spark, folder), None, 4, 10)
    good = p.where("weight > 0.6").select("source", F.col("target").alias("uid")).distinct()
    out = g.semantic_paths(p, good, 5)
    return out.select("source", F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"), "rank")


def path_nodes(spark: SparkSession, folder: str) -> DataFrame:
    p = g.simple_paths(edges(spark, folder), seeds(spark, folder), None, 4, 3)
    return g.path_search(g.scored_paths(p, "relation_weight", 50), 20).select("uid", F.round("score", 6).alias("score"))


def edge_search(spark: SparkSession, folder: str) -> DataFrame:
    out = g.edge_search(edges(spark, folder), nodes(spark, folder), name_queries(spark, folder), 10)
    return out.select("query_id", "uid", F.round("score", 6).alias("score"), "rank")


def entity_communities(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_nodes(None, edges(spark, folder), "community", 0, rounds=3)


QUERIES = {
    f.__name__: f
    for f in (
        space_closure, space_stats, space_units, units_union, units_intersection, units_difference, units_by_spaces, filter_units, filter_units_json, deduplicate_units, aggregate_results, merge_upsert, merge_report,
        delete_cascade, merged_stores, explicit_neighbors, traverse_distinct, relation_summary, relation_samples, graph_summary, subgraph_density, hop_expand, simple_paths, shortest_path, semantic_paths, path_nodes, edge_search, entity_communities,
    )
}

MEMBERS = """
mem as (select 'lang:' || lang as space, doc_id as uid from documents where lang is not null union all
  select 'source:' || source, doc_id from documents where source is not null union all select 'kind:' || memory_space, doc_id from documents where memory_space is not null),
kids as (select distinct split_part(space, ':', 1) as parent, space as child from mem union all select 'corpus', unnest(['lang', 'source', 'kind', 'missing'])),
sp as (select parent as space from kids union select child from kids),
tree as (select space as ancestor, space, 0 as depth from sp union all select ancestor, child, depth + 1 from tree join kids on parent = tree.space)"""
_ABC = "a as (select doc_id as uid, lang, memory_space, n_chars from documents where lang = 'en'), b as (select doc_id as uid, lang, memory_space, n_chars from documents where memory_space = 'chat'), c as (select doc_id as uid, lang, memory_space, n_chars from documents where n_chars > 500)"
_HALVES = "m as (select uid, role, text_content, ingested_at from memory_units), st as (select * from m where ingested_at < timestamp '2023-01-01' qualify row_number() over (partition by uid order by ingested_at) = 1), nw as (select * from m where ingested_at >= timestamp '2022-07-01')"
GRAPH = """
nodes as (select entity_id as id, min(entity_type) as node_type, min(name) as text, max(confidence) as confidence from extracted_entities group by 1),
rel as (select entity_id as src, max(related_entities) as r from extracted_entities group by 1),
ex as (select src, unnest(r) as dst, unnest(range(len(r))) as pos from rel where len(r) > 0),
edges as (select src || '#' || lpad(cast(pos as varchar), 3, '0') as edge_id, src, dst, lower(node_type) as type, coalesce(confidence, 0.5) as weight from ex join nodes on id = dst),
seeds as (select id as uid from nodes where cast(substring(id, 5) as bigint) % 20 = 0)"""
_WALKS = (
    "with recursive " + GRAPH
    + """,
step as (select src, dst, arg_min(weight, edge_id) as w from edges where src <> dst group by 1, 2),
walk as (select uid as source, uid as target, [uid] as path, 0.0::double as total from seeds union all
  select source, dst, list_append(path, dst), total + w from walk join step on src = target where len(path) < {nodes} and not list_contains(path, dst)),
pa as (select source, target, array_to_string(path, '>') as path, path as nodes_, total / (len(path) - 1) as weight, row_number() over (partition by source, target order by len(path), array_to_string(path, '>')) as i from walk where len(path) > 1)
"""
)
_PATHS, FIVE_NODES = _WALKS.replace("{nodes}", "4"), _WALKS.replace("{nodes}", "5")
# The best ends of edges for the queries q(query_id, query), lower-cased.
EDGES_FOUND = """
rn as (select query_id, id, len(list_filter(ws, lambda w: contains(lower(coalesce(text, '')), w))) / len(ws) as r from nodes, qw),
rt as (select query_id, type, len(list_filter(ws, lambda w: contains(type, w))) / len(ws) as r from (select distinct type from edges), qw),
sc as (select a.query_id, edge_id, src, dst, a.r as ra, b.r as rb, least(1, 0.5 * t.r) + 0.3 * a.r + 0.3 * b.r as score from edges e, rn a, rn b, rt t
  where a.id = src and b.query_id = a.query_id and b.id = dst and t.query_id = a.query_id and t.type = e.type),
bst as (select *, row_number() over (partition by query_id order by round(score, 9) desc, edge_id) as i from sc where score > 0),
ends as (select query_id, src as uid, 0.7 * score * 0.8 + 0.3 * ra as score from bst where i <= 10 union all select query_id, dst, 0.7 * score + 0.3 * rb from bst where i <= 10),
ef as (select query_id, uid, max(score) as score from ends group by 1, 2),
er as (select *, row_number() over (partition by query_id order by round(score, 9) desc, uid) as rank from ef)"""
NAME_QUERIES = """
q as (select uid as query_id, text as query from seeds join nodes on id = uid),
qw as (select query_id, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '') as ws from q where trim(query) <> '')"""
ORACLES = {
    "space_closure": "with recursive " + MEMBERS + " select ancestor, space, depth from tree",
    "space_stats": "with recursive " + MEMBERS + """
select s.space, (select count(distinct uid) from tree join mem using (space) where ancestor = s.space) as recursive_units, (select count(distinct uid) from mem where mem.space = s.space) as direct_units,
  (select count(distinct child) from kids where parent = s.space) as child_spaces from sp s""",
    "space_units": "select doc_id as uid, lang, memory_space from documents where lang is not null or memory_space = 'log'",
    "units_union": f"with {_ABC} select * from a union select * from b union select * from c",
    "units_intersection": f"with {_ABC} select a.* from a semi join b using (uid) semi join c using (uid)",
    "units_difference": f"with {_ABC}, d as (select a.* from a anti join b using (uid)), e as (select d.* from d anti join c using (uid)) select * from e union all select * from e",
    "units_by_spaces": """
select doc_id as uid, 'union' as mode from documents where lang = 'en' or memory_space = 'chat' union all select doc_id, 'intersection' from documents where lang = 'en' and memory_space = 'chat' union all
select doc_id, 'difference' from documents where lang = 'en' and memory_space is distinct from 'chat'""",
    "filter_units": """
select doc_id as uid, lang, n_chars from documents where lang is distinct from 'fr' and coalesce(lang not in ('pt', 'zh'), true) and n_chars >= 100 and n_chars < 2000
  and contains(text, 'the') and not contains(text, 'teapot')""",
    "filter_units_json": "select uid, ingested_at from memory_units where metadata['node_type'] = 'user_message' and metadata['created'] >= '2022-01-01' and contains(metadata['created'], '-0') and memory_space = 'raw'",
    "deduplicate_units": "select uid, min(ingested_at) as ingested_at from memory_units group by uid",
    "aggregate_results": "select uid, count(*) as n from memory_units group by uid",
    "merge_upsert": f"with {_HALVES}, l as (select * from nw qualify row_number() over (partition by uid order by ingested_at desc) = 1) select uid, ingested_at, md5(text_content) as digest from l union all select uid, ingested_at, md5(text_content) from st anti join l using (uid)",
    "merge_report": f"""with {_HALVES} select count(*) as total, count(*) filter (st.uid is null) as added, count(*) filter (st.uid is not null and (st.role is distinct from nw.role or st.text_content is distinct from nw.text_content)) as changed,
  count(*) filter (st.uid is not null and st.role is not distinct from nw.role and st.text_content is not distinct from nw.text_content) as skipped from nw left join st using (uid)""",
    "delete_cascade": "with " + MEMBERS.split(",\nkids")[0] + """
select 'units' as name, count(*) as rows, cast(sum(doc_id) as bigint) as sum_uid from documents where doc_id % 7 <> 0 union all select 'members', count(*), cast(sum(uid) as bigint) from mem where uid % 7 <> 0
union all select 'vectors', count(*), cast(sum(vec_id) as bigint) from embeddings where vec_id not in (select doc_id from documents where doc_id % 7 = 0)""",
    "merged_stores": f"""with {_ABC}, t as (select 'en' as store, uid, 0 as o from a union all select 'chat', uid, 1 from b union all select 'long', uid, 2 from c)
select store, uid, case when row_number() over (partition by uid order by o) = 1 then cast(uid as varchar) else store || '::' || uid end as new_uid from t""",
    "explicit_neighbors": "with " + GRAPH + """
select src as seed, dst as uid from edges join seeds on src = seeds.uid where type in ('person', 'organization') union all select dst, src from edges join seeds on dst = seeds.uid where type in ('person', 'organization')""",
    "traverse_distinct": "with " + GRAPH + " select src as seed, dst as uid from edges join seeds on src = seeds.uid union select dst, src from edges join seeds on dst = seeds.uid",
    "relation_summary": "with " + GRAPH + """
select uid, relation, count(*) as edges from (select src as uid, type as relation from edges union all select dst, type || '_incoming' from edges) x semi join seeds using (uid) group by 1, 2""",
    "relation_samples": "with " + GRAPH + """,
p as (select type, src, dst, min(edge_id) as edge_id from edges group by 1, 2, 3),
q as (select p.*, r.edge_id as back_id from p left join p r on r.type = p.type and r.src = p.dst and r.dst = p.src)
select type, src || case when back_id is not null and src <> dst then ' <-> ' else ' -> ' end || dst as sample from q where back_id is null or src = dst or edge_id < back_id
qualify row_number() over (partition by type order by edge_id) <= 2""",
    "graph_summary": "with " + GRAPH + " select 'node' as kind, node_type as name, count(*) as n from nodes group by 2 union all select 'edge', type, count(*) from edges group by 2",
    "subgraph_density": "with " + GRAPH + """,
n as (select id from nodes where node_type = 'Person'), c as (select (select count(*) from n) as nodes, (select count(*) from edges where src in (from n) and dst in (from n)) as edges)
select nodes, edges, edges / (nodes * (nodes - 1)) as density from c""",
    "hop_expand": "with " + GRAPH + """,
ne as (select src as seed, dst as uid, edge_id, false as after from edges union all select dst, src, edge_id, true from edges),
n1 as (select seed, uid, min((after, edge_id)) as place from ne where seed <> uid group by 1, 2),
rk as (select seed, uid from n1 qualify row_number() over (partition by seed order by place, uid) <= 3),
h1 as (select rk.uid, 1 as hop, min(seed) as via from rk join seeds on seed = seeds.uid where rk.uid not in (select uid from seeds) group by 1),
h2 as (select rk.uid, 2 as hop, min(seed) as via from rk join h1 on seed = h1.uid where rk.uid not in (select uid from seeds) and rk.uid not in (select uid from h1) group by 1)
select * from h1 union all select * from h2""",
    "simple_paths": FIVE_NODES + "select source, target, path, round(weight, 6) as weight from pa where i <= 10",
    "shortest_path": "with recursive " + GRAPH + """,
step as (select src, dst, min(weight) as w from edges where src <> dst group by 1, 2),
walk(source, target, b) using key (source, target) as (select uid, uid, (0.0::double, 0) from seeds union
  select source, dst, b from (select w.source, s.dst, min((w.b[1] + s.w, w.b[2] + 1)) as b from walk w join step s on s.src = w.target group by 1, 2) n
  where not exists (select 1 from recurring.walk r where r.source = n.source and r.target = n.dst and r.b <= n.b))
select source, target, b[2] as hops, round(b[1], 6) as distance, round(1.0::double / (1 + b[2]), 6) as score from walk where source <> target""",
    "semantic_paths": _PATHS + """,
good as (select distinct source, target as uid from pa where i <= 10 and weight > 0.6),
gl as (select source, list(uid) as g from good group by 1),
sc as (select p.source, p.path, len(list_filter(p.nodes_[2:], lambda x: list_contains(coalesce(g, []), x))) / (len(p.nodes_) - 1) as score from pa p left join gl on gl.source = p.source where i <= 3)
select source, path, round(score, 6) as score, rank from (select *, row_number() over (partition by source order by round(score, 9) desc, path) as rank from sc) where rank <= 5""",
    "path_nodes": _PATHS + """,
top as (select * from pa where i <= 3 order by round(weight, 9) desc, source, target, path limit 50),
pl as (select weight, len(nodes_) as n, unnest(nodes_) as uid, unnest(range(len(nodes_))) as k from top),
bs as (select uid, max(weight * case when n = 1 or k = 0 or k = n - 1 then 1.0::double else 0.5 + 0.5 * (1 - k::double / (n - 1)) end) as score from pl group by 1)
select uid, round(score, 6) as score from bs order by round(score, 9) desc, uid limit 20""",
    "edge_search": "with " + GRAPH + "," + NAME_QUERIES + "," + EDGES_FOUND + " select query_id, uid, round(score, 6) as score, rank from er where rank <= 10",
    "entity_communities": "with " + GRAPH + """,
both_ as (select src as a, dst as b from edges where src <> dst union all select dst, src from edges where src <> dst), near as (select a, b, count(*) as n from both_ group by 1, 2),
l0 as (select distinct id as node, id as community from (select src as id from edges union select dst from edges))""" + "".join(f""",
v{i} as (select a, community, sum(n) as n from near join l{i - 1} on b = node group by 1, 2),
l{i} as (select node, coalesce(won, community) as community from l{i - 1} left join (select a, arg_min(community, (-n, community)) as won from v{i} group by 1) on a = node)""" for i in (1, 2, 3)) + " select node, community from l3",
}
