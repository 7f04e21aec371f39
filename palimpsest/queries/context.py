"""Plans over several searches, pruning of what they found, routing, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import token_estimate
from palimpsest.functions.time import utc_micros
from palimpsest.operators import cluster, prune, route
from palimpsest.operators.dense import near_pairs
from palimpsest.plans import search
from palimpsest.queries import retrieval as r
from palimpsest.session import written
from palimpsest.sources.tables import table

LAYERS = {"chat": "l0", "log": "l0", "digest": "l1", "insight": "l2", "card": "l2", "facts": "l2"}
TOWERS = {"chat": "hierarchical", "digest": "hierarchical", "insight": "hierarchical", "card": "kg", "facts": "episodic"}


def _mapped(column: str, names: dict[str, str]) -> F.Column:
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in names.items()], F.lit("other"))


def smart_search(spark: SparkSession, folder: str) -> DataFrame:
    corpus = search.Corpus(r.units(spark, folder), r.vectors(spark, folder), r.sparse_units(spark, folder), r.DIM)
    sparse = corpus.sparse.where("uid % 20 = 0").withColumnRenamed("uid", "query_id")
    return r._shown(search.smart_search(corpus, r.text_queries(spark, folder), r.vector_queries(spark, folder), sparse, k=r.K))


def _layers(spark: SparkSession, folder: str) -> DataFrame:
    return r.units(spark, folder).select("uid", _mapped("memory_space", LAYERS).alias("layer"))


def _layered(spark: SparkSession, folder: str) -> DataFrame:
    return search.layered(r._bm25(spark, folder, 100), _layers(spark, folder), {"l0": 10, "l1": 5, "l2": 3})


def hier_layer_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _layered(spark, folder).select("query_id", "layer", "uid", F.round("score", 6).alias("score"), "rank")


def hier_fuse(spark: SparkSession, folder: str) -> DataFrame:
    return r._shown(search.fused_layers(_layered(spark, folder), {"l0": 0.5, "l1": 0.8, "l2": 1.0}, 8))


def _seconds(docs: DataFrame) -> F.Column:
    return (utc_micros(docs, "created") / 1_000_000).cast("bigint").cast("double").alias("ts")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best lexical results of each query as chunks."""
    docs = table(spark, folder, "documents")
    d = docs.select(
        F.col("doc_id").alias("uid"), "text", _mapped("memory_space", TOWERS).alias("tower"), token_estimate(F.col("text")).alias("tokens"), _seconds(docs),
        F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), 0)).alias("entity_ids"), F.array("source").alias("source_ids"),
    )
    found, sparse = r.lexical_and_sparse(spark, folder, 20, 50)
    lo, hi = (f("score").over(Window.partitionBy("query_id")) for f in (F.min, F.max))
    scaled = found.withColumn("s", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))
    ranks = scaled.select("query_id", "uid", F.col("rank").alias("pos"), F.round("s", 6).alias("score"))
    for name, df in (("rank_splade", sparse), ("rank_dense", r._dense(spark, folder, 50))):
        ranks = ranks.join(df.select("query_id", "uid", F.col("rank").alias(name)), ["query_id", "uid"], "left")
    return ranks.join(d, "uid").select("query_id", F.col("uid").alias("chunk_id"), "pos", "score", "tower", "tokens", "ts", "entity_ids", "source_ids", F.col("pos").alias("rank_bm25"), F.coalesce("rank_splade", F.lit(9999)).alias("rank_splade"), F.coalesce("rank_dense", F.lit(9999)).alias("rank_dense"), "text")


NOW = 1_735_689_600.0


def mad_filter(spark: SparkSession, folder: str) -> DataFrame:
    return prune.mad_filter(chunks(spark, folder), 1.0).select("query_id", "chunk_id")


def arbitration(spark: SparkSession, folder: str) -> DataFrame:
    return prune.arbitration(chunks(spark, folder), F.lit(0.0), NOW).select("query_id", "chunk_id", F.round("arbitration", 8).alias("arbitration"))


def confidence_prune(spark: SparkSession, folder: str) -> DataFrame:
    return prune.confidence(chunks(spark, folder), ["rank_bm25", "rank_splade", "rank_dense"]).select("query_id", "chunk_id", "level", "promoted")


def cumulative_stop(spark: SparkSession, folder: str) -> DataFrame:
    return prune.cumulative_stop(prune.confidence(chunks(spark, folder), ["rank_bm25", "rank_splade", "rank_dense"]), 2.0).select("query_id", "chunk_id")


def budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    return prune.pack_by_score(chunks(spark, folder), 1000).select("query_id", "chunk_id", F.col("place").cast("bigint").alias("place"))


def context_join(spark: SparkSession, folder: str) -> DataFrame:
    found = written(chunks(spark, folder), "chunks")
    packed = prune.pack_by_score(found, 1000).join(found.select("query_id", "chunk_id", "text"), ["query_id", "chunk_id"])
    return prune.joined_context(packed).select("query_id", F.md5("context").alias("digest"), F.length("context").alias("n"))


def context_truncate(spark: SparkSession, folder: str) -> DataFrame:
    t = prune.truncated(r.units(spark, folder).select("uid", "text"), 100, token_estimate)
    return t.select("uid", F.md5("text").alias("digest"))


def disambiguate(spark: SparkSession, folder: str) -> DataFrame:
    return prune.disambiguate(prune.arbitration(chunks(spark, folder), F.lit(0.0), NOW), 5).select("query_id", "chunk_id", "dropped", "reason", "keeper")


def mmr_pack(spark: SparkSession, folder: str) -> DataFrame:
    return prune.pack_mmr(chunks(spark, folder), 800, reserve={"kg": 0.2, "episodic": 0.2})


def cascade_prune(spark: SparkSession, folder: str) -> DataFrame:
    return search.cascade(chunks(spark, folder), 1000, NOW, 5, "DYNAMIC_ADAPTIVE")


def tri_tower(spark: SparkSession, folder: str) -> DataFrame:
    """Three searches, one for each tower, brought together, pruned and ranked."""
    u, stored = r.units(spark, folder).withColumn("tower", _mapped("memory_space", TOWERS)), r.index(spark, folder)
    parts = {t: r._bm25(spark, folder, 10, u.where(F.col("tower") == t), stored) for t in ("hierarchical", "kg", "episodic")}
    found = search.tower_candidates(parts)
    d = chunks_of(spark, folder)
    return search.cascade(found.join(d, "uid").withColumnRenamed("uid", "chunk_id"), 1000, NOW, 5)


def chunks_of(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("uid"), token_estimate(F.col("text")).alias("tokens"), _seconds(docs), F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), 0)).alias("entity_ids"), F.array("source").alias("source_ids")
    )


# A sentence's end: ASCII signs count before white space or the end only (not inside links and numbers, not after titles and initials), others anywhere; so do line breaks.
_CLOSING = r"[\"'”’»)\]」』）]*"
_SENTENCE_END = rf"(?<!\b(?:Dr|Mr|Mrs|Ms|Prof|St|vs|e\.g|i\.e|\p{{Lu}})\.)(?<=[.!?…]{_CLOSING.replace('*', '{0,3}')})\s+|(?<=[。！？؟۔।]{_CLOSING.replace('*', '{0,3}')})(?![。！？؟۔।!?\"'”’»)\]」』）])\s*|[\r\n]+"


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of messages that end with a question mark (ASCII, full-width or Arabic), whole, in any script."""
    m = table(spark, folder, "memory_units").dropDuplicates(["uid"])
    sentences = F.transform(F.split("text_content", _SENTENCE_END), lambda s: F.regexp_replace(s, r"^[^\p{L}\p{N}]+|\s+$", ""))
    asked = F.filter(sentences, lambda s: s.rlike(rf"[\p{{L}}\p{{N}}].*[?？؟][!?！？؟]*{_CLOSING}$"))
    return m.select("uid", F.posexplode(asked).alias("no", "question"))


def route_locomo(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).select("uid", "no", route.locomo_category(F.col("question")).alias("category"))
    return route.routed(q)


def route_longmemeval(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("uid", "no", route.longmemeval_category(F.col("question")).alias("category"))


def routing_stats(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder).select(route.longmemeval_category(F.col("question")).alias("category"))
    return route.routing_statistics(q).select("category", "questions", F.round("share", 6).alias("share"))


def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.dbscan(r.vectors(spark, folder), r.DIM, 0.75, 3)


def dbscan_core(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours within a cosine distance of 0.7, unscaled, and which vectors are core points."""
    near = near_pairs(r.vectors(spark, folder).select("uid", "v"), r.DIM, 0.3)
    return near.groupBy("uid").agg((F.count("*") + 1).alias("n")).select("uid", "n", (F.col("n") >= 3).alias("core"))


def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("uid"), "text", "created", "memory_space")
    groups = d.select("uid", F.col("memory_space").alias("cluster"))
    return cluster.cluster_profile(d.drop("memory_space"), groups)


QUERIES = {
    f.__name__: f
    for f in (
        smart_search, hier_layer_topk, hier_fuse, mad_filter, arbitration, confidence_prune, cumulative_stop, budget_pack, context_join, context_truncate, disambiguate, mmr_pack, cascade_prune, tri_tower, route_locomo, route_longmemeval,
        routing_stats, dbscan, dbscan_core, cluster_profile,
    )
}

_BM = "with " + r.BM25.replace("{where}", "")
_LAYERED = _BM + """,
ly as (select query_id, case when memory_space in ('chat', 'log') then 'l0' when memory_space = 'digest' then 'l1' else 'l2' end as layer, uid, score from bm25 join documents on doc_id = uid where rank <= 100),
lr as (select *, row_number() over (partition by query_id, layer order by round(score, 9) desc, uid) as rank from ly),
lk as (select * from lr where rank <= case layer when 'l0' then 10 when 'l1' then 5 else 3 end)"""
_ESTIMATE = "cast(floor((length(regexp_replace({t}, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 2 - length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) + length({t}) * 4) / 10.0) as bigint)"
_CHUNKS = _BM + "," + r.VEC.replace("{where}", "") + "," + r.SPARSE + """,
b20 as (select query_id, uid, rank as pos, score, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from bm25 where rank <= 20),
chunks as (select b.query_id, b.uid as chunk_id, pos, round(case when hi > lo then (b.score - lo) / (hi - lo) else 1 end, 6) as score,
  case when memory_space in ('chat', 'digest', 'insight') then 'hierarchical' when memory_space = 'card' then 'kg' when memory_space = 'facts' then 'episodic' else 'other' end as tower,
  """ + _ESTIMATE.replace("{t}", "d.text") + """ as tokens, epoch(created)::bigint::double as ts, pos as rank_bm25, coalesce(s.rank, 9999) as rank_splade, coalesce(c.rank, 9999) as rank_dense, d.text
  from b20 b join documents d on d.doc_id = b.uid left join splade s on s.query_id = b.query_id and s.uid = b.uid and s.rank <= 50 left join cosine c on c.query_id = b.query_id and c.uid = b.uid and c.rank <= 50)"""
_CONF = _CHUNKS + """,
cf as (select *, (rank_bm25 <= 10)::int + (rank_splade <= 10)::int + (rank_dense <= 10)::int as good from chunks),
cl as (select *, score < 0.7 and score >= 0.3 and good >= 2 as promoted, case when score < 0.3 then 'DROP' when score >= 0.7 or good >= 2 then 'HIGH' else 'MED' end as level from cf)"""
_PACK = _CHUNKS + """,
pk as (select *, row_number() over w as place, sum(tokens) over w + 2 * (row_number() over w - 1) as upto from chunks window w as (partition by query_id order by round(score, 9) desc, pos)),
ok as (select *, max((upto > 1000)::int) over (partition by query_id order by place rows unbounded preceding) as over_ from pk)"""
_CLOSE = """["''”’»)\\]」』）]"""
_Q = f"""with m as (select uid, any_value(text_content) as t from memory_units group by uid),
m1 as (select uid, regexp_replace(t, '\\b(Dr|Mr|Mrs|Ms|Prof|St|vs|e\\.g|i\\.e|\\p{{Lu}})\\.(\\s)', '\\1' || chr(1) || '\\2', 'g') as t from m where t is not null),
m2 as (select uid, regexp_replace(t, '([.!?…]{_CLOSE}{{0,3}})\\s+', '\\1' || chr(10), 'g') as t from m1),
m3 as (select uid, replace(regexp_replace(t, '([。！？؟۔।](?:[。！？؟۔।!?]|{_CLOSE})*)\\s*', '\\1' || chr(10), 'g'), chr(1), '.') as t from m2),
e as (select uid, list_filter(list_transform(regexp_split_to_array(t, '[\\r\\n]+'), lambda s: regexp_replace(s, '^[^\\p{{L}}\\p{{N}}]+|\\s+$', '', 'g')), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}].*[?？؟][!?！？؟]*{_CLOSE}*$')) as qs from m3),
q as (select uid, unnest(range(len(qs))) as no, unnest(qs) as question from e), l as (select uid, cast(no as int) as no, question, lower(question) as q from q)"""
_RX = lambda p: "regexp_matches(q, '" + p.replace("'", "''") + "')"
_LME = (
    f"case when {_RX(route.LONGMEMEVAL_TEMPORAL)} then 'temporal-reasoning' when " + " + ".join(f"{_RX(p)}::int" for p in route.LONGMEMEVAL_UPDATE)
    + f" >= 2 then 'knowledge-update' when {_RX(route.LONGMEMEVAL_PREFERENCE)} then 'single-session-preference' else 'multi-session' end"
)
_LOC = (
    f"case when {_RX(route.LOCOMO_RULES[0][1])} then 2 when {_RX(route.LOCOMO_RULES[1][1])} then 3 when {_RX(route.LOCOMO_RULES[2][1])} and len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) <= 12 then 4"
    f" when {_RX(route.LOCOMO_RULES[3][1])} then 1 else 4 end"
)
QUESTIONS_CATEGORIES = _Q + f", c as (select uid, no, question, {_LME} as category from l)"
QUESTIONS_LOCOMO = _Q + f", c as (select uid, no, question, {_LOC} as category from l)"
ORACLES = {
    "smart_search": r.ORACLES["rrf"],
    "hier_layer_topk": _LAYERED + " select query_id, layer, uid, round(score, 6) as score, rank from lk",
    "hier_fuse": _LAYERED + ", fused as (select query_id, uid, max(score * case layer when 'l0' then 0.5 when 'l1' then 0.8 else 1 end) as score from lk group by 1, 2)" + r._FUSED.replace("rank <= 10", "rank <= 8"),
    "mad_filter": _CHUNKS + """,
m1 as (select query_id, median(score) as mid, count(*) as n from chunks group by 1), m2 as (select query_id, median(abs(score - mid)) as mad from chunks join m1 using (query_id) group by 1)
select query_id, chunk_id from chunks join m1 using (query_id) join m2 using (query_id) where n < 2 or mad < 1e-6 or score >= mid - mad""",
    "arbitration": _CHUNKS + """,
rf as (select *, max(case when ts > 0 then ts end) over (partition by query_id) as ref from chunks)
select query_id, chunk_id, round(0.5 * score + 0.3 * case tower when 'hierarchical' then 1 when 'episodic' then 0.8 when 'kg' then 0.6 else 0.5 end
  + 0.2 * case when ts > 0 then exp(-abs(ref - ts) / 3600 / 720) * case when ts > ref then 0.2 else 1 end else 0.5 end, 8) as arbitration from rf""",
    "disambiguate": _CHUNKS.replace("with ", "with recursive ", 1) + """,
rf as (select *, max(case when ts > 0 then ts end) over (partition by query_id) as ref from chunks),
ar as (select rf.*, list_concat(list_transform(regexp_extract_all(rf.text, '[A-Z][a-z]+ [A-Z][a-z]+'), lambda x: 'e' || x), ['s' || coalesce(d.source, 'None')]) as keys,
  0.5 * score + 0.3 * case tower when 'hierarchical' then 1 when 'episodic' then 0.8 when 'kg' then 0.6 else 0.5 end + 0.2 * case when ts > 0 then exp(-abs(ref - ts) / 3600 / 720) * case when ts > ref then 0.2 else 1 end else 0.5 end as arb
  from rf join documents d on d.doc_id = chunk_id),
od as (select query_id, chunk_id, {'c': chunk_id, 'tower': tower, 'keys': keys, 'ts': ts, 'score': score} as x, row_number() over (partition by query_id order by arb desc, pos) as i from ar),
st as (select query_id, i, x, [x] as acc, 0 as drops, chunk_id, false as dropped, null::varchar as reason, null::bigint as keeper from od where i = 1 union all
  select query_id, i, x, case when drop_ then acc else list_append(acc, x) end, drops + drop_::int, chunk_id, drop_,
    case when not drop_ then null when x.ts > 0 and hit.ts > 0 and hit.ts - x.ts > 2592000 then 'STALE' when x.score < 0.5 * hit.score then 'LOW_SCORE' else 'REDUNDANT' end, case when drop_ then hit.c end from (
    select *, hit is not null and drops < 5 as drop_ from (
      select query_id, i, x, acc, drops, chunk_id, list_filter(acc, lambda a: list_contains(a.keys, key))[1] as hit from (
        select o.query_id, o.i, o.x, s.acc, s.drops, o.chunk_id, list_filter(o.x.keys, lambda k: len(list_filter(s.acc, lambda a: list_contains(a.keys, k))) > 0 and len(list_filter(s.acc, lambda a: list_contains(a.keys, k) and a.tower = o.x.tower)) = 0)[1] as key
        from st s join od o on o.query_id = s.query_id and o.i = s.i + 1) k1) k2) k3)
select query_id, chunk_id, dropped, reason, keeper from st""",
    "confidence_prune": _CONF + " select query_id, chunk_id, level, promoted from cl",
    "cumulative_stop": _CONF + """,
cu as (select *, row_number() over (partition by query_id order by round(score, 9) desc, pos) - 1 as i from cl where level <> 'DROP'),
cv as (select *, coalesce(sum(score * pow(0.9, i)) over (partition by query_id order by i rows between unbounded preceding and 1 preceding), 0) as before_ from cu)
select query_id, chunk_id from cv where round(before_, 9) < 2.0""",
    "budget_pack": _PACK + " select query_id, chunk_id, place from ok where over_ = 0",
    "context_join": _PACK + ", j as (select query_id, string_agg(text, chr(10) || chr(10) order by place) as c from ok where over_ = 0 group by 1) select query_id, md5(c) as digest, cast(length(c) as int) as n from j",
    "context_truncate": """
with l as (select doc_id as uid, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null),
n as (select *, greatest(1, """ + _ESTIMATE.replace("{t}", "(line || chr(10))") + """) as n from l),
u as (select *, sum(n) over (partition by uid order by i desc) as upto from n),
j as (select uid, string_agg(line, chr(10) order by i) as t from u where upto <= 100 group by 1)
select doc_id as uid, md5(case when """ + _ESTIMATE.replace("{t}", "text") + """ <= 100 then text else coalesce(t, '') end) as digest from documents left join j on uid = doc_id where text is not null""",
    "route_locomo": _Q + f""", c as (select uid, no, {_LOC} as category from l)
select uid, no, category, case when category = 5 then 0 else 15 end as hierarchical_k, case when category = 1 then 0 else 30 end as graph_k, case when category = 2 then 0 else 30 end as episodic_k, case when category = 5 then 35 else 20 end as final_k from c""",
    "route_longmemeval": _Q + f" select uid, no, {_LME} as category from l",
    "routing_stats": _Q + f", c as (select {_LME} as category from l) select category, count(*) as questions, round(count(*) / (select count(*) from c), 6) as share from c group by 1",
    "dbscan": """with recursive x as (select vec_id as uid, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as i from embeddings),
st as (select i, avg(x) as m, stddev_pop(x) as s from x group by 1), z as (select uid, list(case when s > 0 then (x - m) / s else 0 end order by i) as v from x join st using (i) group by 1),
n as (select uid, v, sqrt(list_inner_product(v, v)) as norm from z),
p as (select a.uid, b.uid as other from n a, n b where a.uid <> b.uid and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.25 - 1e-9),
core as (select uid from p group by 1 having count(*) + 1 >= 3),
comp(uid, c) using key (uid) as (select uid, uid from core union
  select p.uid, min(w.c) from comp w join p on p.other = w.uid join core on core.uid = p.uid join recurring.comp r on r.uid = p.uid group by p.uid, r.c having min(w.c) < r.c),
cl as (select uid, dense_rank() over (order by c) - 1 as cluster from comp),
bo as (select p.uid, min(cl.cluster) as cluster from p join cl on cl.uid = p.other where p.uid not in (select uid from core) group by 1),
al as (select uid, cluster, true as core from cl union all select uid, cluster, false from bo)
select vec_id as uid, cast(coalesce(cluster, -1) as int) as cluster, coalesce(core, false) as core from embeddings left join al on al.uid = vec_id""",
    "dbscan_core": "with " + r.VEC.split(",\ncs as")[0] + """,
p as (select a.uid, count(*) + 1 as n from nv a, nv b where a.uid <> b.uid and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.3 - 1e-9 group by 1)
select uid, n, n >= 3 as core from p""",
    "cluster_profile": "with " + r.TOKENS + """,
z as (select memory_space as cluster, count(*) as size, datediff('day', min(created), max(created)) as span_days from documents group by 1),
c as (select memory_space as cluster, term as w, count(*) as n from tok join documents on doc_id = uid where length(term) > 2 group by 1, 2),
k as (select *, row_number() over (partition by cluster order by n desc, w) as i from c)
select cluster, size, cast(span_days as int) as span_days, string_agg(w, ' ' order by i) as words from z join k using (cluster) where i <= 10 group by 1, 2, 3""",
}
