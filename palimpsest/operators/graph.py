"""A directed multigraph: nodes (``id, node_type``), edges (``edge_id, src, dst, type``, optionally ``weight`` and text columns)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import lexical
from palimpsest.operators.ranking import top_k
from palimpsest.session import written


def _of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("type").isin(*types)) if types else edges


def neighbours(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, direction: str = "all") -> DataFrame:
    """``seed, uid, edge_id, outgoing``: one row for each edge and seed, repeats kept. Directions: successors, predecessors, else both."""
    e, s = _of_types(edges, types), seeds.select(F.col("uid").alias("seed"))
    out = e.join(s, e.src == s.seed).select("seed", F.col("dst").alias("uid"), "edge_id", F.lit(True).alias("outgoing"))
    inn = e.join(s, e.dst == s.seed).select("seed", F.col("src").alias("uid"), "edge_id", F.lit(False).alias("outgoing"))
    return out if direction == "successors" else inn if direction == "predecessors" else out.unionByName(inn)


def traverse(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, direction: str = "all", within: DataFrame | None = None) -> DataFrame:
    """``seed, uid``: distinct neighbours, of the uids ``within`` if given; an unknown direction finds none."""
    if direction not in ("all", "successors", "predecessors"):
        return seeds.select(F.col("uid").alias("seed"), "uid").limit(0)
    found = neighbours(edges, seeds, types, direction).select("seed", "uid").distinct()
    return found.join(within.select("uid"), "uid", "left_semi") if within is not None else found


def relation_summary(edges: DataFrame, uids: DataFrame) -> DataFrame:
    """``uid, relation, edges``: a node's edges by type; incoming ones as ``<type>_incoming``."""
    n = uids.select("uid").distinct()
    both = edges.select(F.col("src").alias("uid"), F.col("type").alias("relation")).unionByName(edges.select(F.col("dst").alias("uid"), F.concat("type", F.lit("_incoming")).alias("relation")))
    return both.join(n, "uid", "left_semi").groupBy("uid", "relation").agg(F.count("*").alias("edges"))


def relation_samples(edges: DataFrame, per_type: int = 2) -> DataFrame:
    """``type, sample``: the first edges of each type as ``u -> v``; a pair with edges of the type both ways is shown once as ``u <-> v``."""
    pairs = edges.groupBy("type", "src", "dst").agg(F.min("edge_id").alias("edge_id"))
    back = pairs.select("type", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("edge_id").alias("back_id"))
    both = pairs.join(back, ["type", "src", "dst"], "left")
    shown = both.where("back_id is null or src = dst or edge_id < back_id").withColumn("sample", F.concat("src", F.when(F.col("back_id").isNotNull() & (F.col("src") != F.col("dst")), " <-> ").otherwise(" -> "), "dst"))
    w = Window.partitionBy("type").orderBy("edge_id")
    return shown.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_type).select("type", "sample")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, name, n``: counts of nodes and edges by type."""
    a = nodes.groupBy("node_type").count().select(F.lit("node").alias("kind"), F.col("node_type").alias("name"), F.col("count").alias("n"))
    return a.unionByName(edges.groupBy("type").count().select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n")))


def subgraph_statistics(edges: DataFrame, uids: DataFrame) -> DataFrame:
    """One row: nodes, edges among them, and their density e / (n (n - 1))."""
    n = uids.select("uid").distinct()
    inner = edges.join(n.withColumnRenamed("uid", "src"), "src", "left_semi").join(n.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    counts = n.agg(F.count("*").alias("nodes")).crossJoin(inner.agg(F.count("*").alias("edges")))  # one row each
    return counts.withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def expand_by_hops(edges: DataFrame, seeds: DataFrame, hops: int = 1, most: int = 10, types: list[str] | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """``uid, hop, via``: nodes reached from the seeds, breadth first; the seeds aren't among them.

    A node brings in its first ``most`` distinct neighbours (outgoing edges first, in order of edge), then
    up to half as many semantic ones (``semantic``: src, dst, score). A node belongs to the first hop that reaches it, and
    there to its smallest bringer. The node a hop starts from may be busy: its neighbours are reduced to one row each before they are ranked.
    """
    visited = seeds.select("uid").distinct()
    front, found = visited, None
    for hop in range(1, hops + 1):
        near = neighbours(edges, front, types).where("seed <> uid").groupBy("seed", "uid").agg(F.min(F.struct((~F.col("outgoing")).alias("after"), "edge_id")).alias("at"))
        w = Window.partitionBy("seed").orderBy("at", "uid")
        reached = near.withColumn("i", F.row_number().over(w)).where(F.col("i") <= most).select("seed", "uid")
        if semantic is not None:
            alike = semantic.join(front.withColumnRenamed("uid", "src"), "src", "left_semi").select(F.col("src").alias("seed"), F.col("dst").alias("uid"), "score")
            ws = Window.partitionBy("seed").orderBy(F.col("score").desc(), "uid")
            reached = reached.unionByName(alike.withColumn("i", F.row_number().over(ws)).where(F.col("i") <= most // 2).select("seed", "uid"))
        claimed = reached.groupBy("uid").agg(F.min("seed").alias("via")).join(visited, "uid", "left_anti").withColumn("hop", F.lit(hop)).select("uid", "hop", "via")
        found = claimed if found is None else found.unionByName(claimed)
        front = claimed.select("uid")
        visited = visited.unionByName(front)
    return found


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame | None, max_nodes: int = 5, per_pair: int = 10, types: list[str] | None = None) -> DataFrame:
    """``source, target, path, weight``: directed paths without a repeated node, of up to ``max_nodes`` nodes; the ``per_pair``
    shortest of each pair, ties by path. Of parallel edges the first counts; ``weight`` is the mean of the edges' (1 if they have none).
    Every path of up to ``max_nodes`` nodes is made, since a longer one may be the only one that some detour leaves; their number grows with the degree to the power ``max_nodes`` - 1."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    step = _of_types(edges, types).where("src <> dst").groupBy("src", "dst").agg(F.min_by(weight, "edge_id").alias("w"))
    front = sources.select(F.col("uid").alias("source"), F.col("uid").alias("target"), F.array("uid").alias("path"), F.lit(0.0).alias("total")).distinct()
    found = None
    for _ in range(max_nodes - 1):
        front = front.join(step, front.target == step.src).where(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("w")).alias("total"))
        found = front if found is None else found.unionByName(front)
    if targets is not None:
        found = found.join(targets.select(F.col("uid").alias("target")).distinct(), "target", "left_semi")
    w = Window.partitionBy("source", "target").orderBy(F.size("path"), F.array_join("path", ">"))
    ranked = found.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_pair)
    return ranked.select("source", "target", "path", (F.col("total") / (F.size("path") - 1)).alias("weight"))


def scored_paths(paths: DataFrame, scoring: str, k: int, with_vectors: DataFrame | None = None) -> DataFrame:
    """The k best paths: ``length`` 1 / nodes, ``relation_weight`` the mean weight, ``semantic`` a half if any node has a vector."""
    if scoring == "semantic":
        has = paths.withColumn("node", F.explode("path")).join(with_vectors.select(F.col("uid").alias("node")), "node", "left_semi").select("source", "path").distinct().withColumn("score", F.lit(0.5))
        scored = paths.join(has, ["source", "path"], "left").fillna(0.0, ["score"])
    else:
        scored = paths.withColumn("score", F.col("weight") if scoring == "relation_weight" else 1 / F.size("path"))
    return scored.orderBy(F.round("score", 9).desc(), "source", "target", F.array_join("path", ">")).limit(k)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, weight: str | None = None) -> DataFrame:
    """``source, target, hops, distance, score``: the least distance of each reachable pair (weight 1 without a column, none negative), over at most ``max_hops`` edges
    if given, the fewest edges of such; score 1 / (1 + edges). Pairs without a column ``target``: each source with all other nodes it reaches.
    Rounds go on until no distance changes; a source reaches each node once a round."""
    step = written(edges.groupBy("src", "dst").agg(F.min(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("src <> dst"), "steps")
    if not step.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    best = pairs.select(F.col("source"), F.col("source").alias("node")).distinct().withColumn("distance", F.lit(0.0)).withColumn("hops", F.lit(0))
    best = front = written(best, "distances")
    hop = 0
    while (max_hops is None or hop < max_hops) and not front.isEmpty():
        hop += 1
        moved = front.join(step, front.node == step.src).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), F.lit(hop).alias("hops"))
        every = best.unionByName(moved).groupBy("source", "node").agg(F.min(F.struct("distance", "hops")).alias("b")).select("source", "node", "b.distance", "b.hops")
        best = written(every, "distances")
        front = best.where(F.col("hops") == hop)
    found = best.withColumnRenamed("node", "target")
    hit = pairs.select("source", "target").distinct().join(found, ["source", "target"]) if "target" in pairs.columns else found.where("source <> target")
    return hit.select("source", "target", "hops", "distance", (1 / (1 + F.col("hops"))).alias("score"))


def semantic_paths(paths: DataFrame, good: DataFrame, per_source: int) -> DataFrame:
    """Paths scored by the share of their nodes after the source that are among ``good`` (``source, uid``); at most three a pair, ``per_source`` a source."""
    w = Window.partitionBy("source", "target").orderBy(F.size("path"), F.array_join("path", ">"))
    three = paths.withColumn("i", F.row_number().over(w)).where("i <= 3").select("source", "target", "path")
    sets = good.groupBy("source").agg(F.collect_set("uid").alias("good"))
    rest = F.slice("path", 2, F.size("path"))
    scored = three.join(sets, "source", "left").withColumn("score", F.size(F.filter(rest, lambda x: F.coalesce(F.array_contains("good", x), F.lit(False)))) / (F.size("path") - 1))
    r = Window.partitionBy("source").orderBy(F.round("score", 9).desc(), F.array_join("path", ">"))
    return scored.withColumn("rank", F.row_number().over(r).cast("bigint")).where(F.col("rank") <= per_source).select("source", "target", "path", "score", "rank")


def relevant_texts(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, text, relevance`` of the distinct texts (``text``) in which a query (``query_id, query``) has a word, by ``relevance``. A word can only occur in a
    text that has its first three signs (or all, if it is shorter), so the two meet by those and are then compared."""
    said = queries.select("query_id", F.explode(F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"\s+"), lambda w: w != "")).alias("word"))
    counted = said.groupBy("query_id", "word").agg(F.count("*").alias("times"))
    words = said.groupBy("query_id").agg(F.count("*").alias("words"))
    distinct = texts.select("text").where("text <> ''").distinct().withColumn("low", F.lower("text"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.array(*[F.substring(F.col("low"), i, F.lit(n)) for n in (1, 2, 3)]))))
    found = counted.select("word").distinct().withColumn("gram", F.substring("word", 1, 3)).join(distinct.withColumn("gram", F.explode(grams)), "gram").where(F.contains("low", "word")).select("word", "text")
    hits = counted.join(found, "word").groupBy("query_id", "text").agg(F.sum("times").alias("hits"))
    return hits.join(words, "query_id").select("query_id", "text", (F.col("hits") / F.col("words")).alias("relevance"))


def edge_search(edges: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, edge_texts: tuple[str, ...] = (), strategy: str = "both", types: list[str] | None = None) -> DataFrame:
    """``query_id, uid, score, rank``: ends of the edges that fit a query best.

    An edge's score: half the relevance of its type and 0.3 of that of each text column, 1 at most, plus 0.3 of each
    end's text. Of the k best edges with a positive score the ends come out (``both``: source 0.8, target 1; ``source``, ``target``; ``most_relevant``: the better of the two), scored 0.7 by
    edge and 0.3 by their own text, the best once. Relevance is found for distinct texts, and only edges with a relevant one meet the query.
    """
    text = nodes.select("id", F.coalesce("text", F.lit("")).alias("t"))
    e = _of_types(edges, types).join(text.select(F.col("id").alias("src"), F.col("t").alias("src_text")), "src").join(text.select(F.col("id").alias("dst"), F.col("t").alias("dst_text")), "dst")
    e = written(e.select("edge_id", "src", "dst", "src_text", "dst_text", "type", *edge_texts), "edge-texts")
    columns = ("src_text", "dst_text", "type", *edge_texts)
    every = reduce(lambda a, b: a.unionByName(b), [e.select(F.col(c).alias("text")) for c in columns])
    rel = written(relevant_texts(every, queries), "relevant-texts")
    part = lambda c: e.join(rel, e[c] == rel.text).select("query_id", "edge_id", "src", "dst", *((F.col("relevance") if d == c else F.lit(0.0)).alias(f"r{i}") for i, d in enumerate(columns)))
    parts = reduce(lambda a, b: a.unionByName(b), map(part, columns)).groupBy("query_id", "edge_id", "src", "dst").agg(*(F.max(f"r{i}").alias(f"r{i}") for i in range(len(columns))))
    props = reduce(lambda a, b: a + b, [0.3 * F.col(f"r{i}") for i in range(3, len(columns))], 0.5 * F.col("r2"))
    best = top_k(parts.withColumn("score", F.least(F.lit(1.0), props) + 0.3 * F.col("r0") + 0.3 * F.col("r1")), ["query_id"], k, tie="edge_id")
    a = F.struct(F.col("src").alias("uid"), F.col("r0").alias("own"), F.lit(0.8 if strategy == "both" else 1.0).alias("role"))
    b = F.struct(F.col("dst").alias("uid"), F.col("r1").alias("own"), F.lit(1.0).alias("role"))
    ends = {"source": F.array(a), "target": F.array(b), "most_relevant": F.array(F.when(F.col("r0") >= F.col("r1"), a).otherwise(b))}.get(strategy, F.array(a, b))
    out = best.select("query_id", "score", F.explode(ends).alias("x")).select("query_id", "x.uid", (0.7 * F.col("score") * F.col("x.role") + 0.3 * F.col("x.own")).alias("score"))
    return top_k(out.groupBy("query_id", "uid").agg(F.max("score").alias("score")), ["query_id"], k)


def placed_nodes(paths: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of scored paths with a score: the path's times its place (1 at the ends, falling from 1 to 0.5 between), the best once for each value of ``by``."""
    placed = paths.select(*by, "score", F.size("path").alias("n"), F.posexplode("path").alias("i", "uid"))
    place = F.when((F.col("n") == 1) | (F.col("i") == 0) | (F.col("i") == F.col("n") - 1), 1.0).otherwise(0.5 + 0.5 * (1 - F.col("i") / (F.col("n") - 1)))
    return placed.groupBy(*by, "uid").agg(F.max(F.col("score") * place).alias("score"))


def path_search(paths: DataFrame, k: int) -> DataFrame:
    """``uid, score``: the k best nodes of scored paths."""
    return placed_nodes(paths, []).orderBy(F.round("score", 9).desc(), "uid").limit(k)


def hybrid(parts: dict[str, tuple[float, DataFrame]], k: int) -> DataFrame:
    """The best weighted score of each unit over several searches (``query_id, uid, score``), not their sum."""
    union = reduce(lambda a, b: a.unionByName(b), [df.select("query_id", "uid", (F.col("score") * w).alias("score")) for w, df in parts.values()])
    return top_k(union.groupBy("query_id", "uid").agg(F.max("score").alias("score")), ["query_id"], k)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``node, community``: each node takes the commonest label among its neighbours, ties the smallest, for some rounds; labels start as the nodes. An approximation of modularity communities."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b")
    near = written(both.groupBy("a", "b").count(), "adjacent")
    labels = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = near.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("count").alias("n"))
        won = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("w")).select(F.col("a").alias("node"), F.col("w.community").alias("won"))
        labels = written(labels.join(won, "node", "left").select("node", F.coalesce("won", "community").alias("community")), "labels")
    return labels


def graph_search(mode: str, nodes: DataFrame, edges: DataFrame, queries: DataFrame, paths: DataFrame | None, k: int) -> DataFrame:
    """``query_id, uid, score, rank`` by the named mode: ``node``, ``edge``, ``path`` (``paths``: query_id, path, score), or for ``hybrid`` and any unknown mode the best
    of 0.5 of half as many nodes more, 0.3 of the edges and, if there are paths, 0.2 of half as many of their nodes."""
    by_node = lambda n: lexical.bm25(lexical.build_index(nodes.select(F.col("id").alias("uid"), "text")).stored(), queries, n)
    by_edge = lambda n: edge_search(edges, nodes, queries, n)
    by_path = lambda n: top_k(placed_nodes(paths, ["query_id"]), ["query_id"], n)
    if mode == "node":
        return by_node(k)
    if mode == "edge":
        return by_edge(k)
    if mode == "path":
        return by_path(k) if paths is not None else by_node(k).limit(0)
    parts = {"nodes": (0.5, by_node(int(k * 1.5))), "edges": (0.3, by_edge(k))}
    return hybrid(parts | ({"paths": (0.2, by_path(int(k * 0.5)))} if paths is not None else {}), k)


def enriched(edges: DataFrame, results: DataFrame, hops: int = 1, most: int = 5, semantic: DataFrame | None = None) -> dict[str, DataFrame]:
    """What surrounds results (``uid``) in the graph: ``expanded`` (uid, hop, via), ``paths`` (shortest ones between each two results), ``relations`` (by result and type) and one row of ``statistics``
    of the results and what they were expanded by."""
    seeds = written(results.select("uid").distinct(), "results")
    expanded = written(expand_by_hops(edges, seeds, hops, most, semantic=semantic), "expanded")
    reached = shortest_paths(edges, seeds.select(F.col("uid").alias("source")))
    return {
        "expanded": expanded, "paths": reached.join(seeds.select(F.col("uid").alias("target")), "target", "left_semi").where("source < target"),
        "relations": relation_summary(edges, seeds), "statistics": subgraph_statistics(edges, seeds.unionByName(expanded.select("uid"))),
    }


def nodes_of_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a type, or whose text contains its name."""
    return nodes.where((F.col("node_type") == kind) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(kind.lower())))


def speakers(messages: DataFrame, name: str) -> DataFrame:
    """A node for each distinct speaker."""
    return messages.where(F.trim(name) != "").select(F.concat(F.lit("entity_"), F.regexp_replace(F.trim(name), r"\s+", "_")).alias("id"), F.lit("speaker").alias("node_type")).distinct()
