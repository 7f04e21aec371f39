import json
import random

import numpy as np
import pytest

from palimpsest.functions import text as t
from palimpsest.operators import cluster, dense, fusion, graph, lexical, prune, units
from palimpsest.operators.components import connected_components
from palimpsest.sources.store import read_cases
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (500, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is None:
            find(a)
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect())
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_closure_with_a_cycle(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("x", "x"), (None, "a")], "parent string, child string")
    got = rows(units.closure(c).where("ancestor = 'a'"), "space", "depth")
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_conditions_on_missing_values(spark):
    df = spark.createDataFrame([("1", None, {"n": "5"}), ("2", "ab", {"n": "x"}), ("3", "b", None)], "uid string, f string, raw map<string,string>")
    find = lambda c: [r.uid for r in units.filter_units(df, c, "raw").orderBy("uid").collect()]
    assert find({"f": {"ne": "b"}}) == ["1", "2"] and find({"f": {"nin": ["b"]}}) == ["1", "2"] and find({"f": {"not_contain": "a"}}) == ["1", "3"]
    assert find({"f": {"gt": "a"}}) == ["2", "3"] and find({"n": {"gte": 5}}) == ["1"] and find({"none": {"eq": None}}) == ["1", "2", "3"] and find({}) == ["1", "2", "3"]
    assert find({"f": {"contain": "b", "unknown": 1}, "n": {"eq": "x"}}) == ["2"]


def test_sets_and_changes(spark):
    df = lambda *u: spark.createDataFrame([(x, i) for i, x in enumerate(u)], "uid string, pos int")
    assert rows(units.union(df("a", "b"), df("b", "c")), "uid") == [("a",), ("b",), ("c",)]
    assert rows(units.difference(df("a", "a", "b"), df("b")), "uid") == [("a",), ("a",)]
    assert units.intersection(df("a"), df()).count() == 0
    e = spark.createDataFrame([("1", "a", "b", "k"), ("2", "a", "b", "k"), ("3", "a", "b", "l")], "edge_id string, src string, dst string, type string")
    assert rows(units.delete_edges(e, "a", "b", "k"), "edge_id") == [("2",), ("3",)] and units.delete_edges(e, "a", "b").count() == 0
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    new = spark.createDataFrame([("4", "a", "a", "k"), ("5", "a", "zz", "k")], e.schema)
    assert units.add_edges(e, nodes, new).count() == 4
    merged = units.merged_stores([("x", df("a").select("uid")), ("y", df("a", "y::a").select("uid"))])
    assert len({r.new_uid for r in merged.collect()}) == 3


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "uid bigint, text string")
    q = spark.createDataFrame([(1, "red red fox"), (2, None), (3, "zebra")], "query_id bigint, query string")
    got = {(r.query_id, r.uid): r.score for r in lexical.bm25(lexical.build_index(docs), q, 5).collect()}
    idf = lambda df: np.log((4 - df + 0.5) / (df + 0.5) + 1)
    avg = 5 / 4
    w = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert set(got) == {(1, 1), (1, 2)}
    assert got[1, 1] == pytest.approx(2 * idf(2) * w(1, 2) + idf(1) * w(1, 2)) and got[1, 2] == pytest.approx(2 * idf(2) * w(2, 3))
    none = spark.createDataFrame([], "uid bigint")
    assert lexical.bm25(lexical.build_index(docs), q, 5, none).count() == 0
    assert lexical.bm25(lexical.build_index(docs.limit(0)), q, 5).count() == 0


def test_dense_blocks_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    bad = [(100, [0.0] * 5), (101, None), (102, [1.0]), (103, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + bad, "uid bigint, v array<double>")
    q = df.where("uid < 9 or uid >= 100").withColumnRenamed("uid", "query_id")
    got = {}
    for r in dense.dense_search(q, df, 4, 5, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.uid)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: [int(j) for j in sorted(range(60), key=lambda j: (-round((u[i] @ u[j] + 1) / 2, 9), j))[:4]] for i in range(9)}
    assert got == want
    assert dense.dense_search(q, df.limit(0), 4, 5).count() == 0


def test_mmr_with_weight_one_is_the_order_of_cosine(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 4))
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "uid bigint, v array<double>")
    res = spark.createDataFrame([(0, "m", i, float(20 - i), i + 1) for i in range(20)] + [(0, "m", 99, 0.1, 21)], "query_id bigint, method string, uid bigint, score double, rank bigint")
    q = vec.where("uid = 0").withColumnRenamed("uid", "query_id")
    got = [r.uid for r in fusion.mmr(res, q, vec, 6, weight=1.0).orderBy("rank").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == [int(i) for i in np.argsort(-(u @ u[0]), kind="stable")[:6]]
    assert [r.uid for r in fusion.mmr(res, q.limit(0), vec, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_fusion_is_blind_to_the_order_of_methods(spark):
    data = [(1, m, u, s, r) for m, u, s, r in (("a", 1, 3.0, 1), ("a", 2, 1.0, 2), ("b", 2, 9.0, 1), ("c", 3, 1.0, 1))]
    schema = "query_id int, method string, uid int, score double, rank int"
    x, y = spark.createDataFrame(data, schema), spark.createDataFrame(data[::-1], schema)
    assert rows(fusion.rrf(x, 5), "uid", "score", "rank") == rows(fusion.rrf(y, 5), "uid", "score", "rank")
    top = fusion.rrf(x, 5).where("rank = 1").first()
    assert top.uid == 2 and top.score == pytest.approx(1 / 62 + 1 / 61)
    w = {r.uid: r.score for r in fusion.weighted(x, {"a": 1.0, "b": 1.0, "zero": 0.0}, 5).collect()}
    assert w[1] == pytest.approx(0.5) and w[2] == pytest.approx((1 / 3 + 1) / 2) and w[3] == 0


@pytest.fixture(scope="module")
def edges(spark):
    e = [("1", "a", "b", "k", 1.0), ("2", "a", "b", "k", 9.0), ("3", "b", "a", "k", 1.0), ("4", "b", "c", "l", 2.0), ("5", "c", "d", "k", 0.5), ("6", "a", "d", "l", 10.0), ("7", "d", "d", "k", 1.0)]
    return spark.createDataFrame(e, "edge_id string, src string, dst string, type string, weight double")


def test_graph(spark, edges):
    seed = spark.createDataFrame([("a",)], "uid string")
    assert rows(graph.neighbours(edges, seed), "uid") == [("b",), ("b",), ("b",), ("d",)]
    assert rows(graph.neighbours(edges, seed, direction="predecessors"), "uid") == [("b",)]
    assert rows(graph.traverse(edges, seed), "uid") == [("b",), ("d",)] and graph.traverse(edges, seed, direction="sideways").count() == 0
    assert rows(graph.relation_summary(edges, seed), "relation", "edges") == [("k", 2), ("k_incoming", 1), ("l", 1)]
    assert rows(graph.relation_samples(edges, 1), "type", "sample") == [("k", "a <-> b"), ("l", "b -> c")]
    assert rows(graph.expand_by_hops(edges, seed, 2, 1), "uid", "hop", "via") == [("b", 1, "a")]
    assert rows(graph.expand_by_hops(edges, seed, 2, 5), "uid", "hop", "via") == [("b", 1, "a"), ("c", 2, "b"), ("d", 1, "a")]
    paths = {tuple(r.path): r.weight for r in graph.simple_paths(edges, seed, None, 4).collect()}
    assert paths[("a", "b", "c", "d")] == pytest.approx(3.5 / 3) and set(paths) == {("a", "b"), ("a", "d"), ("a", "b", "c"), ("a", "b", "c", "d")}
    best = graph.shortest_paths(edges, spark.createDataFrame([("a", "d"), ("d", "a")], "source string, target string"), 5, "weight").collect()
    assert [(r.source, r.hops, r.distance, r.score) for r in best] == [("a", 3, 3.5, 0.25)]
    stats = graph.subgraph_statistics(edges, spark.createDataFrame([("a",), ("b",), ("b",)], "uid string")).first()
    assert (stats.nodes, stats.edges, stats.density) == (2, 3, 1.5)


def test_dbscan_by_hand(spark):
    angles = [0, 5, 10, 15, 90, 94, 98, 200]
    v = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in enumerate(angles)] + [(50, [0.0, 0.0])]
    df = spark.createDataFrame(v, "uid bigint, v array<double>")
    got = {r.uid: (r.cluster, r.core) for r in cluster.dbscan(df, 2, 1 - float(np.cos(np.radians(5.5))), 3, scale=False).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (0, True), 3: (0, False), 4: (1, False), 5: (1, True), 6: (1, False), 7: (-1, False), 50: (-1, False)}


CHUNK = "query_id int, chunk_id string, pos int, score double, tower string, tokens int, ts double, entity_ids array<string>, source_ids array<string>"


def test_pruning(spark):
    c = spark.createDataFrame([
        (1, "a", 1, 1.0, "hierarchical", 50, 4e6, ["x"], ["s"]), (1, "b", 2, 0.9, "kg", 60, 4e6, ["x"], None), (1, "c", 3, 0.4, "episodic", 50, 1e5, ["x", "y"], ["t"]), (1, "d", 4, 0.35, "episodic", 40, 0.0, ["y"], []), (1, "e", 5, -9.0, "kg", 10, 0.0, None, None), (2, "z", 1, 0.0, "kg", 10, 0.0, None, None),
    ], CHUNK)
    kept = prune.mad_filter(c)
    assert rows(kept, "chunk_id") == [("a",), ("b",), ("c",), ("d",), ("z",)]
    judged = {r.chunk_id: (r.dropped, r.reason, r.keeper) for r in prune.disambiguate(prune.arbitration(kept, F.lit(0.0), 4e6)).collect()}
    assert judged["a"] == (False, None, None) and judged["b"] == (True, "REDUNDANT", "a") and judged["c"] == (True, "STALE", "a") and judged["d"] == (False, None, None)
    once = prune.disambiguate(prune.arbitration(kept, F.lit(0.0), 4e6), 1).where("dropped")
    assert once.count() == 1
    assert rows(prune.pack_by_score(c, 120), "query_id", "chunk_id") == [(1, "a"), (1, "b"), (2, "z")]
    total = {r.query_id: r.n for r in prune.pack_mmr(c, 120).join(c, ["query_id", "chunk_id"]).groupBy("query_id").agg((F.sum("tokens") + 2 * (F.count("*") - 1)).alias("n")).collect()}
    assert all(n <= 120 for n in total.values())
    strict = prune.pack_mmr(c, 500, mode="STRICT", absolute_min=0.5)
    assert rows(strict.where("query_id = 1"), "chunk_id") == [("a",), ("b",)]
    lines = spark.createDataFrame([(1, "aaaa\nbbbb\ncc"), (2, ""), (3, None), (4, "ok")], "uid int, text string")
    assert rows(prune.truncated(lines, 4, lambda x: F.length(x)), "uid", "text") == [(1, "cc"), (2, ""), (4, "ok")]


def test_text(spark):
    df = spark.createDataFrame([("The  red FOX_1 9 x é ok", "red the zz"), (None, None), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(t.tokens(F.col("a"))).collect()] == [["red", "fox_1", "9"], [], []]
    assert [r[0] for r in df.select(t.relevance(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]
    assert [r[0] for r in df.select(t.token_estimate(F.col("a"))).collect()] == [8, 0, 0]
    raw = spark.createDataFrame([("u", {"title": "T", "content": ""}), ("u", {"b": "2", "a": "1", "embedding": "z"}), ("u", {}), ("u", {"content": "  "}), ("u", None)], "uid string, raw map<string,string>")
    assert [r[0] for r in raw.select(t.text_view(F.col("raw"), F.col("uid"))).collect()] == ["T", "a: 1; b: 2", "Unit u", "Memory unit u", "Unit u"]
    ans = spark.createDataFrame([("The cat, and a dog!", "dog cat"), ("a", "b c"), (None, "x")], "g string, a string").select(t.normalized_answer(F.col("g")).alias("g"), t.normalized_answer(F.col("a")).alias("a"))
    assert [tuple(r) for r in ans.select(t.exact_match(F.col("g"), F.col("a")), t.token_f1(F.col("g"), F.col("a"))).collect()] == [(True, 1.0), (False, 0.0), (False, 0.0)]


def test_nested_cases(spark, tmp_path):
    data = [{"sample_id": "s", "conversation": {"session_2": [{"speaker": "B", "text": "yo", "dia_id": "D2:1"}], "session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1", "blip_caption": "a cat"}], "session_1_date_time": "x"}, "qa": [{"question": "q1", "answer": "a", "category": 2, "evidence": ["D1:1"]}, {"question": "q2", "adversarial_answer": "b", "category": 1}, {"question": "q3", "answer": 7, "category": 1}]}]
    (tmp_path / "x.json").write_text(json.dumps(data))
    questions, messages = read_cases(spark, str(tmp_path / "x.json"), 2)
    assert rows(questions, "question", "answer", "category") == [("q1", "a", 2), ("q2", "b", 5)]
    assert rows(messages, "session_no", "text") == [(1, "hi | a cat"), (2, "yo")]
