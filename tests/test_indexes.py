"""Stored indexes, leaders, edges by relevant texts, pairs over stretches, hooks and reports."""

import random

import numpy as np
import pytest

from palimpsest.operators import dense, dialogue, graph, lexical, merging
from palimpsest.plans import rerank
from palimpsest.session import shared_path
from palimpsest.sources import reports

DOCS = "uid bigint, text string, term string"


def found(index, queries):
    return {(r.query_id, r.uid): round(r.score, 9) for r in lexical.bm25(index, queries, 50).collect()}


def test_changed_index_is_that_of_what_is_left(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("fox owl hen elk cat pine elm oak ash yew".split()) for _ in range(rng.randint(0, 12)))
    old = {i: text() for i in range(60)} | {60: None, 61: ""}
    new = {i: text() for i in range(50, 80)}
    gone = [0, 7, 55, 61, 999]
    table = lambda docs: spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], DOCS)
    queries = spark.createDataFrame([("a", "fox owl owl"), ("b", "yew"), ("c", None), ("d", "nothing")], "query_id string, query string")
    folder = shared_path(spark, "an-index")
    lexical.build_index(table(old)).stored().save(folder)
    changed = lexical.remove_documents(lexical.add_documents(lexical.load_index(spark, folder), table(new)), spark.createDataFrame([(i,) for i in gone] * 2, "uid bigint"))
    whole = lexical.build_index(table({i: t for i, t in (old | new).items() if i not in gone}))
    assert found(changed, queries) == found(whole, queries) != {}
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(changed.frequencies) == rows(whole.frequencies) and rows(changed.totals) == rows(whole.totals)
    assert found(lexical.build_index(table(old).limit(0)).stored(), queries) == {}


def test_leaders_against_a_loop(spark):
    rng = np.random.default_rng(4)
    points = [(i, [float(x) for x in rng.normal(size=3)], "ab"[i % 2]) for i in range(80)]
    points += [(80, [0.0, 0.0, 0.0], "a"), (81, None, "b"), (82, points[0][1], "a")]
    want = {}
    heads = {"a": [], "b": []}
    for i, v, g in points:
        unit = None if v is None or not any(v) else np.array(v) / np.linalg.norm(v)
        hit = next((j for j, u in heads[g] if unit is not None and u @ unit >= 0.8), None)
        want[i] = i if hit is None else hit
        if hit is None and unit is not None:
            heads[g].append((i, unit))
    df = spark.createDataFrame(points, "uid bigint, v array<double>, kind string")
    assert {r.uid: r.leader for r in merging.leaders(df, 3, 0.8).collect()} == want
    assert merging.leaders(df.limit(0), 3, 0.8).count() == 0


def test_near_pairs_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(50, 4))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "uid bigint, v array<double>")
    want = {(i, j) for i in range(50) for j in range(50) if i != j and u[i] @ u[j] >= 0.5}
    got = [(r.uid, r.other) for r in dense.near_pairs(df, 4, 0.5, block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_relevant_texts_against_every_pair(spark):
    texts = ["Bo Fox", "a", "", None, "Éva  Foxglove", "ox"]
    queries = {"p": "fox", "q": "Ox ox a", "r": " ", "s": None, "t": "évA zz"}
    got = {(r.query_id, r.text): r.relevance for r in graph.relevant_texts(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(queries.items()), "query_id string, query string")).collect()}
    want = {}
    for i, q in queries.items():
        words = (q or "").lower().split()
        for t in texts:
            if t and words and (share := sum(w in t.lower() for w in words) / len(words)):
                want[i, t] = share
    assert got == want


def test_pairs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "STRETCH", 3)
    rows = [(f"m{i:02d}", "s", i) for i in range(0, 20) if i % 7] + [("x", None, 1), ("y", "s", None), ("z", "t", 4)]
    ordered = [u for u, s, i in rows if s == "s" and i is not None]
    df = spark.createDataFrame(rows, "uid string, session_id string, message_index int")
    assert sorted((r.src, r.dst) for r in dialogue.message_pairs(df).collect()) == list(zip(ordered, ordered[1:]))


def test_hooks_for_scorers_and_encoders(spark):
    results = spark.createDataFrame([("q", 1, 0.9, 1), ("q", 2, 0.8, 2)], "query_id string, uid bigint, score double, rank bigint")
    queries, units = spark.createDataFrame([("q", "abc")], "query_id string, query string"), spark.createDataFrame([(1, "x"), (2, "xyz")], "uid bigint, text string")
    out = rerank.rerank(results, queries, units, 5, rerank.model_score(lambda q, t: (q.str.len() == t.str.len()).astype(float)))
    assert [(r.uid, r.score) for r in out.orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert [r.v for r in rerank.embedded(units, lambda t: t.map(lambda x: [float(len(x))])).orderBy("uid").collect()] == [[1.0], [3.0]]


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("b|c", 2), ("a", None)], "name string, n int")
    assert reports.markdown(report) == "| name | n |\n| --- | --- |\n| a |  |\n| b\\|c | 2 |\n"
    with pytest.raises(ValueError, match="more than 1 rows"):
        reports.markdown(report, 1)
    path = str(tmp_path / "r")
    reports.write_json(report, path)
    reports.write_json(report.limit(1), path, append=True)
    assert spark.read.json(path).count() == 3
