"""What queries and operators once left out: long texts, unknown times, whole sentences, far nodes, short names, whole grids."""

import numpy as np
import pytest

from palimpsest.operators import cluster
from palimpsest.queries import context, records, stages, stores


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def unit(uid, text, index=0, ts=1_700_000_000, role="user", session="s"):
    return {"uid": uid, "sample_id": "a", "session_id": session, "role": role, "message_index": index, "timestamp": ts, "text_content": text, "ingested_at": index}


UNIT = "uid string, sample_id string, session_id string, role string, message_index int, timestamp bigint, text_content string, ingested_at int"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables of rows to a folder of their own."""

    def write(**named):
        for name, (data, schema) in named.items():
            spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_long_answers_are_scored(spark, tables):
    long = " ".join(f"w{i}" for i in range(80))
    folder = tables(memory_units=([unit("1", long), unit("2", long + " w0 w0", 1), unit("3", "w0 w0 x", 2), unit("4", "", 3), unit("5", "the", 4)], UNIT))
    p, r = 80 / 82, 1.0
    assert rows(records.answer_em_f1(spark, folder), "uid", "em", "f1") == [("2", True, round(2 * p * r / (p + r), 6)), ("3", False, round(2 * (2 / 3) * (2 / 82) / (2 / 3 + 2 / 82), 6)), ("4", False, 0.0), ("5", True, 0.0)]


def test_questions_are_whole_sentences(spark, tables):
    texts = {
        "1": "Noted. Könntest du 3.5 kg Mehl prüfen? There was a second-hand puzzle in Ulm, wasn't there? Yes.",
        "2": "太好了！你能在星期五之前检查一下风筝吗？没有人知道。",
        "3": "هل وصلت الرسالة؟ نعم.",
        "4": 'See https://a.invalid/b?id=5 now. "How many of the 12 came?" Really?! ???',
        "5": "plant: Did you hear\r\nvine: When did Dr. J. Zoë move?\r\n",
        "6": None,
    }
    folder = tables(memory_units=([unit(k, v) for k, v in texts.items()], UNIT))
    expected = [
        ("1", 0, "Könntest du 3.5 kg Mehl prüfen?"), ("1", 1, "There was a second-hand puzzle in Ulm, wasn't there?"), ("2", 0, "你能在星期五之前检查一下风筝吗？"), ("3", 0, "هل وصلت الرسالة؟"),
        ("4", 0, 'How many of the 12 came?"'), ("4", 1, "Really?!"), ("5", 0, "vine: When did Dr. J. Zoë move?"),
    ]
    assert rows(context.questions(spark, folder), "uid", "no", "question") == expected
    assert context.route_locomo(spark, folder).count() == context.route_longmemeval(spark, folder).count() == 7


def test_messages_of_unknown_time_keep_their_place(spark, tables):
    messages = [unit("1", "red fox"), unit("2", "blue fox", 1, ts=0), unit("3", "blue fox", 2, ts=None, role="assistant"), unit("4", "owl", 3)]
    facts = [{"fact_id": "f", "participants": [], "source_unit_uids": ["1", "2"]}]
    schema = "fact_id string, sample_id string, content string, fact_type string, participants array<string>, retrieval_keys array<string>, source_unit_uids array<string>, confidence double, time_info struct<absolute_date: string>"
    folder = tables(memory_units=(messages, UNIT), episodic_facts=(facts, schema))
    assert rows(records.message_pairs(spark, folder), "src", "dst", "distance") == [("1", "2", 1), ("2", "3", 1), ("3", "4", 1)]
    assert rows(records.answer_em_f1(spark, folder), "uid", "em", "f1") == [("2", False, 0.5), ("3", True, 1.0), ("4", False, 0.0)]
    assert rows(records.evidence_recall(spark, folder), "query_id", "recall") == [("f", 1.0)]
    assert rows(stages.session_status(spark, folder), "session_id", "units") == [("s", 2)]


def entity(i, related, confidence, name="x"):
    return {"entity_id": f"ent_{i}", "sample_id": "a", "name": name, "entity_type": "Person", "confidence": confidence, "aliases": [], "related_entities": [f"ent_{r}" for r in related]}


ENTITY = "entity_id string, sample_id string, name string, entity_type string, confidence double, aliases array<string>, related_entities array<string>"


def test_far_nodes_and_cheap_detours(spark, tables):
    # A chain 20 -> 1 -> ... -> 7 of cheap edges, a dear edge 20 -> 5, and 7 -> 1 back.
    chain = [entity(20, [1, 9], 0.1), *[entity(i, [i + 1], 0.1) for i in range(1, 7)], entity(7, [1], 0.1), entity(9, [5], 0.9)]
    folder = tables(extracted_entities=(chain, ENTITY))
    got = {r.target: (r.hops, r.distance) for r in stores.shortest_path(spark, folder).collect() if r.source == "ent_20"}
    assert got == {f"ent_{i}": (i, round(0.1 * i, 6)) for i in range(1, 8)} | {"ent_9": (1, 0.9)}
    paths = {r.path for r in stores.simple_paths(spark, folder).collect()}
    assert "ent_20>ent_1>ent_2>ent_3>ent_4" in paths and not any(p.count(">") > 4 for p in paths)
    assert "ent_20>ent_1>ent_2>ent_3>ent_4" in {r.path for r in stages.scored_paths(spark, folder).collect()}


def test_reranking_reads_every_line_of_a_query(spark, tables):
    docs = [(0, "\nfox owl"), (20, "fox\nowl hen"), (21, "owl hen"), (22, "fox cat"), *[(i, f"pine{i} elm{i}") for i in range(41, 59)]]
    folder = tables(documents=([(*d, "en", "x", "chat") for d in docs], "doc_id bigint, text string, lang string, source string, memory_space string"))
    got = {(r.query_id, r.uid): r.score for r in stages.rerank_lexical(spark, folder).collect()}
    assert got[(0, 20)] == 1.0 and got[(0, 21)] == 0.5 and got[(20, 21)] == round(2 / 3, 6) and got[(20, 22)] == round(1 / 3, 6)


def test_edges_and_nodes_are_searched_for_every_twentieth_name(spark, tables):
    people = [entity(20, [1], 0.5, "Ann Fox"), entity(1, [40], 0.5, "Bo Fox"), entity(40, [20], 0.5, "Cy Hen"), entity(2, [1], 0.5, "Di Elk")]
    folder = tables(extracted_entities=(people, ENTITY))
    assert {r.query_id for r in stores.edge_search(spark, folder).collect()} == {"ent_20", "ent_40"}
    assert {r.query_id for r in stages.node_search(spark, folder).collect()} == {"ent_20", "ent_40"}
    assert ("ent_20", 1) in rows(stores.edge_search(spark, folder).where("query_id = 'ent_20'"), "uid", "rank")


def test_short_names_are_resolved(spark, tables):
    people = [entity(1, [], 0.5, "Bo"), entity(2, [], 0.5, "Robert Lang"), entity(3, [], 0.5, "IBM Ltd")]
    folder = tables(extracted_entities=(people, ENTITY), entity_mentions=([(["Bo", "IBM", "Lang", " ", "zz"],)], "aliases array<string>"))
    assert rows(records.resolve_names(spark, folder), "reference", "entity_id") == [("Bo", "ent_1"), ("IBM", "ent_3"), ("Lang", "ent_2")]


def test_tuning_tries_the_whole_grid(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.4, (25, 3)) for c in ((4, 0, 0), (0, 4, 0), (0, 0, 4))] + [rng.normal(0, 3, (10, 3))])
    vectors = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "uid bigint, v array<double>")
    got = {(r.eps, r.min_samples): r for r in cluster.tuned(vectors, 3).collect()}
    assert len(got) == 45 and {m for _, m in got} == set(range(2, 11)) and min(got)[0] == 0.1 and max(got)[0] == 0.8
    std = (points - points.mean(0)) / points.std(0)
    for key in ((0.1, 5), (0.275, 10)):
        found = cluster.dbscan(vectors, 3, *key)
        of = {r.uid: r.cluster for r in found.collect()}
        ids = [i for i in of if of[i] >= 0]
        groups = [std[[i for i in ids if of[i] == c]] for c in sorted({of[i] for i in ids})]
        n, k, mean = len(ids), len(groups), std[ids].mean(0)
        assert k > 1
        b, w = sum(len(g) * ((g.mean(0) - mean) ** 2).sum() for g in groups), sum(((g - g.mean(0)) ** 2).sum() for g in groups)
        s = sum(r.n * r.silhouette for r in cluster.silhouettes(vectors, found, 3).collect()) / n
        assert (got[key].clusters, got[key].noise_share) == (k, pytest.approx(1 - n / len(points)))
        assert got[key].score == pytest.approx(0.5 * s + 0.3 * min(b / (k - 1) / (w / (n - k)) / 1000, 1) + 0.2 * n / len(points))
    assert all(r.score == 0 for r in got.values() if r.clusters < 2)
