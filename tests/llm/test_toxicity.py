import numpy as np
import pytest

from palimpsest.llm.toxicity import ORDER, _codes, _keys, best_threshold, fit, normal, passages, rates, score_documents, train

CALM = ["please remember that my {} must be sold", "i don't think the {} fits next to the lamp", "we're meeting at the {} at noon", "the {} needs five minutes"]
RUDE = ["you are a useless {}, you idiot", "shut up, you stupid {}", "i hate you, pathetic {}"]
THINGS = "kettle vase ladder piano carpet basket mirror teapot camera window wallet blanket bucket hammer".split()


def test_disguises_are_undone():
    assert normal("You P.A.T.H.E.T.I.C  cl0wn") == "you pathetic clown"
    assert normal("i d i o t!") == "idiot!"
    assert normal("veermin") == normal("vermin") and normal("nаked") == "naked" and normal("id​iot") == "idiot"
    assert normal("at 10:30, 3 crowns") == "at 0, 0 crowns"
    assert passages(None) == passages("  ") == ([], []) and len(passages("One. Two!\nThree")[0]) == 3


def test_every_character_is_in_a_passage():
    assert passages("我觉得 you are a worthless piece of trash 真的是这样") == (["我觉得 x 真的是这样"], ["you are a worthles piece of trash"])
    assert passages("[2024-05-01 10:00] you useless idiot: hello there") == (["helo there"], ["[0 0] you useles idiot:"])
    assert passages('{"turn": 3, "user": "you idiot"}')[1][0].startswith('{"turn": 0')


def test_abuse_in_frames_and_among_ideographs_is_scored():
    calm = [([c.format(t) for c in CALM], ["[0 0] an:"]) for t in THINGS]
    rude = [([CALM[i % 4].format(t), RUDE[i % 3].format(t)], []) for i, t in enumerate(THINGS)]
    scorer = train(rude, calm)
    for text in ("我觉得 you are a useless vase, you idiot 真的是这样", "[2024-05-01 10:00] shut up, you stupid idiot: at the vase", "today. shut up, you stupid lamp"):
        assert scorer.documents([text])[0] > 0.3 > scorer.documents(["[2024-05-01 10:00] Ann: the vase needs five minutes"])[0]


def test_threshold_of_the_fewest_mistakes():
    rng = np.random.default_rng(1)
    toxic = rng.random(4000) < 0.3
    scores = np.where(toxic, rng.normal(1.0, 0.15, 4000), rng.normal(0.0, 0.15, 4000))
    toxic ^= rng.random(4000) < 0.05  # wrong labels
    assert 0.35 < best_threshold(scores, toxic) < 0.65
    assert best_threshold(scores, toxic, 50.0) > best_threshold(scores, toxic, 1.0)
    assert best_threshold(np.array([0.3]), np.array([True])) == 0.3


def test_probabilities_sum_to_one():
    models = fit([["abab abba", "baab"], ["ccab", "bacc"]])
    signs = [*range(32, 127)]
    for m in models:
        for context in ("ab", "zz", "abab a"):
            total = 0.0
            for c in signs:
                codes, _, _ = _codes([context + chr(c)])
                total += float(np.exp(m.score(list(_keys(codes)), np.array([len(codes) - 1])))[0])
            assert total < 1.0001 and ORDER > 3
    assert models[0].floor == models[1].floor


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for i in range(240):
        thing, other = THINGS[i % len(THINGS)], THINGS[(i * 5 + 3) % len(THINGS)]
        calm = ". ".join(CALM[(i + j) % 4].format(thing if j else other) for j in range(3))
        rude = i % 6 == 0
        rows.append((i, calm + (". " + RUDE[i % 3 if i % 12 else (i // 12) % 3].format(thing) if rude else ""), f"s{i % 4}", "clash"))
        if i < 180:
            labels += [(i, "x", "abuse" if rude else "none"), (i, "y", None)]
    rows += [(900, None, "s0", None), (901, "", None, None), (902, "YOU ARE A USELESS K.E.T.T.L.E, YOU 1DIOT", "s0", None), (903, "the vase needs five minutes. " * 3000, "s0", None)]
    labels += [(1, "z", "abuse"), (None, "x", "abuse")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, label string")


def test_held_out_documents(tables):
    found = {r.doc_id: r for r in score_documents(*tables).collect()}
    assert len(found) == 244
    wrong = [i for i in range(180, 240) if found[i].flagged != (i % 6 == 0)]
    assert not wrong and found[902].flagged and not found[903].flagged
    assert found[900].score == found[901].score == -10 and not found[900].flagged
    by = {r.source: r for r in rates(score_documents(*tables)).collect()}
    assert by[None].documents == 1 and sum(r.documents for r in by.values()) == 244


def test_without_labels(tables):
    docs, labels = tables
    rows = score_documents(docs, labels.limit(0)).collect()
    assert len(rows) == 244 and all(r.score is None and not r.flagged for r in rows)
    assert score_documents(docs.limit(0), labels).count() == 0
