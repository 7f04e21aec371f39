import random

import pytest

from palimpsest.llm.near_duplicates import Duplicates, alike


def jaccard_pairs(sets, s):
    out = set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and both >= s * every - 1e-9:
                out.add((a, b))
    return out


def random_sets(rng, n, words, size):
    sets = {}
    for i in range(n):
        if i and rng.random() < 0.5:
            base = set(sets[rng.randrange(i)])
            for _ in range(rng.randint(1, max(1, len(base) // 3))):
                base.discard(rng.choice(sorted(base))) if base and rng.random() < 0.5 else base.add(rng.randrange(words))
        else:
            base = {min(rng.randrange(words), rng.randrange(words)) for _ in range(rng.randint(1, size))}
        sets[i] = frozenset(base)
    return {i: s for s, i in {s: i for i, s in sets.items()}.items()}


@pytest.mark.parametrize(("similarity", "words", "size", "seed"), [(0.6, 40, 12, 1), (0.6, 300, 40, 2), (0.8, 300, 60, 3), (0.6, 2000, 250, 4), (0.5, 30, 20, 5)])
def test_exact_against_all_pairs(spark, similarity, words, size, seed):
    rng = random.Random(seed)
    sets = random_sets(rng, 260, words, size)
    mix = {w: rng.getrandbits(63) - 2**62 for w in range(words)}
    df = spark.createDataFrame([(i, sorted(mix[w] for w in s)) for i, s in sets.items() if s], "id bigint, words array<bigint>")
    assert {(r.a, r.b) for r in alike(df, similarity).collect()} == jaccard_pairs({i: s for i, s in sets.items() if s}, similarity)


def test_crowded_blocks_are_divided(spark):
    rng = random.Random(9)
    common = list(range(8))
    sets = {i: frozenset([*common, *rng.sample(range(8, 60), 6)]) for i in range(0, 640)}
    sets = {i: s for s, i in {s: i for i, s in sets.items()}.items()}
    mix = {w: rng.getrandbits(63) for w in range(60)}
    df = spark.createDataFrame([(i, sorted(mix[w] for w in s)) for i, s in sets.items()], "id bigint, words array<bigint>")
    want = jaccard_pairs(sets, 0.6)
    for depth in (2, 0):  # divided, and split into parts that are compared two by two
        assert {(r.a, r.b) for r in alike(df, 0.6, hot=40, depth=depth).collect()} == want


SCHEMA = "fact_id string, content string, retrieval_keys array<string>, words string, id int"


def test_copies_nulls_and_blanks(spark):
    rows = [
        ("a", "The red fox jumps", ["fence"], "clash", 1), ("b", "the RED fox: jumps!", ["fence", None], None, 1), ("c", "the red fox jumps over", ["fence"], None, 2), ("d", None, None, None, None), ("e", "  ", [], None, 3),
        ("a", "The red fox jumps", ["fence"], "clash", 1), ("f", "nothing alike here", None, None, None), (None, "the red fox jumps", ["fence"], None, None),
    ]
    d = Duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in d.pairs().collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.fact_id: (r.class_id, r.n_links, r.group_id) for r in d.groups().collect()}
    assert groups["a"] == ("a", 2, "a") and groups["b"] == ("a", 2, "a") and groups["c"] == ("c", 2, "a")
    assert groups["d"] == ("d", 0, "d") and groups["f"] == ("f", 0, "f") and set(groups) == set("abcdef")


def test_very_long_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [("x", long, None, None, None), ("y", long + " extra", None, None, None), ("z", "w1 w2", None, None, None)]
    assert [tuple(r) for r in Duplicates(spark.createDataFrame(rows, SCHEMA)).pairs().collect()] == [("x", "y")]
    assert Duplicates(spark.createDataFrame([], SCHEMA)).pairs().count() == 0
