from collections import defaultdict

from palimpsest.llm.packing import ASSIGNMENT, container_report, pack

WORDS = "one two three four five six seven eight nine ten "


def documents(spark, n=400):
    rows = [(i, WORDS * (1 + i * 7 % 9) if i % 11 else None if i % 2 else "", "hot" if i % 3 else f"s{i % 5}", "x") for i in range(n)]
    rows += [(n, WORDS * 60, None, "x"), (n + 1, "one", "rare", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string")


def profiles(spark):
    return spark.createDataFrame([("p", "byte_bpe_50k", 100), ("p", "byte_bpe_50k", 100), ("bad", None, 10), ("zero", "byte_bpe_50k", 0), (None, "byte_bpe_50k", 5)], "profile string, tokenizer string, capacity_tokens int")


def check(rows, n_docs, capacity):
    used, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.container_id] += r.n_tokens
        pieces[r.doc_id].append(r)
    assert max(used.values()) <= capacity and len(pieces) == n_docs
    for ps in pieces.values():
        ps.sort(key=lambda r: r.piece_no)
        total = sum(p.n_tokens for p in ps)
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and (len(ps) == 1 or total > capacity)
        assert [p.token_start for p in ps] == [capacity * i for i in range(len(ps))] and all(p.n_tokens == capacity for p in ps[:-1])
    return used


def test_every_document_once(spark):
    rows = pack(documents(spark), profiles(spark)).collect()
    used = check(rows, 402, 100)
    assert sum(used.values()) / len(used) > 90  # most items fill nine tenths of a container, and nothing is small enough for the rest


def test_lanes_and_mixture(spark):
    a = pack(documents(spark), profiles(spark), lane_containers=20).cache()
    rows = a.collect()
    check(rows, 402, 100)
    assert len({r.lane for r in rows}) > 3
    # Windows of a lane hold about the source's share.
    report = container_report(a).first()
    assert report.fullest <= 100 and report.containers >= report.least_containers


def test_target_weights(spark):
    weights = spark.createDataFrame([("hot", 0.0), ("s0", 1.0)], "source string, weight double")
    check(pack(documents(spark), profiles(spark), weights=weights).collect(), 402, 100)


def test_empty(spark):
    assert pack(documents(spark).limit(0), profiles(spark)).count() == 0
    none = pack(documents(spark), profiles(spark).limit(0))
    assert none.count() == 0 and len(none.columns) == len(ASSIGNMENT.split(","))
