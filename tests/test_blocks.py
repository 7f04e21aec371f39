"""Blocks of a lexical index against its rows, and what a search of them shuffles."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators import blocks, dense, lexical

TEXTS = [
    "The Fox_1 ran; a 7 b 12 é Éva", None, "", "?!", "Größe ÜBER straße ﬁn", "我觉得考试大概要4元。好", "Привет, МИР 5½ x² ª", "ΣΊΣΥΦΟΣ ὀδός Σ", "İstanbul ıI", "été ①② Ⅷ", "カタカナ・テスト 한국어 「引用」", "a b cc\U0001f600dd 😀 \U00020000\U00020001", "1 2 3 1 _ __", "ends", "begins the",
]


@pytest.mark.parametrize("block", (3, 65_536))
def test_blocks_have_the_terms_of_the_texts(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, "fox again"), (None, "nobody's")], "uid bigint, text string")
    words: dict[int, list[str]] = {}
    for r in docs.where("uid is not null").select("uid", tokens(F.col("text")).alias("terms")).collect():
        words.setdefault(r.uid, []).extend(r.terms)
    made = list(blocks._blocked(iter(blocks.cut(lexical.build_index(docs).texts).toArrow().to_batches())))
    got = Counter(x for b in blocks._unrolled(iter(made)) for x in zip(*(b.column(c).to_pylist() for c in ("uid", "term", "tf", "len"))))
    assert got == Counter((u, w, n, len(ws)) for u, ws in words.items() for w, n in Counter(ws).items())
    assert sorted(u for b in made for u in b.column("uids")[0].as_py()[b.column("again")[0].as_py() :]) == sorted(words)
    assert any(b.column("again")[0].as_py() for b in made) == (block == 3)


def test_a_stored_index_is_few_rows(spark):
    """Postings of a stored index of texts are no rows of Spark, and it is the index of its texts all the same."""
    docs = spark.createDataFrame([*enumerate(TEXTS * 20)], "uid bigint, text string")
    index = lexical.build_index(docs)
    stored = index.stored()
    assert stored.blocks.count() <= 8 < stored.postings.count()
    for name, columns in (("postings", ("term", "uid", "tf", "len")), ("documents", ("uid", "len")), ("frequencies", ("term", "df")), ("totals", ("n", "avgdl"))):
        assert sorted(map(tuple, getattr(stored, name).select(*columns).collect())) == sorted(map(tuple, getattr(index, name).select(*columns).collect()))


def test_texts_of_a_uid_are_one_unit_over_batches(spark):
    rows = [(u, f"w{u} common {t}") for u in range(6) for t in "ab cd ef".split()]
    texts = spark.createDataFrame(rows, "uid bigint, text string").withColumn("plain", F.col("text")).withColumn("place", F.lit(1)).select("uid", "place", "plain").toArrow().combine_chunks()
    for size in (1, 2, 4, 5, 18):
        made = list(blocks._blocked(iter(texts.to_batches(max_chunksize=size))))
        assert [u for b in made for u in b.column("uids")[0].as_py()] == list(range(6))
        got = Counter(x for b in blocks._unrolled(iter(made)) for x in zip(*(b.column(c).to_pylist() for c in ("uid", "term", "tf", "len"))))
        assert got == Counter({(u, w, n, 9): 1 for u in range(6) for w, n in ((f"w{u}", 3), ("common", 3), ("ab", 1), ("cd", 1), ("ef", 1))})


def test_terms_of_every_character_are_those_of_spark(spark):
    """Texts of any script are cut into terms by one pass in Python, none by Spark's expressions."""
    chars = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x30000))))
    docs = spark.createDataFrame([(i, " ".join(f"x{c}y" for c in chars[i * 500 : i * 500 + 500])) for i in range(-(-len(chars) // 500))], "uid bigint, text string")
    want = {r.uid: Counter(r.terms) for r in docs.select("uid", tokens(F.col("text")).alias("terms")).collect() if r.terms}
    got: dict[int, Counter] = {}
    for r in lexical.build_index(docs).stored().postings.collect():
        got.setdefault(r.uid, Counter())[r.term] = r.tf
    assert got == want


def test_several_methods_by_one_meeting(spark):
    """One search gives what each method gives alone by rows, also of queries that several blocks hold."""
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 23}" for j in range(1, 9)) + " Ω ｄｉｈ") for i in range(60)] + [(3, "t1 t1 again")], "uid bigint, text string")
    queries = docs.where("uid % 5 = 0").selectExpr("uid as query_id", "text as query").unionByName(spark.createDataFrame([(5, "t7 unknown"), (1000, None), (1001, "nothing")], "query_id bigint, query string"))
    index = lexical.build_index(docs)
    bm25, sparse = lexical.search(index.stored(), queries, [("bm25", 7), ("sparse", 4)])
    shown = lambda df: sorted((r.query_id, r["rank"], r.uid, round(r.score, 9)) for r in df.collect())
    assert shown(bm25) == shown(lexical.bm25(index, queries, 7))
    weights = lambda df, c: df.groupBy(c, "term").agg((1 + F.log(F.count("*"))).alias("weight"))
    asked, units = (df.select(c, F.explode(tokens(F.col(t))).alias("term")) for df, c, t in ((queries, "query_id", "query"), (docs, "uid", "text")))
    assert shown(sparse) == shown(dense.sparse_search(weights(asked, "query_id"), weights(units, "uid"), 4))
