"""Sparse products in blocks against sums over all pairs, and how little of them Spark sees."""

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.operators import dense, lexical, products
from palimpsest.session import written


def arranged(rng, n_units, n_queries, n_terms, names=False):
    """Units and queries as arrow tables with their matrices; terms from rare to common, weights of few values so that scores tie."""
    share = np.linspace(0.01, 0.6, n_terms)
    u = (rng.random((n_units, n_terms)) < share) * rng.integers(1, 4, (n_units, n_terms)).astype(float)
    q = (rng.random((n_queries, n_terms)) < share) * rng.integers(1, 3, (n_queries, n_terms)).astype(float)
    ids = np.array([f"u{i * 7 % n_units}" for i in range(n_units)]) if names else rng.permutation(n_units) + 1000
    r, c = np.nonzero(u)
    order = rng.permutation(len(r))
    r, c = r[order], c[order]
    units = pa.table({"uid": pa.array(ids[r]), "tid": c.astype(np.int64) * 10**10, "uw": u[r, c]})
    some = [np.flatnonzero(x) for x in q]
    queries = pa.table({"query_id": np.arange(n_queries), "tids": [(s * 10**10).tolist() for s in some], "qws": [x[s].tolist() for x, s in zip(q, some)]})
    return units, queries, u, q, ids


@pytest.mark.parametrize("names", (False, True))
@pytest.mark.parametrize("k", (1, 10, 300))
@pytest.mark.parametrize("block", (50, 130, 10_000))
def test_best_are_those_of_all_pairs(monkeypatch, names, k, block):
    monkeypatch.setattr(products, "UNITS", block)
    monkeypatch.setattr(products, "QUERIES", 7)
    monkeypatch.setattr(products, "DENSE_TERMS", 20)
    units, queries, u, q, ids = arranged(np.random.default_rng(3), 900, 30, 60, names)
    found: dict[int, list] = {}
    for x in products._best(k, 0.0, units, queries).to_pylist():
        found.setdefault(x["query_id"], []).append((-round(x["score"], 9), x["uid"]))
    all_pairs = q @ u.T
    for i, row in enumerate(all_pairs):
        expected = sorted((-round(s, 9), x) for s, x in zip(row.tolist(), ids.tolist()) if s > 0)[:k]
        assert sorted(found.get(i, []))[:k] == expected
        assert len(found.get(i, [])) <= 2 * k  # many ties aren't all handed on


def test_nothing_in_common():
    units, queries, *_ = arranged(np.random.default_rng(1), 40, 4, 10)
    other = queries.set_column(1, "tids", pa.array([[5], [6], [7], [8]])).set_column(2, "qws", pa.array([[1.0]] * 4))
    assert products._best(3, 0.0, units, other).num_rows == 0
    assert products._best(3, 0.0, units.slice(0, 0), queries).num_rows == 0


def test_keys_fill_every_partition_once(spark):
    keys = products._keys(spark, 13)
    rows = spark.createDataFrame([(i,) for i in keys], "g int").repartition(13, "g")
    assert sorted(len(p) for p in rows.rdd.glom().collect()) == [1] * 13


def test_pairs_are_no_rows_of_spark(spark):
    """A common word makes every query meet every unit; what is returned is read from a table of k rows a query."""
    docs = spark.range(400).selectExpr("id as uid", "concat('common word', id % 7) as text")
    asked = docs.where("uid % 4 = 0").selectExpr("uid as query_id", "text as query")
    for out in (
        lexical.bm25(lexical.build_index(docs), asked, 5),
        dense.sparse_search(asked.selectExpr("query_id", "'common' as term", "1.0D as weight"), docs.selectExpr("uid", "'common' as term", "1.0D + uid % 3 as weight"), 5),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        rows = out.collect()
        assert len(rows) == 500 and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}


def test_sparse_search_of_the_stored_index(spark, folder):
    """The lexical index's postings give the weights that the texts give."""
    from palimpsest.queries import retrieval as r

    rows = lambda df: {(x["query_id"], x["uid"], round(x["score"], 9), x["rank"]) for x in df.collect()}
    assert rows(r._sparse(spark, folder, 20, r.index(spark, folder))) == rows(r._sparse(spark, folder, 20))


@pytest.mark.parametrize("names", (False, True))
def test_packed_postings_are_the_same(monkeypatch, names):
    monkeypatch.setattr(products, "PACK", 700)
    monkeypatch.setattr(products, "PACKED", 90)
    units, *_ = arranged(np.random.default_rng(5), 300, 2, 40, names)
    group = pa.array(np.arange(units.num_rows) * 7 % 3, pa.int32())
    packed = pa.Table.from_batches(products._packing(iter(units.add_column(0, "u", group).to_batches(max_chunksize=500))))
    rows = lambda t: sorted(zip(*(t[c].to_pylist() for c in ("uid", "tid", "uw"))))
    assert rows(products._unpacked(packed)) == rows(units)
    one = packed.filter(pa.array([x == 1 for x in packed["u"].to_pylist()]))
    assert rows(products._unpacked(one)) == rows(units.filter(pa.array([x == 1 for x in group.to_pylist()])))
    some = sorted(set(units["uid"].to_pylist()))[::5]
    listed = pa.table({"uids": pa.array([[x] for x in some], one.schema.field("uids").type)})
    both = pa.concat_tables([packed, listed], promote_options="default")
    assert rows(products._unpacked(both, True)) == [x for x in rows(units) if x[0] in set(some)]
    assert products._unpacked(packed, True).num_rows == 0


def _shuffled(spark, made):
    """Bytes that the stages of ``made()`` shuffle, by Spark's status store."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    made()
    return sum(n for k, n in stages().items() if k not in before)


def test_index_and_search_shuffle_little(spark):
    """Texts are shuffled once to be stored, and postings go to a search within some units in a few bytes each."""
    docs = written(spark.range(20_000).selectExpr("id as uid", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', pmod(hash(id, i), 300)))) as text"), "docs")
    asked, allowed = docs.where("uid % 4000 = 0").selectExpr("uid as query_id", "text as query"), docs.where("uid % 2 = 1").select("uid")
    made: list = []
    assert _shuffled(spark, lambda: made.append(lexical.build_index(docs).stored())) < 20_000 * 30 * 5
    assert _shuffled(spark, lambda: made.append(lexical.bm25(made[0], asked, 5, allowed))) < 20_000 * 30 * 1.4
    rows = made[1].collect()
    assert len(rows) == 25 and all(r["uid"] % 2 for r in rows)


def test_cascade_makes_its_chunks_once(spark, folder):
    """What is packed is read from a table, not made again by the searches' joins."""
    from palimpsest.queries import context

    plan = context.tri_tower(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
