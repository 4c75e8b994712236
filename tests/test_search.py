import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators.keywords import index, keyword_topk, parts
from granary.operators.retrieval import bm25, cosine_topk
from granary.operators.vectors import VectorIndex
from granary.sources.shared import new_folder, ship_package


def best(df, *names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("block", [4, 128])
def test_keyword_index_equals_the_join(spark, monkeypatch, block):
    monkeypatch.setattr("granary.operators.keywords.BLOCK", block)
    rng = np.random.default_rng(8)
    common, rare = ["the", "of", "a"], [f"w{i}" for i in range(400)]
    text = lambda: " ".join([*rng.choice(common, 12), *rng.choice(rare, int(rng.integers(0, 14)), p=(q := 1 / np.arange(1, 401)) / q.sum())])
    docs = spark.createDataFrame([(i, text()) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "the the")], "doc_id int, text string")
    asked = [(i, f"The {' '.join(rng.choice(rare, int(rng.integers(1, 4))))} of") for i in range(25)] + [(100, "the of a"), (101, "nothing known"), (102, None), (103, "w399 the"), (104, "W1 w1")]
    queries = spark.createDataFrame(asked, "query_id int, question string")
    blocks = index(parts(docs), block).cache()
    for k in (1, 5, 40):
        got, report = keyword_topk(queries, blocks, k)
        want = bm25(queries, docs, k)
        # Equal scores are in order of their ids here; the join's sums may differ in their last bits.
        assert best(got, "query_id", "rank", "score") == best(want, "query_id", "rank", "score")
        found = {(r.query_id, r.doc_id): r.score for r in got.collect()}
        full = {(r.query_id, r.doc_id): r.score for r in bm25(queries, docs, 2000).collect()}
        assert all(abs(full[x] - s) < 1e-9 for x, s in found.items())
        told = {r.query_id: (r.read, r.postings) for r in report.collect()}
        assert set(told) == {q for q, _, _ in best(want, "query_id", "rank", "score")}
        if k == 5 and block == 4:
            # The three common words are in nearly all documents: their postings are left unread where a rarer word decides.
            plain = [told[q] for q in range(25)]
            assert sum(r for r, _ in plain) < 0.25 * sum(p for _, p in plain)


def clouds(rng, n, d, centers, spread):
    at = rng.normal(size=(centers, d))
    return [(int(i), [float(x) for x in at[i % centers] + spread * rng.normal(size=d)]) for i in range(n)]


@pytest.mark.parametrize("spread, size", [(0.15, 64), (3.0, 4096)])
def test_bounded_search_is_exact(spark, spread, size):
    ship_package(spark)
    rng = np.random.default_rng(6)
    rows = clouds(rng, 2400, 12, 24, spread)
    rows += [(9000 + i, v) for i, v in enumerate([None, [], [0.0] * 12, [1.0] * 3, [float("nan")] * 12, rows[0][1], rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 40 = 0 OR vec_id > 8999")
    built = VectorIndex(spark, new_folder(spark, "v")).build(df, pivots=24, size=size)
    for k, other in ((1, True), (10, False), (5000, False)):
        got, report = built.topk(asked, k, "vec_id", skip_self=other)
        want = cosine_topk(asked, df, k, skip_self=other)
        assert best(got.withColumnRenamed("key", "vec_id"), "query_id", "rank", "vec_id", "score") == best(want, "query_id", "rank", "vec_id", "score")
        told = report.agg(F.sum("visited"), F.sum("blocks"), F.sum("read"), F.sum("rows")).first()
        assert told[0] <= told[1] and told[2] <= told[3]
        if spread < 1 and k <= 10:
            # Most blocks lie in other directions, and are skipped.
            assert told[0] < 0.5 * told[1] and told[2] < 0.35 * told[3]
        if k == 5000:
            assert told[2] == told[3]


def test_bounded_search_of_nothing(spark):
    ship_package(spark)
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    empty = VectorIndex(spark, new_folder(spark, "v")).build(none)
    assert empty.topk(some, 3, "vec_id")[0].collect() == [] and empty.topk(some, 3, "vec_id")[1].collect() == []
    full = VectorIndex(spark, new_folder(spark, "v")).build(some)
    assert full.topk(none, 3, "vec_id")[0].collect() == []
    assert [r.key for r in full.topk(some.where("vec_id = 1"), 3, "vec_id")[0].orderBy("rank").collect()] == [1, 2]
