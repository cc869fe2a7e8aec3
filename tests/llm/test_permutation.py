import math

import numpy as np
from pyspark.sql import functions as F

from nodalis.llm import permutation as A

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, qids, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    return {q: sorted((-float(ok[q] @ v), i) for i, v in ok.items() if i != q)[:k] for q in qids}


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(12, 16))
    x = centers[r.integers(0, 12, 2500)] + 0.4 * r.normal(size=(2500, 16))
    x *= r.uniform(0.5, 2, (2500, 1))  # lengths differ: inner product is not the angle
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = A.search(df, F.col("vec_id") % 50 == 0, k=10).collect()
    want = brute(rows, range(0, 2500, 50), 10)
    by = {}
    for g in got:
        by.setdefault(g.query_id, {})[g.rank] = (g.vec_id, g.score)
    vec = dict(rows)
    hit = 0
    for q, w in want.items():
        assert sorted(by[q]) == list(range(1, 11))
        order = [by[q][i] for i in range(1, 11)]
        assert order == sorted(order, key=lambda z: (-z[1], z[0]))
        for i, s in order:
            assert i != q and math.isclose(s, float(np.array(vec[q], np.float32).astype(float) @ np.array(vec[i], np.float32).astype(float)), rel_tol=1e-12)
        hit += len({i for _, i in w} & {i for i, _ in order})
    assert hit >= 0.9 * 10 * len(want)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 7)  # files fall into grids
    same = [1.0, 2.0, 0.0]
    rows = [(i, same, 0) for i in range(0, 60)] + [(60, None, 0), (80, [0.0, 0.0, 0.0], 0), (100, [1.0, None, 2.0], 0), (120, [1.0, float("nan"), 0.0], 0), (140, [float("inf"), 1.0, 1.0], 0), (160, [1.0, 2.0], 0), (None, same, 0), (20, same, 1), (180, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = A.search(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in got] == [(q, k + 1, i, 5.0) for q in (0, 20, 40) for k, i in enumerate([i for i in range(7) if i != q][:5])]
    few = A.search(df.where("vec_id < 3"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert [(g.query_id, g.vec_id) for g in few] == [(0, 1), (0, 2)]
    assert A.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_against_the_definition():
    r = np.random.default_rng(2)
    for pivots, prefix in ((9, 9), (12, 5), (40, 7)):
        orders = np.array([r.permutation(pivots)[:prefix] for _ in range(50)]).astype(np.uint8)
        files = A.Files(orders, pivots)
        q = r.permutation(pivots)[:prefix].astype(np.uint8)
        place = {int(p): i for i, p in enumerate(q)}
        want = [sum(abs(i - place.get(int(p), prefix)) for i, p in enumerate(o)) + sum(prefix - i for p, i in place.items() if p not in o) for o in orders]
        assert files.footrule(q).tolist() == want
        near = files.nearest(q, 10)
        assert sorted(near.tolist()) == sorted(sorted(range(50), key=lambda i: (want[i], i))[:10])


def recall(x, k=20, keep=A.KEEP):
    """(recall, share of the rows reranked) in one chunk."""
    ids = np.arange(len(x))
    wide = x.astype(np.float64)
    longest = float(np.sqrt((wide * wide).sum(1).max()))
    piv = A.Pivots(A.spread(wide[np.random.default_rng(5).permutation(len(x))[: A.SAMPLE]], longest, 256), longest)
    at = np.arange(0, len(x), 40)
    queries = list(zip(at, wide[at], piv.order(wide[at], True), strict=True))
    hit = 0
    for i, got, _ in A.rerank(ids, x, piv.order(wide, False), 256, queries, k, keep):
        s = wide @ wide[at[i]]
        s[at[i]] = -np.inf
        hit += len(set(got.tolist()) & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hit / k / len(at), max(A.LEAST * k + 1, keep * len(x)) / len(x)


def test_recall_with_and_without_structure():
    r = np.random.default_rng(4)
    free = r.normal(size=(8000, 64))
    centers = r.normal(size=(40, 64))
    tight = centers[r.integers(0, 40, 8000)] + 0.5 * r.normal(size=(8000, 64))
    crowd = np.r_[free[:6000], free[:1] + 0.1 * r.normal(size=(2000, 64))]
    for name, x in (("crowd", crowd), ("free", free / np.linalg.norm(free, axis=1)[:, None]), ("tight", tight), ("lengths", free * r.uniform(0.5, 1.5, (8000, 1)))):
        found, share = recall(x.astype(np.float32))
        print(name, "recall", round(found, 3), "share of rows reranked", share)
        assert found >= 0.9 and share <= 0.07


def test_equal_scores_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 300)
    monkeypatch.setattr(A, "QUERIES", 20)
    r = np.random.default_rng(6)
    kinds = r.normal(size=(90, 24)).astype(np.float32)
    of = r.integers(0, 90, 1000)
    of[:400] = 7  # one very common vector
    df = spark.createDataFrame([(i, kinds[of[i]].tolist(), 0, "x", 1) for i in range(1000)], SCHEMA + ", score string, q int").repartition(7)
    got = {}
    for g in A.search(df, F.col("vec_id") % 20 == 0, k=10, keep=1.0).collect():
        got.setdefault(g.query_id, {})[g.rank] = g.vec_id
    wide = kinds.astype(np.float64)
    for q in range(0, 1000, 20):
        s = (wide * wide[of[q]]).sum(1)[of]
        assert [got[q][i] for i in range(1, 11)] == sorted((i for i in range(1000) if i != q), key=lambda i: (-s[i], i))[:10]


def test_lengths_are_searches_of_their_own(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=3 + i % 2).tolist(), 0) for i in range(80)]
    got = A.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 1, k=4, keep=1.0).collect()
    want = brute([(i, v) for i, v, _ in rows if i % 2 == 1], [21, 41, 61, 1], 4)
    assert {(g.query_id, g.rank, g.vec_id) for g in got} == {(q, n + 1, i) for q, w in want.items() for n, (_, i) in enumerate(w)}
