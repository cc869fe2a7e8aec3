"""Every query against its SQL on the smallest tables."""

import math
import os

import numpy as np
import pytest

from nodalis.plans import graph_queries as G
from nodalis.plans import operator_queries as O

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, (int, float)):
        return (1, float(v))
    return (2, str(v))


def test_operator_queries_are_registered():
    assert G.QUERIES["loss_terms"] is O.loss_terms


@pytest.mark.parametrize("name", sorted(G.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = G.QUERIES[name](spark, DATA)
    cur = duck.execute(G.ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(got.columns) == sorted(cols)
    a = sorted([[norm(r[c]) for c in sorted(cols)] for r in got.collect()])
    order = [cols.index(c) for c in sorted(cols)]
    b = sorted([[norm(r[i]) for i in order] for r in want])
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (_, u), (_, v) in zip(x, y, strict=True):
            assert u == v


@pytest.mark.parametrize("name", sorted(set(G.QUERIES) - set(G.ORACLE)))
def test_model_queries_give_rows(spark, name):
    assert G.QUERIES[name](spark, DATA).limit(1).count() == 1


# --- queries without SQL, against NumPy on the same tables -----------------------------------


@pytest.fixture(scope="module")
def months(duck):
    """(steps x nodes) of value and order count."""
    rows = duck.execute(f"WITH {G.TRADE} SELECT t, node, x, c FROM snap ORDER BY t, node").fetchall()
    steps = sorted({r[0] for r in rows})
    return np.array([r[2:] for r in rows], float).reshape(len(steps), -1, 2)


def operator(x, y, rank=None):
    w, v = np.linalg.eigh(x.T @ x)
    order = np.argsort(-w)[: rank or len(w)]
    order = order[w[order] > w.max() * len(w) * np.finfo(float).eps]
    return (v[:, order] @ (v[:, order].T @ (x.T @ y) / w[order][:, None])).T


def test_dmd_queries(spark, months):
    x = months[:, :, 0]
    cut = int(len(x) * 0.7)
    k = operator(x[: cut - 1], x[1:cut])
    test = len(x) - int(len(x) * 0.7) - int(len(x) * 0.1)
    got = {(r.origin, r.h, r.node): r.x for r in G.QUERIES["dmd_forecast"](spark, DATA).collect()}
    assert len(got) == test * 3 * 25
    for (o, h, n), v in list(got.items())[::7]:
        assert abs(v - (np.linalg.matrix_power(k, h) @ x[o])[n]) < 1e-4
    k = operator(x[: cut - 1], x[1:cut], 10)
    got = {r.horizon: r for r in G.QUERIES["dmd_errors"](spark, DATA).collect()}
    for h in (1, 3, 6):
        each = [np.linalg.matrix_power(k, h) @ x[o] - x[o + h] for o in range(len(x) - 6)]
        assert abs(got[h].rmse - np.mean([np.sqrt((e**2).mean()) for e in each])) < 1e-6 and abs(got[h].mae - np.mean(np.abs(each))) < 1e-6
    both = np.c_[x, x * x]
    want = np.sort(np.abs(np.linalg.eigvals(operator(both[:-1], both[1:], 12))))[::-1]
    got = [r.magnitude for r in G.QUERIES["edmd_spectrum"](spark, DATA).orderBy("mode").collect()]
    assert np.allclose(got[:12], want[:12], atol=1e-6)
    t = np.arange(len(x) - 1)
    u = np.c_[np.sin(t * 0.5235987755982988), np.cos(t * 0.5235987755982988)]
    b = operator(np.c_[x[:-1], u], x[1:], 10).T[25:]
    got = {(r.i, r.j): r.v for r in G.QUERIES["controlled_dmd"](spark, DATA).collect()}
    assert all(abs(got[i, j] - b[i, j]) < 1e-6 for i in range(2) for j in range(25))


def test_network_queries(spark, duck, months):
    from nodalis.operators.nets import DiffusionGRU, GraphNet

    e = np.array(duck.execute(f"WITH {G.TRADE} SELECT src, dst FROM region_edges").fetchall())
    net = GraphNet("gat", 2, 8, 4, heads=2)
    got = {(r.t, r.node): r.f for r in G.QUERIES["attention_encoding"](spark, DATA).collect()}
    for t in (0, 11, len(months) - 1):
        assert np.allclose([got[t, n] for n in range(25)], net(months[t], e[:, 0], e[:, 1]), atol=1e-8)
    net, x = DiffusionGRU(2, 8, 2), months[-1]
    got = {(r.h, r.node): r.f for r in G.QUERIES["recurrent_forecast"](spark, DATA).collect()}
    for h in (1, 2, 3):
        x = net(x[None], e[:, 0], e[:, 1], np.ones(len(e)))
        assert np.allclose([got[h, n] for n in range(25)], x, atol=1e-8)


def test_chaotic_query(spark):
    got = {}
    for r in G.QUERIES["chaotic_trajectories"](spark, DATA).collect():
        got.setdefault((r.kind, r.traj), {})[r.t, r.node] = r.f[0]
    assert len(got) == 15

    def slope(v):
        return [(v[(i + 1) % 16] - v[i - 2]) * v[i - 1] - v[i] + 8 for i in range(16)]

    for seed in (0, 11):
        x = (8 + 0.01 * np.random.default_rng(seed).normal(size=16)).tolist()
        for _ in range(200):
            a = slope(x)
            b = slope([v + 0.025 * s for v, s in zip(x, a, strict=True)])
            c = slope([v + 0.025 * s for v, s in zip(x, b, strict=True)])
            d = slope([v + 0.05 * s for v, s in zip(x, c, strict=True)])
            x = [v + 0.05 / 6 * (p + 2 * q + 2 * r + s) for v, p, q, r, s in zip(x, a, b, c, d, strict=True)]
        assert np.allclose([got["ring", seed][0, i] for i in range(16)], x, atol=1e-4)
