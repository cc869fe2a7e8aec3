"""Tape gradients against differences; networks and forecasters that learn."""

import numpy as np
import pytest

from nodalis.functions.tape import Node, gradients, leaves, rebuilt
from nodalis.operators import learning, nets
from nodalis.operators.frames import from_arrays
from nodalis.operators.training import LossWeights

EDGES = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 0)]
SRC, DST = (np.array(x) for x in zip(*EDGES, strict=True))
W = np.linspace(0.5, 1.5, len(EDGES))


def compare(f, params, tol=2e-5):
    """Tape gradients of f(params) against central differences."""
    nodes = [Node(p) for p in params]
    got = gradients(f(nodes), nodes)
    for i, p in enumerate(params):
        for at in list(np.ndindex(p.shape))[:6]:
            step = np.zeros_like(p)
            step[at] = 1e-6
            up = [q + step if j == i else q for j, q in enumerate(params)]
            down = [q - step if j == i else q for j, q in enumerate(params)]
            want = (float(f([Node(q) for q in up]).value) - float(f([Node(q) for q in down]).value)) / 2e-6
            assert abs(got[i][at] - want) < tol * (1 + abs(want)), (i, at)


@pytest.mark.parametrize("kind", nets.KINDS)
@pytest.mark.parametrize("activation", ["tanh", "elu"])
def test_layer_gradients(kind, activation):
    net = nets.GraphNet(kind, 2, 3, 2, heads=2, activation=activation, edge=kind == "transformer", seed=1)
    x = np.random.default_rng(0).normal(size=(4, 2))
    plain = net(x, SRC, DST, W)

    def f(params):
        out = learning.with_parameters(net, iter(params))(x, SRC, DST, W)
        assert np.allclose(out.value, learning.with_parameters(net, (p.value for p in params))(x, SRC, DST, W))
        return (out * out).sum()

    assert np.allclose(f([Node(p) for p in leaves(net.__dict__)]).value, (plain**2).sum())
    compare(f, leaves(net.__dict__))


@pytest.mark.parametrize("net", [nets.DiffusionGRU(2, 3, 2, history=3), nets.TemporalGraphConv(2, 3, 2, history=3), nets.DilatedGraphNet(2, 3, 2, layers=2, nodes=4, history=3)])
def test_forecaster_gradients(net):
    x = np.random.default_rng(0).normal(size=(3, 4, 2))

    def f(params):
        out = learning.with_parameters(net, iter(params))(x, SRC, DST, W)
        return (out * out).mean()

    compare(f, leaves(net.__dict__))


def test_model_gradients():
    r = np.random.default_rng(2)
    for decoder in (None, nets.GraphNet("sage", 5, 4, 2, activation="tanh")):
        m = learning.LearnedModel(2, nets.GraphNet("gat", 2, 3, 3, activation="tanh"), decoder)
        x = r.normal(size=(3, 4, 2))
        for term in learning.TERMS:
            compare(lambda p, m=m, x=x, term=term: m._put(rebuilt(m.parts(), iter(p))).losses(x, SRC, DST, W)[term], leaves(m.parts()))


def series(log, spark, term):
    return np.array([r.value for r in log.to_df(spark).where(f"term = '{term}'").orderBy("epoch").collect()])


def system(spark, steps=14):
    """Each node takes a share of its in-neighbours."""
    r = np.random.default_rng(3)
    a = np.zeros((4, 4))
    np.add.at(a, (DST, SRC), 0.15)
    a += 0.6 * np.eye(4)
    x = [r.normal(size=(4, 2))]
    for _ in range(steps - 1):
        x.append(np.tanh(a @ x[-1]) + 0.3 * np.sin(len(x)))
    return from_arrays(spark, [v.tolist() for v in x], EDGES, weights=[1.0] * len(EDGES))


@pytest.mark.parametrize("kind", ["gcn", "transformer"])
def test_encoder_and_decoder_learn_together(spark, kind):
    f = system(spark)
    m = learning.LearnedModel(2, nets.GraphNet(kind, 2, 6, 4, activation="tanh", seed=1), nets.GraphNet("sage", 6, 8, 2, activation="tanh", seed=2))
    before = [v.copy() for v in leaves(m.parts())]
    m.fit(f, epochs=25, lr=0.02, weights=LossWeights(reconstruction=1.0, forward=0.1, rollout=0.2), horizon=2)
    total = series(m.log, spark, "total")
    assert total[-1] < 0.5 * total[0]
    assert all(not np.allclose(a, b) for a, b in zip(before, leaves(m.parts()), strict=True) if a.ndim > 1)
    got = m.predict(f, 2)
    assert got.count() == 14 * 4 * 2
    src = m.encode(np.array([r.f for r in f.snap.where("t = 3").orderBy("node").collect()]), SRC, DST, np.ones(len(EDGES)))
    want = m.decode(src @ m.k.T @ m.k.T, SRC, DST, np.ones(len(EDGES)))
    rows = got.where("origin = 3 and h = 2").orderBy("node").collect()
    assert np.allclose([r.f for r in rows], want)


@pytest.mark.parametrize("make", [lambda: nets.DiffusionGRU(2, 6, 2, history=2), lambda: nets.TemporalGraphConv(2, 4, 2, blocks=1, history=2), lambda: nets.DilatedGraphNet(2, 4, 2, layers=2, history=2)])
def test_forecasters_learn(spark, make):
    f = system(spark)
    a, b, _ = f.split(0.7, 0.2, 0.1, (4, 3, 1))
    net, log = learning.train_forecaster(make(), a, epochs=15, lr=0.03, validation=b, patience=10)
    total = series(log, spark, "total")
    assert total[-1] < 0.7 * total[0] and np.isfinite(series(log, spark, "validation")).all()
    assert nets.autoregress(net, f.slice(13, 14), 2).count() == 8


def test_examples_leave_out_what_is_missing(spark):
    masks = [[True] * 4 for _ in range(6)]
    masks[3][1] = False
    f = from_arrays(spark, np.zeros((6, 4, 2)).tolist(), EDGES, masks=masks)
    assert {r.t for r in learning.examples(f, 1, 1).collect()} == {0, 1, 4}
    with pytest.raises(ValueError):
        learning.LearnedModel(2, nets.GraphNet("gcn", 2, 3, 3), nets.GraphNet("gcn", 3, 3, 2))


@pytest.mark.parametrize("kind", nets.KINDS)
def test_joined_layers_equal_the_arrays(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(2, 5, 2))  # node 4 has no edge
    net = nets.GraphNet(kind, 2, 3, 2, heads=2, activation="elu", edge=kind == "transformer", seed=3)
    f = from_arrays(spark, x.tolist(), EDGES, weights=W.tolist())
    got = {(q.t, q.node): q.f for q in nets.encode_joined(net, f).collect()}
    for t in range(2):
        want = net(x[t], SRC, DST, W)
        assert all(np.allclose(got[t, n], want[n], atol=1e-9) for n in range(5))
    other = [EDGES, [(0, 2), (3, 1)]]
    f = from_arrays(spark, x.tolist(), other)
    got = {(q.t, q.node): q.f for q in nets.encode(net, f).collect()}
    for t, e in enumerate(other):
        a, b = (np.array(v) for v in zip(*e, strict=True))
        assert all(np.allclose(got[t, n], v, atol=1e-9) for n, v in enumerate(net(x[t], a, b)))
