import numpy as np
import pytest

from nodalis.operators import gradient as G
from nodalis.operators.frames import from_arrays
from nodalis.operators.model import GraphModel
from nodalis.operators.training import LossWeights

PATH3 = [(0, 1), (1, 0), (1, 2), (2, 1)]


def sequence(spark, steps=14, mask=None):
    k = np.array([[0.9, 0.2], [-0.1, 0.8]])
    x, out = np.random.default_rng(1).normal(size=(3, 2)), []
    for _ in range(steps):
        out.append(x.tolist())
        x = x @ k.T
    return from_arrays(spark, out, PATH3, masks=mask), k


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(0)
    k, c, z0, z1, y = r.normal(size=(3, 3)), r.normal(size=(2, 3)), r.normal(size=(5, 3)), r.normal(size=(5, 3)), r.normal(size=(5, 3, 2))
    w = LossWeights(reconstruction=0.7, rollout=1.3, forward=0.4)
    dk, dc, _ = G.gradients(k, c, z0, z1, y, w)
    loss = lambda a, b: w.total(G.gradients(a, b, z0, z1, y, w)[2])
    for p, g, put in ((k, dk, lambda q: loss(q, c)), (c, dc, lambda q: loss(k, q))):
        for i in np.ndindex(p.shape):
            e = np.zeros_like(p)
            e[i] = 1e-6
            assert np.isclose((put(p + e) - put(p - e)) / 2e-6, g[i], rtol=1e-5, atol=1e-6)


def test_training_approaches_the_operator(spark):
    f, k = sequence(spark)
    m = GraphModel()
    h = G.train(m, f, epochs=60, lr=0.05, weights=LossWeights(1, 1, 0, 1), horizon=2)
    assert len(h.epochs) == 60 and h.epochs[-1]["total"] < 0.05 * h.epochs[0]["total"]
    assert np.abs(m.operator.matrix() - k).max() < 0.15


def test_batches_validation_and_stopping(spark):
    f, _ = sequence(spark, mask=[[True, t != 3, True] for t in range(14)])
    assert G.examples(GraphModel(), f, 2).count() == 3 * 12 - 2  # two windows end on what was not seen
    m = GraphModel()
    h = G.train(m, f.slice(0, 10), epochs=12, lr=0.02, batches=2, max_norm=1.0, lr_schedule=lambda e: 0.9**e, validation=f.with_features(f.snap), patience=1, least=10.0)
    assert len(h.epochs) == 2 and "validation" in h.epochs[0]  # an improvement of under 10 does not count
    with pytest.raises(ValueError):
        G.train(m, f, epochs=0)
    with pytest.raises(ValueError):
        G.train(m, f, horizon=20)
