import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodalis.functions import linalg as L
from nodalis.functions import vectors as V
from nodalis.operators import estimation, fit, latent, metrics, model, nets, spectrum, topology, training, uncertainty
from nodalis.operators.frames import Frames, from_arrays, hold_last, multi, rollout_origins, split_points, windows
from nodalis.sources import matpower, simulators, traffic

PATH5 = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)]


def decay(spark, steps=5):
    return from_arrays(spark, [[[0.9**t] * 3 for _ in range(5)] for t in range(steps)], PATH5)


def linear(spark, k, x0, steps, **how):
    x, out = np.array(x0, float), []
    for _ in range(steps):
        out.append([[v] for v in x])
        x = np.asarray(k) @ x
    return from_arrays(spark, out, [(0, 1), (1, 0)], **how)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- frames ---------------------------------------------------------------------------


def test_frames_metadata_and_slices(spark):
    f = decay(spark)
    assert (f.num_nodes, f.num_timesteps, f.channels, f.control_dim) == (5, 5, 3, 0)
    assert f.slice(1, 3).num_timesteps == 2
    with pytest.raises(ValueError):
        f.slice(3, 3)
    with pytest.raises(ValueError):
        f.slice(0, 6)
    assert split_points(80, 0.7, 0.1, 0.2) == (56, 64)
    assert split_points(10, 0.7, 0.1, 0.2) == (7, 9)  # the validation part's minimum
    with pytest.raises(ValueError):
        split_points(5, 0.7, 0.1, 0.2)
    with pytest.raises(ValueError):
        split_points(80, 0.7, 0.1, 0.3)


def test_validation(spark):
    with pytest.raises(ValueError):
        from_arrays(spark, [], PATH5)
    with pytest.raises(ValueError):
        from_arrays(spark, [[[1.0]], [[1.0], [2.0]]], [(0, 0)])
    with pytest.raises(ValueError):
        from_arrays(spark, [[[1.0]], [[1.0]]], [(0, 0)], times=[1.0, 1.0])
    with pytest.raises(ValueError):
        from_arrays(spark, [[[1.0]], [[1.0]]], [(0, 0)], masks=[[True], [False]])


def test_windows_and_masks(spark):
    f = from_arrays(spark, [[[float(t)], [10.0 + t]] for t in range(4)], [(0, 1), (1, 0)], masks=[[True, True], [False, True], [True, True], [True, True]])
    w = {(r.t, r.node): r.f for r in f.windowed(3).snap.collect()}
    assert w[0, 0] == [0, 0, 0] and w[3, 0] == [0, 2, 3] and w[3, 1] == [11, 12, 13]  # step 1 of node 0 is unobserved
    assert f.windowed(3, pad=False).num_timesteps == 2
    p = {(r.t, r.node): r.observed for r in f.pair_mask().collect()}
    assert p[0, 0] is False and p[2, 0] is True and len(p) == 6
    assert rows(windows(f, 3, seed=1, limit=1), "traj") == [(0,)]
    assert windows(f, 3).count() == 2
    assert rollout_origins(10, 3, "all") == list(range(7))
    assert rollout_origins(10, 3, per_epoch=5, seed=1, epoch=2) == rollout_origins(10, 3, per_epoch=5, seed=1, epoch=2)
    with pytest.raises(ValueError):
        rollout_origins(10, 3, [8])


def test_multi_times_controls(spark):
    a = from_arrays(spark, [[[1.0]], [[2.0]]], [(0, 0)], times=[0.0, 0.5], controls=[[1.0], [0.0]])
    m = multi([a, a])
    assert m.snap.select("traj").distinct().count() == 2 and m.control_dim == 1
    assert rows(a.delta_t(), "t", "dt") == [(0, 0.5)]
    with pytest.raises(ValueError):
        a.controls(1, 2)


def test_dynamic_topology_and_hold_last(spark):
    f = from_arrays(spark, [[[1.0], [2.0]]] * 3, [[(0, 1)], [(1, 0)], [(0, 1)]])
    assert f.dynamic and f.is_dynamic()
    with pytest.raises(ValueError):
        f.edge_index
    e = hold_last(f.edges.where("t < 2"), 4)
    assert rows(e, "t", "src", "dst") == [(0, 0, 1), (1, 1, 0), (2, 1, 0), (3, 1, 0)]


# --- topology ---------------------------------------------------------------------------


def test_path3_adjacency_and_isolated_node(spark):
    e = topology.path_edges(spark, 3)
    assert all(math.isclose(r.w, 1 / math.sqrt(2)) for r in topology.normalized_adjacency(e).collect())
    snap = spark.createDataFrame([(0, 0, i, [x]) for i, x in enumerate([1.0, 0.5, 3.0])], "traj int, t int, node int, f array<double>")
    two = topology.path_edges(spark, 2)
    for rate in (0.25, 0.5, 1.0):
        out = {r.node: r.f[0] for r in simulators.diffusion(snap, two, 2, rate, 1.0, 1).where("t = 1").collect()}
        assert out[2] == 3.0 and math.isclose(out[0], 1 - rate * 0.5)
    assert {r.node: r.f[0] for r in topology.laplacian(Frames(snap, two)).collect()}[2] == 0.0


def test_ring_of_two_repeats_edges(spark):
    assert rows(topology.ring_edges(spark, 2), "src", "dst") == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert topology.grid_edges(spark, 2, 3).count() == 14
    assert topology.path_edges(spark, 1).count() == 0


def test_matches_dense_algebra(spark):
    r = np.random.default_rng(0)
    a = r.random((5, 5)) * (r.random((5, 5)) < 0.6)
    a = np.triu(a, 1) + np.triu(a, 1).T
    s, d = np.nonzero(a)
    x = r.normal(size=(5, 2))
    f = from_arrays(spark, [x.tolist()], list(zip(s.tolist(), d.tolist(), strict=True)), [float(v) for v in a[s, d]])
    deg = a.sum(1)
    inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1e-12)), 0)
    hat = inv[:, None] * a * inv
    lap = np.diag((deg > 0).astype(float)) - hat
    get = lambda df: np.array([q.f for q in sorted(df.collect(), key=lambda q: q.node)])
    assert np.allclose(get(topology.adjacency_matvec(f)), hat @ x)
    assert np.allclose(get(topology.laplacian(f)), lap @ x)
    assert np.allclose(get(topology.curvature(f)), lap @ lap @ x)
    grad = np.sqrt(np.maximum(0, (hat[:, :, None] * (x[None] - x[:, None]) ** 2).sum(1)))
    assert np.allclose(get(topology.gradient(f)), grad)
    sup = nets.walks(s, d, a[s, d], 5, 2)
    for q in topology.diffusion_supports(f.edges, f.snap.select("traj", F.lit(None).cast("int").alias("t"), "node"), 2).collect():
        assert math.isclose(q.w, sup[q.support][q.src, q.dst], abs_tol=1e-12)
    with pytest.raises(ValueError):
        topology.observable("nothing")
    assert get(topology.observable("polynomial(2)")(f)).shape == (5, 4)


def test_impute_pins_observed_nodes(spark):
    f = from_arrays(spark, [[[1.0], [50.0], [3.0]]], [(0, 1), (1, 0), (1, 2), (2, 1)], masks=[[True, False, True]])
    got = {r.node: r.f[0] for r in topology.diffuse_impute(f.snap, f.mask, f.edges, 1).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0}
    # trajectories with edges of their own
    g = multi([f, Frames(f.snap, f.edges.where("src + dst = 1"), mask=f.mask)])
    got = {(r.traj, r.node): r.f[0] for r in topology.diffuse_impute(g.snap, g.mask, g.edges, 1).collect()}
    assert (got[0, 1], got[1, 1]) == (2.0, 1.0)


def test_pool_and_unpool(spark):
    f = from_arrays(spark, [[[3.0], [1.0], [2.0], [0.0]]], PATH5[:6])
    p = topology.topk_pool(f.snap, [1.0], 0.5)
    assert rows(p, "node", "new") == [(0, 0), (2, 1)]
    u = topology.unpool(p.select("traj", "t", F.col("new").alias("node"), "f"), p, f.snap, 1)
    assert {r.node: round(r.f[0], 6) for r in u.collect()} == {0: round(3 * math.tanh(3), 6), 1: 0, 2: round(2 * math.tanh(2), 6), 3: 0}


def test_knn_in_blocks_equals_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(60, 3))
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, x array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), d[i]))[:4]}
    want |= {(b, a) for a, b in want}
    assert set(rows(topology.knn_edges(p, 4, block=17), "src", "dst")) == want


# --- metrics -----------------------------------------------------------------------------


def test_metric_values(spark):
    e = spark.createDataFrame([(1.0, 2.0), (4.0, 2.0), (6.0, 8.0)], "p double, y double")
    r = e.agg(metrics.mae(F.col("p"), F.col("y")).alias("a"), metrics.rmse(F.col("p"), F.col("y")).alias("b"), metrics.mape(F.col("p"), F.col("y")).alias("c")).first()
    assert math.isclose(r.a, 5 / 3) and math.isclose(r.b, math.sqrt(3)) and math.isclose(r.c, 0.583333333, rel_tol=1e-6)


def test_evaluate_means_over_origins(spark):
    f = decay(spark, 8)
    got = {r.horizon: r for r in metrics.evaluate(metrics.persistence(f, (1, 3)), f, (3, 1)).collect()}
    errs = {h: [abs(0.9**t - 0.9 ** (t + h)) for t in range(5)] for h in (1, 3)}
    for h in (1, 3):
        assert math.isclose(got[h].mae, np.mean(errs[h])) and math.isclose(got[h].rmse, np.mean(errs[h])) and got[h].origins == 5
    assert math.isclose(got[None].mae, (got[1].mae + got[3].mae) / 2)
    with pytest.raises(ValueError):
        metrics.evaluate(metrics.persistence(f, (9,)), f, (9,))


# --- fits ----------------------------------------------------------------------------------


def test_dmd_recovers_the_operator(spark):
    k = np.array([[0.8, 0.1], [-0.2, 1.05]])
    f = linear(spark, k, (1, -0.5), 12)
    m = fit.DMD(time_step=0.25).fit(f)
    assert np.allclose(m.operator, k, atol=1e-8)
    got = {(r.h, r.node): r.f[0] for r in m.predict(f.snap.where("t = 0"), 3).collect()}
    want = np.linalg.matrix_power(k, 3) @ [1, -0.5]
    assert math.isclose(got[3, 0], want[0], abs_tol=1e-7) and math.isclose(got[3, 1], want[1], abs_tol=1e-7)
    s = m.spectrum()
    assert np.allclose(sorted(s.magnitude), sorted(np.abs(np.linalg.eigvals(k))))
    with pytest.raises(RuntimeError):
        fit.DMD().spectrum()
    with pytest.raises(ValueError):
        fit.DMD(rank=0)


def test_dmd_with_control_and_dictionary(spark):
    k, b = np.array([[0.9, 0.1], [0.0, 0.8]]), np.array([[0.5, -0.25]])
    r, x, xs, us = np.random.default_rng(2), np.array([1.0, -1.0]), [], []
    for _ in range(30):
        u = r.normal(size=1)
        xs.append([[v] for v in x])
        us.append(u.tolist())
        x = k @ x + u @ b
    f = from_arrays(spark, xs, [(0, 1), (1, 0)], controls=us)
    m = fit.DMDc().fit(f)
    assert np.allclose(m.operator, k, atol=1e-8) and np.allclose(m.control, b, atol=1e-8)
    assert m.predict(f.snap.where("t = 0"), 2, us[:2]).count() == 4
    with pytest.raises(ValueError):
        m.predict(f.snap, 2, us[:1])
    lin = linear(spark, [[0.8, 0.1], [-0.2, 0.9]], (1, -0.5), 12)
    for how in ({"degree": 1}, {"dictionary": "kernel", "kernel": "linear"}, {"dictionary": "rbf", "centers": 5, "length": 2.0}):
        e = fit.EDMD(**how).fit(lin)
        got = [q.f[0] for q in e.predict(lin.snap.where("t = 0"), 1).orderBy("node").collect()]
        want = [q.f[0] for q in lin.snap.where("t = 1").orderBy("node").collect()]
        assert np.allclose(got, want, atol=0.2 if how.get("dictionary") == "rbf" else 1e-6)


def test_recursive_fit_converges():
    r, k = np.random.default_rng(0), np.diag([0.85, 0.80, 0.78, 0.82])
    a = estimation.RecursiveFit(4, forget=1.0, regularization=10)
    for _ in range(400):
        x = r.normal(size=4)
        a.update(x, k @ x)
    assert np.linalg.norm(a.matrix - k) < 0.1
    with pytest.raises(ValueError):
        a.update(np.zeros(4), np.zeros(4), np.zeros(1))


def test_recursive_fit_by_trajectory(spark):
    f = multi([linear(spark, [[0.5, 0], [0, 0.5]], (1, 2), 10), linear(spark, [[0.9, 0], [0, 0.9]], (1, 2), 10)])
    got = {r.traj: r.v for r in estimation.recursive_fit(f, 1.0).collect()}
    assert abs(got[0] - 0.5) < 0.02 and abs(got[1] - 0.9) < 0.02


# --- operators ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", latent.DISCRETE)
def test_discrete_operators(kind):
    o = latent.DiscreteOperator(4, kind, radius=0.95, seed=1)
    z = np.random.default_rng(1).normal(size=(3, 4))
    assert np.allclose(o.inverse_step(o.advance(z)), z, atol=1e-6)
    if kind in ("schur", "dissipative", "lyapunov"):
        assert o.certificate().margin > 0 and o.spectral_radius() < 1
    else:
        assert o.certificate() is None
    if kind != "dense":
        with pytest.raises(ValueError):
            o.set_dense(np.eye(4))


@pytest.mark.parametrize("kind", latent.CONTINUOUS)
def test_continuous_operators(kind):
    o = latent.ContinuousOperator(4, kind, bound=0.5, seed=2)
    z = np.random.default_rng(1).normal(size=(3, 4))
    assert np.allclose(o.advance(z, dt=0), z)
    if kind != "auxiliary_spectral":
        assert np.allclose(o.inverse_step(o.advance(z, dt=0.7), dt=0.7), z, atol=1e-8)
        assert np.allclose(o.advance(o.advance(z, dt=0.3), dt=0.4), o.advance(z, dt=0.7), atol=1e-8)
        assert np.allclose(L.expm(o.matrix() * 0.7), o.transition(0.7))
    if kind in ("schur", "dissipative", "lyapunov"):
        assert o.certificate().margin > 0 and o.max_real() < 0


def test_controls_and_columns(spark):
    c = latent.Control(2, "bilinear", latent=3)
    r = np.random.default_rng(4)
    o = latent.DiscreteOperator(3, control=c, seed=3)
    o.set_dense(r.normal(size=(3, 3)), r.normal(size=(2, 3)), r.normal(size=(2, 3, 3)))
    z, u = r.normal(size=(4, 3)), r.normal(size=(4, 2))
    want = o.advance(z, u)
    assert np.allclose(o.inverse_step(want, u), z, atol=1e-6)
    df = spark.createDataFrame([(i, z[i].tolist(), u[i].tolist()) for i in range(4)], "i int, z array<double>, u array<double>")
    got = np.array([q.y for q in df.select("i", o.column("z", "u").alias("y")).orderBy("i").collect()])
    assert np.allclose(got, want)
    with pytest.raises(ValueError):
        o.advance(z)
    with pytest.raises(ValueError):
        latent.Control(0, "bilinear", latent=3)
    a = latent.ContinuousOperator(3, control=latent.Control(2, latent=3, b=r.normal(size=(2, 3))))
    y = a.advance(z, u, 0.4)
    assert np.allclose(a.inverse_step(y, u, 0.4), z, atol=1e-8)
    got = np.array([q.y for q in df.select("i", a.column("z", "u", 0.4).alias("y")).orderBy("i").collect()])
    assert np.allclose(got, y)
    free = latent.ContinuousOperator(3, seed=5)
    by = df.withColumn("dt", F.when(F.col("i") < 2, 0.5).otherwise(0.25)).select("i", free.column_by_dt("z", "dt", [0.5, 0.25]).alias("y")).orderBy("i").collect()
    assert np.allclose(by[0].y, free.advance(z[:1], dt=0.5)[0]) and np.allclose(by[3].y, free.advance(z[3:], dt=0.25)[0])


def test_graph_operator_coupling(spark):
    g = latent.GraphOperator(latent.DiscreteOperator(2), latent.DiscreteOperator(2))
    g.own.set_dense(0.5 * np.eye(2))
    g.neighbour.set_dense(0.25 * np.eye(2))
    z, a = np.array([[1.0, -1.0], [2.0, 0.5]]), np.array([[0.0, 1.0], [1.0, 0.0]])
    want = 0.5 * z + 0.25 * a @ z
    assert np.allclose(g.advance(z, a), want)
    assert np.allclose((g.effective_matrix(a) @ z.ravel()).reshape(2, 2), want)
    assert np.allclose(g.inverse_step(want, a), z)
    f = from_arrays(spark, [z.tolist()], [(0, 1), (1, 0)])
    got = np.array([q.f for q in g.step(f.snap, topology.normalized_adjacency(f.edges)).orderBy("node").collect()])
    assert np.allclose(got, want)
    assert latent.eigenvalue_penalty(g, a) == 0.0


def test_matrix_functions():
    r = np.random.default_rng(5)
    a = r.normal(size=(5, 5))
    w, v = np.linalg.eig(a)
    assert np.allclose(L.expm(a), ((v * np.exp(w)) @ np.linalg.inv(v)).real)
    k = L.expm(0.3 * a)
    assert np.allclose(L.expm(L.logm(k)), k)
    q = L.cayley(a)
    assert np.allclose(q @ q.T, np.eye(5))
    gen, b = 0.2 * a, r.normal(size=(2, 5))
    f, g = L.van_loan(gen, b, 0.5)
    back, bb = L.van_loan_generator(f, g.T, 0.5)
    assert np.allclose(back, gen) and np.allclose(bb, b)
    mu, om = [0.1, -0.2], [1.0, 2.0]
    blocks = np.zeros((5, 5))
    for i in range(2):
        blocks[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = [[mu[i], -om[i]], [om[i], mu[i]]]
    blocks[4, 4] = -0.3
    assert blocks.shape == (5, 5) and np.allclose(L.expm(blocks * 0.5)[4, 4], math.exp(-0.15))


def test_block_rotation_column(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>")
    got = df.select(V.block_rotation("z", [0.1], [1.5], [-0.2], 0.7).alias("y")).first().y
    gen = np.array([[0.1, -1.5, 0], [1.5, 0.1, 0], [0, 0, -0.2]])
    assert np.allclose(got, L.expm(gen * 0.7) @ [1, 2, 3])
    assert df.select(V.unflatten("z", 3, 1).alias("y")).first().y == [[1.0], [2.0], [3.0]]


def test_increments():
    assert latent.increments([0.5, 1.5]) == [0.5, 1.0]
    with pytest.raises(ValueError):
        latent.increments([0.5], [0.5])
    with pytest.raises(ValueError):
        latent.increments(deltas=[1.0, 2.0], time_step=1.0)


# --- spectra ----------------------------------------------------------------------------------


def test_spectra_and_anomalies():
    s = spectrum.compute_spectrum(np.diag([0.5, 0.0, 0.9]), 0.5)
    assert np.allclose(s.magnitude, [0.9, 0.5, 0]) and s.growth[2] == -np.inf and math.isclose(s.growth[0], math.log(0.9) / 0.5)
    t = spectrum.compute_spectrum(np.diag([0.4, 0.8]))
    assert math.isclose(spectrum.distance(s, t), (0.1 + 0.1 + 0) / 3)
    assert spectrum.distance(s, s, "subspace_angle") < 1e-6
    refs = [spectrum.compute_spectrum(np.diag([0.9 + 0.01 * i, 0.5])) for i in range(4)]
    limit = spectrum.calibrate(refs)
    assert spectrum.is_anomaly(refs, spectrum.compute_spectrum(np.diag([0.1, 0.1])), limit)[1]
    assert not spectrum.is_anomaly(refs, refs[1], limit)[1]
    with pytest.raises(ValueError):
        spectrum.calibrate(refs[:1])
    m = spectrum.pairwise(refs)
    assert np.allclose(m, m.T) and np.allclose(np.diag(m), 0)
    g = spectrum.generator_spectrum(np.array([[0, -1], [1, 0]]))
    assert np.allclose(np.abs(g.frequency), 1 / (2 * np.pi))
    z = np.array([[1.0, 2.0, 3.0]])
    assert np.allclose((s.vectors @ s.amplitudes(z).T).T.real, z)


# --- estimation ---------------------------------------------------------------------------------


def test_kalman_nodewise_equals_joint_and_smoother_helps(spark):
    r, k = np.random.default_rng(7), np.array([[0.9, 0.1], [-0.1, 0.9]])
    x, clean, noisy = np.array([[1.0, 0.0], [0.5, -1.0]]), [], []
    for _ in range(25):
        clean.append(x)
        noisy.append(x + 0.3 * r.normal(size=x.shape))
        x = x @ k.T + 0.02 * r.normal(size=x.shape)
    mask = [[True, t % 5 != 2] for t in range(25)]
    f = from_arrays(spark, [v.tolist() for v in noisy], [(0, 1), (1, 0)], masks=mask)
    one = estimation.Observer(k, 4e-4, 0.09).filter(f)
    joint = estimation.Observer(k, 4e-4, 0.09, adjacency=np.zeros((2, 2)), neighbour=np.zeros((2, 2))).filter(f)
    get = lambda d: np.array([q.f for q in d.orderBy("t", "node").collect()])
    assert np.allclose(get(one), get(joint), atol=1e-10)
    sm = get(estimation.Observer(k, 4e-4, 0.09).smooth(f))
    truth, raw = np.concatenate(clean), np.concatenate(noisy)
    assert ((sm - truth) ** 2).mean() < ((get(one) - truth) ** 2).mean() < ((raw - truth) ** 2).mean()
    imp = get(estimation.Observer(k, 4e-4, 0.09).impute(f)).reshape(25, 2, 2)
    assert np.allclose(imp[3], noisy[3]) and not np.allclose(imp[2, 1], noisy[2][1])
    fv = estimation.forecast_variance(one, np.diag([0.9, 0.8]), 1e-3, 2)
    assert fv.count() == 100 and all(v > 0 for v in fv.first().var)


def test_uncertainty(spark):
    m = spark.createDataFrame([(0, float(v)) for v in range(11)], "k int, v double")
    r = uncertainty.member_interval(m, ["k"], "v", 0.8).first()
    assert (r["mean"], r.lower, r.upper) == pytest.approx((5.0, 1.0, 9.0))
    ms, ps = uncertainty.gaussian_forecast(np.diag([0.5]), np.ones(1), np.eye(1), 0.1, 2)
    assert np.allclose(ms.ravel(), [0.5, 0.25]) and np.allclose(ps.ravel(), [0.35, 0.1875])
    mean, lo, hi = uncertainty.sampled_interval(np.zeros(2), np.eye(2), lambda z: 2 * z)
    assert (lo < mean).all() and (mean < hi).all()
    assert uncertainty.nodewise(np.eye(2), 3).shape == (6, 6)
    with pytest.raises(ValueError):
        uncertainty.quantile_levels(1.0)


# --- nets and model ----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", nets.KINDS)
def test_nets_follow_node_order(kind):
    r = np.random.default_rng(8)
    x, src, dst = r.normal(size=(5, 3)), *np.array(PATH5).T
    net = nets.GraphNet(kind, 3, 8, 4, heads=2)
    y = net(x, src, dst)
    p = r.permutation(5)
    inv = np.argsort(p)
    assert y.shape == (5, 4)
    assert np.allclose(net(x[p], inv[src], inv[dst]), y[p])  # relabelled nodes, relabelled output
    with pytest.raises(ValueError):
        nets.GraphNet(kind, 3, 0, 4)


def test_forecasters(spark):
    f = decay(spark, 2)
    for net in (nets.DiffusionGRU(3, 6, 3, history=2), nets.TemporalGraphConv(3, 6, 3, history=2), nets.DilatedGraphNet(3, 6, 3, nodes=5, history=2)):
        out = nets.autoregress(net, f.slice(0, 1), 2)
        assert out.count() == 10 and np.isfinite(np.array([q.f for q in out.collect()])).all()
    a = nets.DilatedGraphNet(3, 6, 3, nodes=5).adaptive()
    assert np.allclose(a.sum(1), 1)


def test_model_learns_decay_and_round_trips(spark, tmp_path):
    f = decay(spark, 12)
    m = model.GraphModel(observables=["laplacian"], network=nets.GraphNet("gcn", 3, 4, 2)).fit(f)
    got = {r.horizon: r for r in m.evaluate(f, (1, 3)).collect()}
    assert got[3].rmse < 1e-3
    m.save(spark, f"{tmp_path}/m")
    again = model.GraphModel.load(spark, f"{tmp_path}/m")
    a = rows(m.predict(f.slice(0, 2), 2), "origin", "h", "node", "f")
    b = rows(again.predict(f.slice(0, 2), 2), "origin", "h", "node", "f")
    assert np.allclose([q[3] for q in a], [q[3] for q in b])
    plain = model.GraphModel(dynamics="continuous", time_step=0.5).fit(f)
    at = plain.predict_at(f.slice(0, 1), query_times=[0.25, 1.0])
    got = {(q.h, q.node): q.f[0] for q in at.collect()}
    assert abs(got[2, 0] - 0.81) < 1e-3 and abs(got[1, 0] - 0.9**0.5) < 1e-3
    plain.enable_adaptation()
    assert plain.adapt(np.ones((2, 3)), 0.9 * np.ones((2, 3))) < 1e-2
    plain.disable_adaptation()
    with pytest.raises(RuntimeError):
        plain.adapt(np.ones((1, 3)), np.ones((1, 3)))
    with pytest.raises(RuntimeError):
        model.GraphModel().spectrum()


def test_ensemble_and_hierarchy(spark, tmp_path):
    f = decay(spark, 8)
    e = model.Ensemble.of(lambda s: model.GraphModel(network=nets.GraphNet("sage", 3, 4, 2, seed=s), penalty=1e-3), 3).fit(f)
    i = e.predict_interval(f.slice(0, 1), 2, 0.8)
    assert i.count() == 30 and i.where("lower > mean + 1e-9 or mean > upper + 1e-9").count() == 0
    assert e.predict(f.slice(0, 1), 2).count() == 10
    e.save(spark, f"{tmp_path}/e")
    assert len(model.Ensemble.load(spark, f"{tmp_path}/e").members) == 3
    h = model.Hierarchical(model.GraphModel(), [1.0, 0.0, 0.0], 0.5).fit(f)
    assert h.predict(f.slice(0, 1), 2, "coarse").count() == 6
    fine = h.predict(f.slice(0, 1), 2)
    assert fine.count() == 10 and abs(max(q.f[0] for q in fine.where("h = 2").collect()) - 0.81) < 1e-3


def test_training_helpers(spark):
    w = training.linear_ramp(training.LossWeights(), training.LossWeights(reconstruction=0.0, forward=2.0), 3)
    assert w(0).reconstruction == 1 and w(1).forward == 1.0 and w(9).forward == 2.0
    s = training.EarlyStopping(2, 0.1)
    assert [s.stop(x) for x in (1.0, 0.95, 0.94)] == [False, False, True]
    assert training.monitor("auto", True) == "validation"
    h = training.History()
    h.add({"forward": 1.0})
    assert h.to_df(spark).count() == 1
    assert training.mean_terms([{"a": 1.0}, {"a": 3.0}]) == {"a": 2.0}


# --- sources --------------------------------------------------------------------------------------------


CASE = """function mpc = case3
mpc.baseMVA = 100;
mpc.bus = [ % number type ...
 10 3 50 20 0 0 1 1.02 -3.5 345;
 20 1 30 10 0 0 1 0.99 -5 345; % a comment; here
 30 1 0 0 0 0 1 1.0 0 345;
];
mpc.branch = [
 10 20 0.01 0.1 0 0 0 0 0 0 1;
 20 30 0.01 0.1 0 0 0 0 0 0 0;
 10 20 0.02 0.1 0 0 0 0 0 0 1;
];
"""


def test_power_case(spark, tmp_path):
    (tmp_path / "case.m").write_text(CASE)
    c = matpower.read(spark, f"{tmp_path}/case.m")
    assert c.base_mva.first().base == 100.0
    f = {r.node: r.f for r in matpower.features(c).collect()}
    assert f[0] == [1.02, -3.5, 0.5, 0.2] and len(f) == 3
    assert rows(matpower.edges(c), "src", "dst") == [(0, 1), (0, 1), (1, 0), (1, 0)]


def test_traffic_sources(spark, tmp_path):
    s = spark.createDataFrame([(0, t, x) for t, x in enumerate([float("nan"), 2.0, 0.0, 4.0])] + [(1, t, 0.0) for t in range(4)], "node int, t int, x double")
    got = {(r.node, r.t): r.x for r in traffic.clean(s).collect()}
    assert [got[0, t] for t in range(4)] == [2.0, 2.0, 2.0, 4.0] and got[1, 3] == 0.0
    z = traffic.zscore(traffic.clean(s)).where("node = 1").collect()
    assert all(r.x == 0 for r in z)
    (tmp_path / "ids.txt").write_text("a, b,c\n")
    (tmp_path / "d.csv").write_text("from,to,cost\na,b,1.0\nb,c,3.0\na,zz,1\n")
    ids = traffic.sensors(spark, f"{tmp_path}/ids.txt")
    assert rows(ids, "id", "node") == [("a", 0), ("b", 1), ("c", 2)]
    f = traffic.payload(traffic.window(s, 2, 1), ids, traffic.distances(spark, f"{tmp_path}/d.csv"))
    e = {(r.src, r.dst): r.w for r in f.edges.collect()}
    assert e[0, 1] == e[1, 0] == pytest.approx(math.exp(-1.0))
    traffic.save(f, f"{tmp_path}/cache")
    assert traffic.load(spark, f"{tmp_path}/cache").snap.count() == f.snap.count()


def test_simulators(spark):
    s = simulators.synthetic(spark, 4, 4, 1, "ring", initial="ones", decay=0.9)
    assert {round(r.f[0], 9) for r in s.snap.where("t = 3").collect()} == {round(0.9**3, 9)}
    g = simulators.grid(spark, 2, 2, 3, 1, noise=0.0, initial="ones")
    assert g.num_nodes == 4 and g.num_timesteps == 3
    a = simulators.advection(spark, 2, 3, 2, initial="ones")
    assert {round(r.f[0], 9) for r in a.snap.where("t = 1").collect()} == {1.0}
    t = simulators.trajectories(spark, [1, 2], 8, 5)
    assert t.count() == 80 and np.isfinite([r.f[0] for r in t.collect()]).all()
    assert simulators.trajectories(spark, [1], 16, 3, "kuramoto").count() == 48
    w = simulators.wake(spark, 12, 4)
    assert w.num_nodes == 12 and w.edges.count() >= 72
    e = simulators.small_world(10, 4, 0.3, 1)
    assert len(e) == 40 and all((b, a) in e for a, b in e)
    n = np.array([r.f[0] for r in simulators.nodes(spark, 4000, 1, seed=3).collect()])
    assert abs(n.mean()) < 0.1 and abs(n.std() - 1) < 0.1
    with pytest.raises(ValueError):
        simulators.advection_step(simulators.nodes(spark, 4, 1), 2, 2, decay=1.0)


def test_losses(spark):
    from nodalis.operators import losses

    f = decay(spark, 8)
    m = model.GraphModel().fit(f)
    t = losses.training_loss(m, f, training.LossWeights(1, 1, 1, 1, 1, 0, 1, 1, 1), 3, (0, 2), lambda x, p: V.sub(p, V.scale(x, 0.9)))
    assert all(t[k] < 1e-6 for k in ("reconstruction", "forward", "backward", "rollout", "worst_case", "pde")) and t["eigenvalue"] == 0
    assert t["total"] == pytest.approx(sum(v for k, v in t.items() if k != "total"))
    lie = losses.lie_consistency(lambda x: V.polynomial(x, 2), lambda x: V.scale(x, -0.5), np.diag([-0.5] * 3 + [-1.0] * 3), f)
    assert lie < 1e-8
    assert losses.mode_shapes(m, [0]).shape == (1, 3)
    with pytest.raises(ValueError):
        losses.rollout_loss(m, f, 8)
    g = latent.GraphOperator(latent.DiscreteOperator(2), latent.DiscreteOperator(2))
    assert losses.sparsity(g) > 0 and losses.sparsity(g, 0.5) > 0


def test_contracts_and_gaussian_intervals(spark):
    from nodalis.operators import contracts as C

    f = decay(spark, 8)
    m = model.GraphModel().fit(f)
    assert isinstance(m, C.Forecaster) and isinstance(m.operator, C.LatentOperator) and C.takes_only_data(m)
    assert not C.takes_only_data(fit.DMDc())
    assert C.similarity(m, m.spectrum()) == 0.0 and C.similarity_matrix([m, m]).shape == (2, 2)
    with pytest.raises(TypeError):
        C.resolve_spectrum(3)
    g = uncertainty.GaussianForecaster(m, samples=32)
    assert isinstance(g, C.IntervalForecaster)
    i = g.predict_interval(f.slice(0, 2), 2).collect()
    assert len(i) == 60 and all(r.lower <= r["mean"] + 0.2 and r["mean"] - 0.2 <= r.upper and r.lower < r.upper for r in i)


def test_named_benchmarks(spark, tmp_path):
    from nodalis.sources import benchmarks as B

    (tmp_path / "case.m").write_text(CASE)
    p = B.power_grid(spark, matpower.read(spark, f"{tmp_path}/case.m"), 3, ramp=True)
    got = {(r.t, r.node): r.f for r in p.snap.collect()}
    assert len(got) == 9 and got[1, 0][2] == pytest.approx(0.5 * (1 + 0.1 * math.sin(2 * math.pi * 2 / 24)))
    assert got[1, 2][0] == pytest.approx(0.98) and p.control_dim == 1
    e = B.epidemic_network(spark, 6, 3, controls=[0.0, 0.5, 0.0])
    assert all(abs(sum(r.f) - 1) < 1e-12 for r in e.snap.collect()) and e.num_timesteps == 3
    assert B.epidemic_network(spark, 10, 2, topology="small_world").edges.count() == 40
    assert B.chaotic_ring(spark, 8, 4, (0, 1)).validate().num_timesteps == 4
    assert B.flame_front(spark, 16, 3).num_nodes == 16


def test_dense_index_equals_a_global_sort(spark):
    from nodalis.functions.indexing import dense_index

    r = np.random.default_rng(4)
    keys = [int(k) for k in r.integers(-50, 50, 300)] + [2**60, 2**60 + 1, None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long").repartition(5)
    want = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    for buckets in (1, 7, 64):
        got = [q.i for q in dense_index(df, "k", ("i",), "n", buckets).orderBy("n").collect()]
        assert got == want
    assert dense_index(df.where("false"), "k", ("i",)).count() == 0


# --- constrained fits, forecasts and sources by their numbers -------------------------------


@pytest.mark.parametrize("kind", ["odo", "schur", "dissipative", "lyapunov"])
def test_constrained_operators_are_fitted_and_saved(spark, tmp_path, kind):
    r = np.random.default_rng(3)
    source = latent.DiscreteOperator(2, kind, 0.9, seed=5, scale=0.6)
    k = source.matrix()
    x = [r.normal(size=(6, 2))]
    for _ in range(8):
        x.append(x[-1] @ k.T)
    f = from_arrays(spark, [a.tolist() for a in x], [(0, 1), (1, 0)])
    m = model.GraphModel(penalty=1e-12, kind=kind, bound=0.9).fit(f)
    assert np.allclose(m.operator.matrix(), k, atol=1e-4)
    m.save(spark, f"{tmp_path}/{kind}")
    again = model.GraphModel.load(spark, f"{tmp_path}/{kind}")
    assert again.operator.kind == kind and np.allclose(again.operator.matrix(), m.operator.matrix(), atol=1e-15)
    assert again.operator.bound() <= 1


def test_a_growing_system_is_held_under_the_bound(spark):
    k = np.array([[1.1, 0.3], [-0.2, 0.9]])
    x = [np.random.default_rng(1).normal(size=(20, 2))]
    for _ in range(3):
        x.append(x[-1] @ k.T)
    f = from_arrays(spark, [a.tolist() for a in x], [(0, 1)])
    m = model.GraphModel(kind="schur", bound=0.8).fit(f)
    assert m.operator.spectral_radius() <= 0.8 + 1e-9
    pairs = np.concatenate(x[:-1]), np.concatenate(x[1:])
    loss = lambda a: ((pairs[1] - pairs[0] @ a.T) ** 2).sum()
    assert loss(m.operator.matrix()) < loss(0.8 * np.eye(2))
    c = model.GraphModel(dynamics="continuous", kind="schur", time_step=0.5).fit(f)
    assert c.operator.max_real() < 0


def test_dmd_forecasts_equal_matrix_powers(spark):
    r = np.random.default_rng(2)
    x, u = r.normal(size=(30, 3, 2)), r.normal(size=(30, 2))
    f = from_arrays(spark, x.tolist(), [(0, 1)], controls=u.tolist())
    flat = x.reshape(30, 6)
    plain = np.linalg.lstsq(flat[:-1], flat[1:], rcond=None)[0]
    got = {(g.origin, g.h, g.node): g.f for g in fit.DMD().fit(f).predict(f.snap, 3).collect()}
    assert len(got) == 30 * 3 * 3
    for (o, h, n), v in got.items():
        assert np.allclose(v, (flat[o] @ np.linalg.matrix_power(plain, h)).reshape(3, 2)[n], atol=1e-8)
    both = np.linalg.lstsq(np.c_[flat[:-1], u[:-1]], flat[1:], rcond=None)[0]
    push = [[0.5, -1.0], [1.0, 2.0]]
    got = {(g.origin, g.h, g.node): g.f for g in fit.DMDc().fit(f).predict(f.snap, 2, push).collect()}
    for o in (0, 7, 29):
        s = flat[o]
        for h, p in enumerate(push, 1):
            s = s @ both[:6] + np.array(p) @ both[6:]
            assert all(np.allclose(got[o, h, n], s.reshape(3, 2)[n], atol=1e-8) for n in range(3))


def test_sources_have_the_fixed_starts(spark):
    w = simulators.wake(spark, 12, 3, seed=4)
    z = [0.05 + 0.02j]
    for _ in range(2):
        z.append(z[-1] + 0.15 * ((0.15 + 0.8j) * z[-1] - abs(z[-1]) ** 2 * z[-1]))
    r, mesh = np.random.default_rng(4), []
    while len(mesh) < 12:
        x, y = r.uniform(-1.5, 8.5), r.uniform(-2.5, 2.5)
        if x * x + y * y > 0.25:
            mesh.append((x, y))
    gate = lambda v: 1 / (1 + math.exp(-v))
    for row in w.snap.collect():
        x, y = mesh[row.node]
        env = math.exp(-((y / 1.4) ** 2)) * gate(x + 0.5)
        want = -0.35 * math.exp(-((y / 1.2) ** 2)) * gate(x) + env * (z[row.t].real * math.sin(0.9 * x) + z[row.t].imag * math.cos(0.9 * x))
        assert math.isclose(row.f[0], want, abs_tol=1e-12)
    u = simulators.kuramoto_start(8, 22.0)
    assert np.allclose(u, [math.cos(math.pi * i / 4) * (1 + 0.1 * math.sin(22 * i / 8)) for i in range(8)])
    assert np.abs(simulators.kuramoto_start(64, 22.0, np.random.default_rng(0)) - np.cos(2 * np.pi * np.arange(64) / 64)).max() < 0.05


def test_row_wise_inverses_take_steps_back(spark):
    r = np.random.default_rng(7)
    rows = [(0, t, n, r.normal(size=2).tolist(), r.normal(size=2).tolist()) for t in range(3) for n in range(4)]
    df = spark.createDataFrame(rows, "traj int, t int, node int, f array<double>, u array<double>")
    for mode in ("additive", "bilinear"):
        c = latent.Control(2, mode, None, 2, r.normal(size=(2, 2)), 0.1 * r.normal(size=(2, 2, 2)) if mode == "bilinear" else None)
        for op, how in ((latent.DiscreteOperator(2, "odo", control=c), {}), (latent.ContinuousOperator(2, "schur", control=c), {"dt": 0.3})):
            there = latent.advance_rows(op, df, **how)
            back = {(x.t, x.node): x.f for x in latent.advance_rows(op, there, back=True, **how).collect()}
            assert all(np.allclose(back[t, n], f, atol=1e-9) for _, t, n, f, _ in rows)
    aux = latent.ContinuousOperator(2, "auxiliary_spectral", hidden=(3,), init="xavier")
    got = {(x.t, x.node): x.f for x in latent.advance_rows(aux, df, dt=0.2).collect()}
    assert all(np.allclose(got[t, n], aux.advance(np.array([f]), dt=0.2)[0]) for _, t, n, f, _ in rows)
