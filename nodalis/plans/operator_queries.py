"""Queries of latent operators, losses, filters and fits on the trade graph, and
the same in SQL: matrices of two rows written out."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators import estimation, fit, losses, metrics
from nodalis.operators.frames import Frames, multi, rollout_origins
from nodalis.operators.latent import ContinuousOperator, Control, DiscreteOperator, GraphOperator, advance_rows, eigenvalue_penalty, rollout, rollout_at
from nodalis.operators.model import GraphModel
from nodalis.plans.graph_queries import TRADE, USERS, _channel, query, r6
from nodalis.sources import matpower, tables

# --- the operators ------------------------------------------------------------------

Q1 = ((0.1, 0.4), (-0.2, 0.3))
Q2 = ((0.2, -0.5), (0.3, 0.1))
DIAG = (0.5, -0.8)
OFF = 0.25
LOW = ((-0.3, 0.0), (0.4, -1.1))
DENSE = ((0.9, 0.1), (-0.05, 0.8))
GENERATOR = ((-0.2, 0.7), (-0.4, -0.1))
RADIUS = 0.95
B = (0.3, -0.2), (0.1, 0.5)
N = ((0.05, 0.02), (-0.01, 0.03)), ((0.02, -0.04), (0.06, 0.01))
DECODE = ((1.0, 0.5), (0.0, 2.0))
STEP = 0.5
TIMES = (0.5, 1.25, 3.0)
KINDS = ("dense", "odo", "schur", "dissipative", "lyapunov")


def discrete(kind: str, control: Control | None = None) -> DiscreteOperator:
    return _set(DiscreteOperator(2, kind, RADIUS, control=control), DENSE)


def continuous(kind: str, control: Control | None = None) -> ContinuousOperator:
    return _set(ContinuousOperator(2, kind, RADIUS, control=control), GENERATOR)


def _set(op, dense):
    own = {"m": dense, "o1": Q1, "o2": Q2, "q": Q1, "diag": DIAG, "off": ((0.0, OFF), (0.0, 0.0)), "low": LOW, "p": (0.0, 0.0)}
    op.params = {k: np.array(own[k], float) for k in op.params}
    return op


def control(mode: str) -> Control:
    return Control(2, mode, None, 2, np.array(B), np.array(N) if mode == "bilinear" else None)


# --- the same as SQL expressions ------------------------------------------------------


def _num(m) -> tuple:
    return tuple(f"({float(v)!r})" for row in m for v in row)


def _mul(a, b) -> tuple:
    return tuple(f"({a[2 * i]} * {b[j]} + {a[2 * i + 1]} * {b[2 + j]})" for i in (0, 1) for j in (0, 1))


def _t(a) -> tuple:
    return a[0], a[2], a[1], a[3]


def _inv(a) -> tuple:
    det = f"({a[0]} * {a[3]} - {a[1]} * {a[2]})"
    return f"({a[3]} / {det})", f"(-{a[1]} / {det})", f"(-{a[2]} / {det})", f"({a[0]} / {det})"


def _exp(a, dt: str = "1.0") -> tuple:
    """exp(a dt) by its trace, determinant and discriminant."""
    a = tuple(f"({x} * {dt})" for x in a)
    m, q = f"(({a[0]} + {a[3]}) / 2)", f"(power(({a[0]} - {a[3]}) / 2, 2) + {a[1]} * {a[2]})"
    r = f"sqrt(abs({q}))"
    ch = f"(CASE WHEN {q} >= 0 THEN (exp({r}) + exp(-{r})) / 2 ELSE cos({r}) END)"
    sh = f"(CASE WHEN {q} > 1e-18 THEN (exp({r}) - exp(-{r})) / 2 / {r} WHEN {q} < -1e-18 THEN sin({r}) / {r} ELSE 1.0 END)"
    return f"exp({m}) * ({ch} + {sh} * ({a[0]} - {m}))", f"exp({m}) * {sh} * {a[1]}", f"exp({m}) * {sh} * {a[2]}", f"exp({m}) * ({ch} + {sh} * ({a[3]} - {m}))"


def _rotation(q) -> tuple:
    """The orthogonal matrix of the skew part's Cayley transform."""
    s = repr((q[0][1] - q[1][0]) / 2)
    c, d = f"((1 - {s} * {s}) / (1 + {s} * {s}))", f"(2 * {s} / (1 + {s} * {s}))"
    return c, d, f"(-{d})", c


def _diag(kind: str, steady: bool) -> tuple:
    if steady:
        return tuple(f"(-0.0001 - abs(tanh({x!r})) * ({RADIUS} - 0.0001))" for x in DIAG)
    return tuple(f"(tanh({x!r}) * {RADIUS if kind == 'odo' else RADIUS - 1e-4!r})" for x in DIAG)


def _loss() -> tuple:
    """L L' + 0.001 I with a positive diagonal of L."""
    a, d = (f"(ln(1 + exp({LOW[i][i]})) + 0.001)" for i in (0, 1))
    b = repr(LOW[1][0])
    return f"({a} * {a} + 0.001)", f"({a} * {b})", f"({a} * {b})", f"({b} * {b} + {d} * {d} + 0.001)"


def sql_matrix(kind: str, steady: bool = False) -> tuple:
    """A kind's matrix (a generator if ``steady``)."""
    d = _diag(kind, steady)
    if kind == "dense":
        return _num(GENERATOR if steady else DENSE)
    if kind == "odo":
        return _mul(_mul(_rotation(Q1), (d[0], "0.0", "0.0", d[1])), _t(_rotation(Q2)))
    if kind == "dissipative":
        minus = tuple(f"(-{x})" for x in _loss())
        return minus if steady else _exp(minus)
    q = _rotation(Q1)
    return _mul(_mul(q, (d[0], repr(OFF) if kind == "schur" else "0.0", "0.0", d[1])), _t(q))


def _cte(name: str, parts: dict) -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS kind, {m[0]} AS a, {m[1]} AS b, {m[2]} AS c, {m[3]} AS d" for k, m in parts.items())
    return f"{name} AS ({rows})"


APPLIED = "SELECT kind, t, node, round(a * x + b * y, 6) AS p, round(c * x + d * y, 6) AS q FROM s CROSS JOIN m"
STATES = "s AS (SELECT t, node, x, c / 10 AS y FROM snap)"
CONTROLS = "u AS (SELECT DISTINCT t, sin(t) AS u0, cos(t) AS u1 FROM snap)"


def states(spark, d) -> DataFrame:
    """(traj, t, node, f): value in millions and tens of orders."""
    return tables.trade(spark, d).snap.withColumn("f", F.array(F.col("f")[0], F.col("f")[1] / 10))


def controlled(spark, d) -> DataFrame:
    return states(spark, d).withColumn("u", F.array(F.sin("t"), F.cos("t")))


def _pair(df: DataFrame, *keys: str, f: Column | str = "f") -> DataFrame:
    c = V.col(f)
    return df.select(*keys, r6(c[0]).alias("p"), r6(c[1]).alias("q"))


def _kinds(parts) -> DataFrame:
    out = None
    for df in parts:
        out = df if out is None else out.unionByName(df)
    return out


# --- discrete operators ---------------------------------------------------------------


@query(f"WITH {TRADE}, {STATES}, {_cte('m', {k: sql_matrix(k) for k in KINDS})} {APPLIED}")
def discrete_steps(spark, d):
    z = states(spark, d)
    return _kinds(_pair(z.withColumn("f", discrete(k).column("f")).withColumn("kind", F.lit(k)), "kind", "t", "node") for k in KINDS)


@query(f"WITH {TRADE}, {STATES}, {_cte('m', {k: _inv(sql_matrix(k)) for k in KINDS})} {APPLIED}")
def discrete_inverses(spark, d):
    z = states(spark, d)
    return _kinds(_pair(z.withColumn("f", discrete(k).inverse_column("f")).withColumn("kind", F.lit(k)), "kind", "t", "node") for k in KINDS)


def _effective(mode: str) -> tuple:
    base = _num(DENSE)
    if mode == "additive":
        return base
    n = [_num(x) for x in N]
    return tuple(f"({base[i]} + u0 * {n[0][i]} + u1 * {n[1][i]})" for i in range(4))


PUSH = tuple(f"(u0 * {B[0][j]!r} + u1 * {B[1][j]!r})" for j in (0, 1))
MODES = ("additive", "bilinear")


def _both(of) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS kind, t, node, round({of(m)[0]}, 6) AS p, round({of(m)[1]}, 6) AS q FROM s JOIN u USING (t)" for m in MODES)


def _stepped(m: str) -> tuple:
    e = _effective(m)
    return f"{e[0]} * x + {e[1]} * y + {PUSH[0]}", f"{e[2]} * x + {e[3]} * y + {PUSH[1]}"


def _stepped_back(m: str) -> tuple:
    e = _inv(_effective(m))
    return tuple(f"{e[2 * i]} * (x - {PUSH[0]}) + {e[2 * i + 1]} * (y - {PUSH[1]})" for i in (0, 1))


@query(f"WITH {TRADE}, {STATES}, {CONTROLS} {_both(_stepped)}")
def controlled_steps(spark, d):
    z = controlled(spark, d)
    return _kinds(_pair(z.withColumn("f", discrete("dense", control(m)).column("f", "u")).withColumn("kind", F.lit(m)), "kind", "t", "node") for m in MODES)


@query(f"WITH {TRADE}, {STATES}, {CONTROLS} {_both(_stepped_back)}")
def controlled_inverses(spark, d):
    z = controlled(spark, d)
    return _kinds(_pair(advance_rows(discrete("dense", control(m)), z, back=True).withColumn("kind", F.lit(m)), "kind", "t", "node") for m in MODES)


def _rolled(h: int) -> tuple:
    """Decoded state after h steps with controls sin k, cos k of step k."""
    state = "x", "y"
    for k in range(h):
        e = tuple(x.replace("u0", repr(math.sin(k))).replace("u1", repr(math.cos(k))) for x in _effective("bilinear"))
        p = tuple(x.replace("u0", repr(math.sin(k))).replace("u1", repr(math.cos(k))) for x in PUSH)
        state = f"({e[0]} * {state[0]} + {e[1]} * {state[1]} + {p[0]})", f"({e[2]} * {state[0]} + {e[3]} * {state[1]} + {p[1]})"
    c = _num(DECODE)
    return f"{c[0]} * {state[0]} + {c[1]} * {state[1]}", f"{c[2]} * {state[0]} + {c[3]} * {state[1]}"


@query(f"WITH {TRADE}, {STATES} " + " UNION ALL ".join(f"SELECT t AS origin, {h} AS h, node, round({_rolled(h)[0]}, 6) AS p, round({_rolled(h)[1]}, 6) AS q FROM s" for h in (1, 2, 3)))
def latent_rollouts(spark, d):
    out = rollout(discrete("dense", control("bilinear")), states(spark, d), 3, [[math.sin(k), math.cos(k)] for k in range(3)], np.array(DECODE))
    return _pair(out, "origin", "h", "node")


# --- continuous operators ---------------------------------------------------------------


@query(f"WITH {TRADE}, {STATES}, {_cte('m', {k: _exp(sql_matrix(k, True), repr(STEP)) for k in KINDS})} {APPLIED}")
def generator_steps(spark, d):
    z = states(spark, d)
    return _kinds(_pair(z.withColumn("f", continuous(k).column("f", dt=STEP)).withColumn("kind", F.lit(k)), "kind", "t", "node") for k in KINDS)


@query(f"WITH {TRADE}, {STATES}, {_cte('m', {k: _inv(_exp(sql_matrix(k, True), repr(STEP))) for k in KINDS})} {APPLIED}")
def generator_inverses(spark, d):
    z = states(spark, d)
    return _kinds(_pair(advance_rows(continuous(k), z, dt=STEP, back=True).withColumn("kind", F.lit(k)), "kind", "t", "node") for k in KINDS)


def _van_loan() -> tuple:
    """F z + L^-1 (F - I) B' u."""
    f, inv = _exp(_num(GENERATOR), repr(STEP)), _inv(_num(GENERATOR))
    g = _mul(inv, (f"({f[0]} - 1)", f[1], f[2], f"({f[3]} - 1)"))
    return tuple(f"{f[2 * i]} * x + {f[2 * i + 1]} * y + {g[2 * i]} * {PUSH[0]} + {g[2 * i + 1]} * {PUSH[1]}" for i in (0, 1))


@query(f"WITH {TRADE}, {STATES}, {CONTROLS} SELECT t, node, round({_van_loan()[0]}, 6) AS p, round({_van_loan()[1]}, 6) AS q FROM s JOIN u USING (t)")
def van_loan_steps(spark, d):
    z = controlled(spark, d)
    return _pair(z.withColumn("f", continuous("dense", control("additive")).column("f", "u", STEP)), "t", "node")


@query(f"WITH {TRADE}, {STATES}, {_cte('m', {str(h): _exp(_num(GENERATOR), repr(t)) for h, t in enumerate(TIMES, 1)})} SELECT CAST(kind AS INTEGER) AS h, t AS origin, node, round(a * x + b * y, 6) AS p, round(c * x + d * y, 6) AS q FROM s CROSS JOIN m")
def irregular_forecast(spark, d):
    return _pair(rollout_at(continuous("dense"), states(spark, d), list(TIMES)), "h", "origin", "node")


NET = {"w0": ((0.3, -0.2), (0.1, 0.4)), "b0": (0.05, -0.1), "w1": ((0.5, 0.2), (-0.3, 0.6)), "b1": (-0.2, 0.1)}


def _layer(w, b, x) -> tuple:
    return tuple(f"({w[i][0]!r} * {x[0]} + {w[i][1]!r} * {x[1]} + {b[i]!r})" for i in (0, 1))


_HIDDEN = tuple(f"tanh({x})" for x in _layer(NET["w0"], NET["b0"], ("x", "y")))
_OUT = _layer(NET["w1"], NET["b1"], _HIDDEN)


@query(f"""WITH {TRADE}, {STATES}, move AS (SELECT t, node, x, y, exp({_OUT[0]} * {STEP}) AS e, (ln(1 + exp({_OUT[1]})) + 0.001) * {STEP} AS w FROM s)
SELECT t, node, round(e * (cos(w) * x - sin(w) * y), 6) AS p, round(e * (sin(w) * x + cos(w) * y), 6) AS q FROM move""")
def auxiliary_steps(spark, d):
    """Each row's own rotation and growth, from a small network of its state."""
    op = ContinuousOperator(2, "auxiliary_spectral", hidden=(2,))
    op.params = {k: np.array(v, float) for k, v in NET.items()}
    return _pair(advance_rows(op, states(spark, d), dt=STEP), "t", "node")


# --- graph operators, stability ---------------------------------------------------------

_OWN, _NBR = _num(DENSE), sql_matrix("lyapunov")


@query(f"""WITH {TRADE}, {STATES}, w AS (SELECT s.t, e.src AS node, sum(e.w * s.x) AS nx, sum(e.w * s.y) AS ny FROM s JOIN ahat e ON e.dst = s.node GROUP BY 1, 2)
SELECT s.t + 1 AS t, s.node, round({_OWN[0]} * x + {_OWN[1]} * y + {_NBR[0]} * nx + {_NBR[1]} * ny, 6) AS p, round({_OWN[2]} * x + {_OWN[3]} * y + {_NBR[2]} * nx + {_NBR[3]} * ny, 6) AS q
FROM s JOIN w ON w.t = s.t AND w.node = s.node""")
def graph_operator_steps(spark, d):
    from nodalis.operators.topology import normalized_adjacency

    return _pair(GraphOperator(discrete("dense"), discrete("lyapunov")).step(states(spark, d), normalized_adjacency(tables.trade(spark, d).edges)), "t", "node")


def _radius(a) -> str:
    h, q = f"(({a[0]} + {a[3]}) / 2)", f"(power(({a[0]} - {a[3]}) / 2, 2) + {a[1]} * {a[2]})"
    return f"CASE WHEN {q} >= 0 THEN greatest(abs({h} + sqrt(abs({q}))), abs({h} - sqrt(abs({q})))) ELSE sqrt({h} * {h} - {q}) END"


def _growth(a) -> str:
    h, q = f"(({a[0]} + {a[3]}) / 2)", f"(power(({a[0]} - {a[3]}) / 2, 2) + {a[1]} * {a[2]})"
    return f"CASE WHEN {q} >= 0 THEN {h} + sqrt(abs({q})) ELSE {h} END"


def _bound(kind: str, steady: bool) -> str:
    d = _diag(kind, steady)
    if kind in ("dense", "dissipative"):
        return (_growth if steady else _radius)(sql_matrix(kind, steady))
    return f"greatest({d[0]}, {d[1]})" if steady else f"greatest(abs({d[0]}), abs({d[1]}))"


def _stability(kind: str, steady: bool) -> str:
    m, b = sql_matrix(kind, steady), _bound(kind, steady)
    margin = "CAST(NULL AS DOUBLE)" if kind in ("dense", "odo") else f"round(-({b}), 6)" if steady else f"round(1 - ({b}), 6)"
    over = "0.0" if kind == "dissipative" else f"power(greatest({b}{'' if steady else ' - 1'}, 0), 2)"
    return f"SELECT '{kind}' AS kind, {steady} AS steady, round({(_growth if steady else _radius)(m)}, 6) AS radius, round({b}, 6) AS bound, {margin} AS margin, {over if kind not in ('dense', 'odo') else '0.0'} AS penalty"


@query(" UNION ALL ".join(_stability(k, s) for s in (False, True) for k in KINDS))
def operator_stability(spark, d):
    """Spectral radius or growth, bound, certificate and eigenvalue penalty of each kind."""
    rows = []
    for steady in (False, True):
        for k in KINDS:
            op = (continuous if steady else discrete)(k)
            c = op.certificate()
            rows.append((k, steady, op.spectral_radius(), op.bound(), None if c is None else float(c.margin), float(eigenvalue_penalty(op))))
    return spark.createDataFrame(rows, "kind string, steady boolean, radius double, bound double, margin double, penalty double").select("kind", "steady", r6("radius").alias("radius"), r6("bound").alias("bound"), r6("margin").alias("margin"), "penalty")


# --- losses -----------------------------------------------------------------------------

_K, _KI = _num(DENSE), _inv(_num(DENSE))
_POWERS = {1: _K, 2: _mul(_K, _K), 3: _mul(_K, _mul(_K, _K))}


def _squared(m, x: str, y: str, to_x: str, to_y: str) -> str:
    return f"(power({m[0]} * {x} + {m[1]} * {y} - {to_x}, 2) + power({m[2]} * {x} + {m[3]} * {y} - {to_y}, 2)) / 2"


LIE_K = GENERATOR


@query(f"""WITH {TRADE}, {STATES}, p AS (SELECT a.t, a.node, a.x, a.y, b.x AS nx, b.y AS ny FROM s a JOIN s b ON b.node = a.node AND b.t = a.t + 1),
roll AS (SELECT a.t, b.t - a.t AS h, avg(CASE b.t - a.t WHEN 1 THEN {_squared(_POWERS[1], 'a.x', 'a.y', 'b.x', 'b.y')} WHEN 2 THEN {_squared(_POWERS[2], 'a.x', 'a.y', 'b.x', 'b.y')} ELSE {_squared(_POWERS[3], 'a.x', 'a.y', 'b.x', 'b.y')} END) AS e
         FROM s a JOIN s b ON b.node = a.node AND b.t BETWEEN a.t + 1 AND a.t + 3 WHERE a.t IN (0, 5) GROUP BY 1, 2)
SELECT 'reconstruction' AS term, round(avg({_squared(_K, 'x', 'y', 'nx', 'ny')}), 5) AS loss FROM p
UNION ALL SELECT 'forward', round(avg({_squared(_K, 'x', 'y', 'nx', 'ny')}), 5) FROM p
UNION ALL SELECT 'backward', round(avg({_squared(_KI, 'nx', 'ny', 'x', 'y')}), 5) FROM p
UNION ALL SELECT 'rollout', round(avg(e), 5) FROM (SELECT t, avg(e) AS e FROM roll GROUP BY 1) r
UNION ALL SELECT 'worst_case', round(avg(e), 5) FROM (SELECT t, max({_squared(_K, 'x', 'y', 'nx', 'ny')}) AS e FROM p GROUP BY 1) w
UNION ALL SELECT 'pde', round(avg((power({_K[0]} * x + {_K[1]} * y - 0.9 * x, 2) + power({_K[2]} * x + {_K[3]} * y - 0.9 * y, 2)) / 2), 5) FROM s
UNION ALL SELECT 'sparsity', round((abs({_K[0]}) + abs({_K[1]}) + abs({_K[2]}) + abs({_K[3]})) / 4, 5)
UNION ALL SELECT 'lie', round(avg((power(-0.5 * x - ({LIE_K[0][0]} * x + {LIE_K[0][1]} * y), 2) + power(-0.25 * y - ({LIE_K[1][0]} * x + {LIE_K[1][1]} * y), 2)) / 2), 5) FROM s""")
def loss_terms(spark, d):
    """All terms of the objective for a fixed operator that acts on the features themselves."""
    f = Frames(states(spark, d), tables.trade(spark, d).edges)
    m = GraphModel()
    m.operator, m.decoder = discrete("dense"), np.eye(2)
    got = {
        "reconstruction": losses.reconstruction(m, f),
        "forward": losses.forward_consistency(m, f),
        "backward": losses.backward_consistency(m, f),
        "rollout": losses.rollout_loss(m, f, 3, (0, 5)),
        "worst_case": losses.worst_case(m, f),
        "pde": losses.pde_residual(m, f, lambda x, y: V.sub(y, V.scale(x, 0.9))),
        "sparsity": losses.sparsity(m.operator),
        "lie": losses.lie_consistency(lambda x: x, lambda x: V.mul(x, F.array(F.lit(-0.5), F.lit(-0.25))), np.array(LIE_K), f),
    }
    return spark.createDataFrame([(k, round(v, 9)) for k, v in got.items()], "term string, loss double").select("term", F.round("loss", 5).alias("loss"))


# --- sequences --------------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT t, node, round(x, 6) AS x, c FROM snap WHERE t BETWEEN 10 AND 13")
def time_slice(spark, d):
    return tables.trade(spark, d).slice(10, 14).snap.select("t", "node", r6(F.col("f")[0]).alias("x"), F.col("f")[1].alias("c"))


@query(f"WITH {TRADE} SELECT 0 AS traj, CAST(count(*) AS BIGINT) AS n, round(sum(x), 4) AS x, sum(c) AS c FROM snap WHERE t < 20 UNION ALL SELECT 1, CAST(count(*) AS BIGINT), round(sum(x), 4), sum(c) FROM snap WHERE t >= 20 AND t < 50")
def two_trajectories(spark, d):
    f = tables.trade(spark, d)
    both = multi([f.slice(0, 20), f.slice(20, 50)])
    return both.snap.groupBy("traj").agg(F.count("*").alias("n"), F.round(F.sum(F.col("f")[0]), 4).alias("x"), F.sum(F.col("f")[1]).alias("c"))


@query(f"WITH {TRADE}, steps AS (SELECT count(DISTINCT t) AS n FROM snap) SELECT CAST(t AS INTEGER) AS origin FROM (SELECT DISTINCT t FROM snap) q, steps WHERE t < n - 6")
def forecast_origins(spark, d):
    f = tables.trade(spark, d)
    return spark.createDataFrame([(i,) for i in rollout_origins(f.num_timesteps, 6, "all")], "origin int")


CASE = """
mpc.baseMVA = 100;
mpc.bus = [ % number, type, loads, ...
 7 3 50 10 0 0 1 1.02 -3.5 230 1 1.1 0.9;
 3 1 20 5 0 0 1 0.99 -7.25 230 1 1.1 0.9;
 9 2 0 0 0 0 1 1.01 1.5 230 1 1.1 0.9;
];
mpc.branch = [
 7 3 0.01 0.1 0 0 0 0 0 0 1 -360 360;
 3 9 0.02 0.2 0 0 0 0 0 0 1 -360 360;
 9 7 0.02 0.2 0 0 0 0 0 0 0 -360 360;
];
"""


@query("""SELECT part, a, b, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM (
SELECT 'node' AS part, 0 AS a, 0 AS b, 1.02 AS x, -3.5 AS y, 0.5 AS p, 0.1 AS q UNION ALL SELECT 'node', 1, 1, 0.99, -7.25, 0.2, 0.05 UNION ALL SELECT 'node', 2, 2, 1.01, 1.5, 0.0, 0.0
UNION ALL SELECT 'edge', 0, 1, NULL, NULL, NULL, NULL UNION ALL SELECT 'edge', 1, 0, NULL, NULL, NULL, NULL UNION ALL SELECT 'edge', 1, 2, NULL, NULL, NULL, NULL UNION ALL SELECT 'edge', 2, 1, NULL, NULL, NULL, NULL) rows""")
def power_grid_case(spark, d):
    case = matpower.parse(spark.createDataFrame([(CASE,)], "value string"))
    n = matpower.features(case).select(F.lit("node").alias("part"), F.col("node").cast("int").alias("a"), F.col("node").cast("int").alias("b"), *[F.col("f")[i].alias(x) for i, x in enumerate("xypq")])
    none = F.lit(None).cast("double")
    return n.unionByName(matpower.edges(case).select(F.lit("edge").alias("part"), F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b"), *[none.alias(x) for x in "xypq"]))


# --- fits --------------------------------------------------------------------------------

TOTAL = "tot AS (SELECT t, sum(x) AS x FROM snap GROUP BY 1)"


def total(spark, d) -> Frames:
    """All nations as one node."""
    f = tables.trade(spark, d)
    snap = f.snap.groupBy("traj", "t").agg(F.sum(F.col("f")[0]).alias("x")).select("traj", "t", F.lit(0).alias("node"), F.array("x").alias("f"))
    return Frames(snap, f.edges.where("false"))


@query(f"""WITH {TRADE}, {TOTAL}, k AS (SELECT sum(a.x * b.x) / sum(a.x * a.x) AS k FROM tot a JOIN tot b ON b.t = a.t + 1)
SELECT t AS origin, h, round(power(k, h) * x, 6) AS x FROM tot CROSS JOIN k CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) q""")
def total_dmd(spark, d):
    f = total(spark, d)
    return fit.DMD().fit(f).predict(f.snap, 3).select("origin", "h", r6(F.col("f")[0]).alias("x"))


@query(f"""WITH {TRADE}, {TOTAL}, p AS (SELECT a.x, a.t / 10.0 AS u, b.x AS y FROM tot a JOIN tot b ON b.t = a.t + 1),
sums AS (SELECT sum(x * x) AS xx, sum(x * u) AS xu, sum(u * u) AS uu, sum(x * y) AS xy, sum(u * y) AS uy FROM p)
SELECT round((xy * uu - uy * xu) / (xx * uu - xu * xu), 6) AS k, round((uy * xx - xy * xu) / (xx * uu - xu * xu), 6) AS b FROM sums""")
def total_controlled_dmd(spark, d):
    f = total(spark, d)
    u = f.snap.select("traj", "t", F.lit(None).cast("int").alias("node"), F.array(F.col("t") / 10.0).alias("u"))
    m = fit.DMDc().fit(Frames(f.snap, f.edges, u))
    return spark.createDataFrame([(float(m.operator[0, 0]), float(m.control[0, 0]))], "k double, b double").select(r6("k").alias("k"), r6("b").alias("b"))


@query(f"""WITH {TRADE}, {TOTAL}, n AS (SELECT t, x / 40 AS x FROM tot), p AS (SELECT a.x, a.x * a.x AS z, b.x AS y, b.x * b.x AS w FROM n a JOIN n b ON b.t = a.t + 1),
sums AS (SELECT sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS d, sum(x * y) AS xy, sum(z * y) AS zy, sum(x * w) AS xw, sum(z * w) AS zw FROM p),
k AS (SELECT (xy * d - zy * b) / (a * d - b * b) AS k00, (zy * a - xy * b) / (a * d - b * b) AS k01, (xw * d - zw * b) / (a * d - b * b) AS k10, (zw * a - xw * b) / (a * d - b * b) AS k11 FROM sums)
SELECT t AS origin, round(k00 * x + k01 * x * x, 5) AS x FROM n CROSS JOIN k""")
def total_edmd(spark, d):
    """One step in the dictionary of a value and its square, back to the value."""
    f = total(spark, d)
    f = f.with_features(f.snap.withColumn("f", V.scale("f", 1 / 40)))
    return fit.EDMD().fit(f).predict(f.snap, 1).select("origin", F.round(F.col("f")[0], 5).alias("x"))


# --- estimation -----------------------------------------------------------------------------


def _filter(rows: str, k: float, q: float, r: float) -> str:
    """Recursive SQL: kf (node, i, seen, y, m, v, pm, pv), filtered and predicted
    means and variances, of rows (node, i, t, y, seen)."""
    return f"""o AS ({rows}),
kf AS (SELECT node, i, t, seen, y, CASE WHEN seen THEN y ELSE 0.0 END AS m, CASE WHEN seen THEN {r} / (1 + {r}) ELSE 1.0 END AS v, CASE WHEN seen THEN y ELSE 0.0 END AS pm, CAST(1.0 AS DOUBLE) AS pv FROM o WHERE i = 1
UNION ALL SELECT o.node, o.i, o.t, o.seen, o.y,
  CASE WHEN o.seen THEN {k} * m + ({k} * {k} * v + {q}) / ({k} * {k} * v + {q} + {r}) * (o.y - {k} * m) ELSE {k} * m END,
  CASE WHEN o.seen THEN ({k} * {k} * v + {q}) * {r} / ({k} * {k} * v + {q} + {r}) ELSE {k} * {k} * v + {q} END,
  {k} * m, {k} * {k} * v + {q} FROM kf JOIN o ON o.node = kf.node AND o.i = kf.i + 1)"""


def _smoother(k: float) -> str:
    return f""", ks AS (SELECT kf.* , m AS sm, v AS sv FROM kf JOIN (SELECT node AS n2, max(i) AS last FROM o GROUP BY 1) l ON n2 = node AND i = last
UNION ALL SELECT kf.*, kf.m + kf.v * {k} / ks.pv * (ks.sm - ks.pm), kf.v + power(kf.v * {k} / ks.pv, 2) * (ks.sv - ks.pv) FROM ks JOIN kf ON kf.node = ks.node AND kf.i = ks.i - 1)"""


_SEEN = "SELECT node, row_number() OVER (PARTITION BY node ORDER BY t) AS i, t, x AS y, TRUE AS seen FROM snap"
_USERS = "SELECT node, row_number() OVER (PARTITION BY node ORDER BY t) AS i, t, s AS y, observed AS seen FROM grid"


@query(f"WITH RECURSIVE {TRADE}, {_filter(_SEEN, 0.95, 0.01, 0.1)} SELECT t, node, round(m, 6) AS x, round(v, 6) AS v FROM kf")
def kalman_filter(spark, d):
    return estimation.Observer([[0.95]], 0.01, 0.1).filter(_channel(tables.trade(spark, d))).select("t", "node", r6(F.col("f")[0]).alias("x"), r6(F.col("var")[0]).alias("v"))


@query(f"WITH RECURSIVE {TRADE}, {_filter(_SEEN, 0.95, 0.01, 0.1)}{_smoother(0.95)} SELECT t, node, round(sm, 6) AS x, round(sv, 6) AS v FROM ks")
def kalman_smooth(spark, d):
    return estimation.Observer([[0.95]], 0.01, 0.1).smooth(_channel(tables.trade(spark, d))).select("t", "node", r6(F.col("f")[0]).alias("x"), r6(F.col("var")[0]).alias("v"))


@query(f"WITH RECURSIVE {USERS}, {_filter(_USERS, 0.9, 1.0, 0.1)}{_smoother(0.9)} SELECT t, node, round(CASE WHEN seen THEN y ELSE sm END, 5) AS x FROM ks")
def kalman_impute(spark, d):
    return estimation.Observer([[0.9]], 1.0, 0.1).impute(_channel(tables.users(spark, d))).select("t", "node", F.round(F.col("f")[0], 5).alias("x"))


@query(f"""WITH {TRADE}, {STATES}, p AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny, row_number() OVER (ORDER BY a.t, a.node) AS i, count(*) OVER () AS n FROM s a JOIN s b ON b.node = a.node AND b.t = a.t + 1),
w AS (SELECT *, power(0.99, n - i) AS f FROM p),
sums AS (SELECT sum(f * x * x) + power(0.99, any_value(n)) / 1000 AS a, sum(f * x * y) AS b, sum(f * y * y) + power(0.99, any_value(n)) / 1000 AS d,
      sum(f * x * nx) + power(0.99, any_value(n)) / 1000 AS p, sum(f * y * nx) AS q, sum(f * x * ny) AS r, sum(f * y * ny) + power(0.99, any_value(n)) / 1000 AS s FROM w)
SELECT 0 AS i, 0 AS j, round((p * d - q * b) / (a * d - b * b), 6) AS v FROM sums UNION ALL SELECT 0, 1, round((q * a - p * b) / (a * d - b * b), 6) FROM sums
UNION ALL SELECT 1, 0, round((r * d - s * b) / (a * d - b * b), 6) FROM sums UNION ALL SELECT 1, 1, round((s * a - r * b) / (a * d - b * b), 6) FROM sums""")
def recursive_fit(spark, d):
    f = Frames(states(spark, d), tables.trade(spark, d).edges)
    return estimation.recursive_fit(f, 0.99).select("i", "j", r6("v").alias("v"))


@query(f"""WITH {TRADE}, {STATES}, p AS (SELECT a.node, a.x, a.y, b.x AS nx, b.y AS ny FROM s a JOIN s b ON b.node = a.node AND b.t = a.t + 1),
sums AS (SELECT node, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d, sum(x * nx) AS p, sum(y * nx) AS q, sum(x * ny) AS r, sum(y * ny) AS s FROM p GROUP BY 1),
k AS (SELECT node, (p * d - q * b) / (a * d - b * b) AS k00, (q * a - p * b) / (a * d - b * b) AS k01, (r * d - s * b) / (a * d - b * b) AS k10, (s * a - r * b) / (a * d - b * b) AS k11 FROM sums),
e AS (SELECT node, (k00 + k11) / 2 AS h, power((k00 - k11) / 2, 2) + k01 * k10 AS q FROM k)
SELECT node, round(CASE WHEN q >= 0 THEN h + CASE WHEN h >= 0 THEN sqrt(abs(q)) ELSE -sqrt(abs(q)) END ELSE h END, 5) AS re, round(CASE WHEN q >= 0 THEN 0 ELSE sqrt(abs(q)) END, 5) AS im,
  round(CASE WHEN q >= 0 THEN abs(h) + sqrt(abs(q)) ELSE sqrt(h * h - q) END, 5) AS magnitude FROM e""")
def node_spectra(spark, d):
    """The leading mode of each nation's own operator."""
    f = Frames(states(spark, d), tables.trade(spark, d).edges)
    return estimation.node_dmd(f).where("mode = 0").select("node", F.round("re", 5).alias("re"), F.round(F.abs("im"), 5).alias("im"), F.round("magnitude", 5).alias("magnitude"))


@query(f"""WITH RECURSIVE {TRADE}, {_filter(_SEEN, 0.95, 0.01, 0.1)}
SELECT t AS origin, h, node, round(power(0.95, h) * m, 6) AS x, round(power(0.95, 2 * h) * v + 0.01 * (1 - power(0.95, 2 * h)) / (1 - 0.95 * 0.95), 6) AS v FROM kf CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) q""")
def forecast_variances(spark, d):
    """Gaussian forecasts from filtered states."""
    kf = estimation.Observer([[0.95]], 0.01, 0.1).filter(_channel(tables.trade(spark, d)))
    return estimation.forecast_variance(kf, np.array([[0.95]]), 0.01, 3).select("origin", "h", "node", r6(F.col("f")[0]).alias("x"), r6(F.col("var")[0]).alias("v"))


@query(f"""WITH {TRADE}, {STATES}, q AS (SELECT t, node, {_K[0]} * x + {_K[1]} * y AS p, {_K[2]} * x + {_K[3]} * y AS q FROM s), e AS (SELECT q.t, q.node, q.p - s.x AS a, q.q - s.y AS b FROM q JOIN s ON s.node = q.node AND s.t = q.t + 1),
per AS (SELECT t, avg((abs(a) + abs(b)) / 2) AS mae, sqrt(avg((a * a + b * b) / 2)) AS rmse FROM e GROUP BY 1),
r AS (SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse FROM per)
SELECT CAST(1 AS INTEGER) AS horizon, mae, rmse FROM r UNION ALL SELECT NULL, mae, rmse FROM r""")
def operator_errors(spark, d):
    f = Frames(states(spark, d), tables.trade(spark, d).edges)
    pred = rollout(discrete("dense"), f.snap, 1)
    return metrics.evaluate(pred, f, (1,)).select(F.col("horizon").cast("int").alias("horizon"), r6("mae").alias("mae"), r6("rmse").alias("rmse"))

