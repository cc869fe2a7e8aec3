"""Latent linear operators: discrete, continuous and graph-coupled.

States are rows: z' = z K^T + u B + sum_i u_i z N_i^T.  An operator holds small
NumPy parameters; ``advance`` works on arrays, ``column`` gives the same step as
a Column, so tables advance inside the JVM and only d x d numbers leave the
driver (as literals of the plan).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.functions.linalg import cayley, expm, inverse, logm, safe_reciprocal, softplus, strict, van_loan
from nodalis.operators.spectrum import Spectrum, compute_spectrum, generator_spectrum, spectrum_at

# Fixed values of the parameterizations: margin under a bound, least eigenvalue of a
# dissipative factor, least diagonal of a certificate, least frequency, noise of the
# identity start.
MARGIN = 1e-4
LEAST_DISSIPATION = 1e-3
LEAST_CERTIFICATE = 1e-6
LEAST_FREQUENCY = 1e-3
INIT_NOISE = 1e-2

DISCRETE = ("dense", "odo", "schur", "dissipative", "lyapunov")
CONTINUOUS = (*DISCRETE, "auxiliary_spectral")
INITS = ("identity", "identity_noise", "xavier")


@dataclass(frozen=True)
class Certificate:
    """A positive margin proves stability; the matrix, if any, is its Lyapunov form."""

    margin: float
    matrix: np.ndarray | None = None


def _triangular(diag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.triu(off, 1) + np.diag(diag)


def _dissipation(lower: np.ndarray) -> np.ndarray:
    """L L' + least I with a positive diagonal of L."""
    low = np.tril(lower, -1) + np.diag(softplus(np.diag(lower)) + LEAST_DISSIPATION)
    return low @ low.T + LEAST_DISSIPATION * np.eye(len(low))


@dataclass
class Control:
    """Additive (B) or bilinear (N, or low-rank factors P, Q) control."""

    dim: int = 0
    mode: str = "additive"
    rank: int | None = None
    latent: int = 0
    b: np.ndarray | None = None
    n: np.ndarray | None = None
    p: np.ndarray | None = None
    q: np.ndarray | None = None

    def __post_init__(self):
        if self.mode not in ("additive", "bilinear"):
            raise ValueError(f"unknown control mode {self.mode!r}")
        if self.mode == "bilinear" and self.dim < 1:
            raise ValueError("bilinear control needs a control dimension")
        if self.rank is not None and (self.mode != "bilinear" or not 1 <= self.rank <= self.latent):
            raise ValueError("the bilinear rank must lie in 1 .. latent dimension")
        if self.dim and self.b is None:
            self.b = np.zeros((self.dim, self.latent))
        if self.mode == "bilinear":
            if self.rank is None and self.n is None:
                self.n = np.zeros((self.dim, self.latent, self.latent))
            if self.rank is not None and self.p is None:
                self.p, self.q = np.zeros((self.dim, self.latent, self.rank)), np.zeros((self.dim, self.latent, self.rank))

    def coupling(self) -> np.ndarray | None:
        """(U, d, d) state-control coupling."""
        if self.mode != "bilinear":
            return None
        return self.n if self.rank is None else np.einsum("udr,uer->ude", self.p, self.q)

    def check(self, u) -> None:
        if (u is None) != (self.dim == 0):
            raise ValueError("a control is needed exactly when the operator has a control dimension")

    def effective(self, base: np.ndarray, u: np.ndarray) -> np.ndarray:
        """base + sum u_i N_i; one matrix for each row of a two-dimensional u."""
        c = self.coupling()
        return base if c is None else base + np.einsum("...u,ude->...de", np.asarray(u, float), c)


class DiscreteOperator:
    """K in one of five parameterizations."""

    kinds = DISCRETE

    def __init__(self, dim: int, kind: str = "dense", radius: float = 1.0, init: str = "identity_noise", scale: float = INIT_NOISE, control: Control | None = None, seed: int = 0):
        if dim < 1 or kind not in self.kinds or init not in INITS:
            raise ValueError(f"bad dimension, parameterization or init: {dim}, {kind}, {init}")
        self.dim, self.kind, self.radius = dim, kind, radius
        self.control = control or Control(latent=dim)
        self.params = self._start(np.random.default_rng(seed), init, scale)

    def _identity_diag(self) -> float:
        bound = strict(self.radius) if self.kind != "odo" else self.radius
        return float(np.arctanh(min(min(1.0, bound) * (1 - 1e-6) / bound, 1 - 1e-12)))

    def _start(self, r, init: str, scale: float) -> dict[str, np.ndarray]:
        d = self.dim
        noise = (lambda *s: scale * r.normal(size=s)) if init == "identity_noise" else (lambda *s: np.zeros(s))
        if init == "xavier":
            noise = lambda *s: r.uniform(-1, 1, s) * np.sqrt(6 / (2 * d))
        base = 0.0 if init == "xavier" else self._identity_diag()
        if self.kind == "dense":
            return {"m": (0 if init == "xavier" else np.eye(d)) + noise(d, d)}
        if self.kind == "odo":
            return {"o1": noise(d, d), "o2": noise(d, d), "diag": base + noise(d)}
        if self.kind == "schur":
            return {"q": noise(d, d), "diag": base + noise(d), "off": np.zeros((d, d))}
        if self.kind == "dissipative":
            return {"low": noise(d, d) - 4 * np.eye(d) * (init != "xavier")}
        return {"q": noise(d, d), "diag": base + noise(d), "p": np.zeros(d)}

    # --- matrices ---------------------------------------------------------

    def diagonal(self) -> np.ndarray:
        bound = self.radius if self.kind == "odo" else strict(self.radius)
        return np.tanh(self.params["diag"]) * bound

    def matrix(self) -> np.ndarray:
        p = self.params
        if self.kind == "dense":
            return p["m"]
        if self.kind == "odo":
            return cayley(p["o1"]) @ np.diag(self.diagonal()) @ cayley(p["o2"]).T
        if self.kind == "schur":
            q = cayley(p["q"])
            return q @ _triangular(self.diagonal(), p["off"]) @ q.T
        if self.kind == "dissipative":
            return expm(-_dissipation(p["low"]))
        q = cayley(p["q"])
        return q @ np.diag(self.diagonal()) @ q.T

    def inverse_matrix(self) -> np.ndarray:
        p = self.params
        if self.kind == "odo":
            return cayley(p["o2"]) @ np.diag(safe_reciprocal(self.diagonal())) @ cayley(p["o1"]).T
        if self.kind == "schur":
            q = cayley(p["q"])
            return q @ inverse(_triangular(self.diagonal(), p["off"])) @ q.T
        if self.kind == "dissipative":
            return expm(_dissipation(p["low"]))
        if self.kind == "lyapunov":
            q = cayley(p["q"])
            return q @ np.diag(safe_reciprocal(self.diagonal())) @ q.T
        return inverse(p["m"])

    def set_dense(self, m: np.ndarray, b: np.ndarray | None = None, n: np.ndarray | None = None) -> None:
        if self.kind != "dense":
            raise ValueError("only a dense operator can be set")
        if np.shape(m) != (self.dim, self.dim):
            raise ValueError("the matrix has another shape")
        self.params["m"] = np.array(m, float)
        if b is not None:
            self.control.b = np.array(b, float).reshape(self.control.dim, self.dim)
        if n is not None:
            self.control.n = np.array(n, float).reshape(self.control.dim, self.dim, self.dim)

    # --- stability --------------------------------------------------------

    def spectral_radius(self) -> float:
        return float(np.abs(np.linalg.eigvals(self.matrix())).max())

    def bound(self) -> float:
        if self.kind == "dense":
            return self.spectral_radius()
        if self.kind == "dissipative":
            return float(np.exp(-np.linalg.eigvalsh(_dissipation(self.params["low"])).min()))
        return float(np.abs(self.diagonal()).max())

    def certificate(self) -> Certificate | None:
        if self.kind in ("dense", "odo"):
            return None
        m = None
        if self.kind == "lyapunov":
            q = cayley(self.params["q"])
            m = q @ np.diag(softplus(self.params["p"]) + LEAST_CERTIFICATE) @ q.T
        return Certificate(1 - self.bound(), m)

    def spectrum(self, time_step: float = 1.0) -> Spectrum:
        return compute_spectrum(self.matrix(), time_step)

    # --- steps ------------------------------------------------------------

    def advance(self, z: np.ndarray, u=None) -> np.ndarray:
        self.control.check(u)
        k = self.matrix()
        if u is None:
            return z @ k.T
        u = np.asarray(u, float)
        e = self.control.effective(k, u)
        out = z @ e.T if e.ndim == 2 else np.einsum("nd,ned->ne", z, e)
        return out + u @ self.control.b

    def inverse_step(self, z: np.ndarray, u=None) -> np.ndarray:
        self.control.check(u)
        if u is None:
            return z @ self.inverse_matrix().T
        u = np.asarray(u, float)
        y = z - u @ self.control.b
        e = self.control.effective(self.matrix(), u)
        if self.control.mode == "additive":
            return y @ self.inverse_matrix().T
        return y @ inverse(e).T if e.ndim == 2 else np.stack([a @ inverse(m).T for a, m in zip(y, e, strict=True)])

    def column(self, z: Column | str, u: Column | str | None = None) -> Column:
        """The step as a Column; u is a column of arrays."""
        self.control.check(u)
        out = V.matvec(self.matrix(), z)
        if u is None:
            return out
        uc = V.col(u)
        out = V.add(out, V.matvec(self.control.b.T, uc))
        c = self.control.coupling()
        if c is not None:
            for i in range(self.control.dim):
                out = V.add(out, V.scale(V.matvec(c[i], z), F.get(uc, F.lit(i))))
        return out

    def inverse_column(self, z: Column | str, u: Column | str | None = None) -> Column:
        self.control.check(u)
        if self.control.mode == "bilinear":
            raise ValueError("a bilinear inverse depends on each row's control: use advance_rows(.., back=True)")
        y = V.col(z) if u is None else V.sub(z, V.matvec(self.control.b.T, u))
        return V.matvec(self.inverse_matrix(), y)


class ContinuousOperator(DiscreteOperator):
    """A generator L in one of six parameterizations; steps are exp(L dt)."""

    kinds = CONTINUOUS

    def __init__(self, dim: int, kind: str = "dense", bound: float = 0.0, init: str = "identity_noise", scale: float = INIT_NOISE, control: Control | None = None, seed: int = 0, hidden: tuple[int, ...] = (64, 64)):
        self.hidden = hidden
        if not hidden or min(hidden) < 1:
            raise ValueError("hidden sizes must be positive")
        super().__init__(dim, kind, bound or 1.0, init, scale, control, seed)

    def _start(self, r, init: str, scale: float) -> dict[str, np.ndarray]:
        d = self.dim
        noise = (lambda *s: scale * r.normal(size=s)) if init == "identity_noise" else (lambda *s: np.zeros(s))
        if init == "xavier":
            noise = lambda *s: r.uniform(-1, 1, s) * np.sqrt(6 / (2 * d))
        if self.kind == "dense":
            return {"m": noise(d, d)}
        if self.kind == "dissipative":
            return {"low": noise(d, d) - 4 * np.eye(d) * (init != "xavier")}
        if self.kind == "auxiliary_spectral":
            sizes = [d, *self.hidden, 2 * (d // 2) + d % 2]
            w = {}
            for i, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
                last = i == len(sizes) - 2
                w[f"w{i}"] = np.zeros((b, a)) if last and init != "xavier" else r.uniform(-1, 1, (b, a)) * np.sqrt(6 / (a + b))
                w[f"b{i}"] = np.zeros(b)
            return w
        base = 0.0 if init == "xavier" else float(np.arctanh(0.01))
        p = {"diag": base + (0 if self.kind == "schur" else 1) * noise(d)}
        if self.kind == "odo":
            return p | {"o1": noise(d, d), "o2": noise(d, d)}
        if self.kind == "schur":
            return p | {"q": noise(d, d), "off": noise(d, d)}  # noise sits off the diagonal here
        return p | {"q": noise(d, d), "p": np.zeros(d)}

    def diagonal(self) -> np.ndarray:
        """Strictly negative values within the bound."""
        return -MARGIN - np.abs(np.tanh(self.params["diag"])) * (self.radius - MARGIN)

    def matrix(self) -> np.ndarray:
        if self.kind == "auxiliary_spectral":
            raise ValueError("this generator depends on the state: use generator_at")
        if self.kind == "dissipative":
            return -_dissipation(self.params["low"])
        return super().matrix()

    generator = matrix

    def auxiliary(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mu, omega, real) of each row from the network."""
        h = np.atleast_2d(z)
        n = len(self.hidden) + 1
        for i in range(n):
            h = h @ self.params[f"w{i}"].T + self.params[f"b{i}"]
            h = np.tanh(h) if i + 1 < n else h
        k = self.dim // 2
        return h[:, :k], softplus(h[:, k : 2 * k]) + LEAST_FREQUENCY, h[:, 2 * k :]

    def generator_at(self, z: np.ndarray) -> np.ndarray:
        """(rows, d, d) generators at states."""
        if self.kind != "auxiliary_spectral":
            return np.broadcast_to(self.matrix(), (len(np.atleast_2d(z)), self.dim, self.dim))
        mu, om, re = self.auxiliary(z)
        out = np.zeros((len(mu), self.dim, self.dim))
        for k in range(self.dim // 2):
            i = 2 * k
            out[:, i, i] = out[:, i + 1, i + 1] = mu[:, k]
            out[:, i, i + 1], out[:, i + 1, i] = -om[:, k], om[:, k]
        if self.dim % 2:
            out[:, -1, -1] = re[:, 0]
        return out

    def transition(self, dt: float) -> np.ndarray:
        return expm(self.matrix() * dt)

    def _factors(self, z: np.ndarray, dt: float, u) -> tuple[np.ndarray, np.ndarray | None]:
        """Transitions and control factors, of all rows or one for each."""
        c = self.control
        gens = self.generator_at(z) if self.kind == "auxiliary_spectral" else self.matrix()
        if u is None:
            return (np.stack([expm(g * dt) for g in gens]) if gens.ndim == 3 else expm(gens * dt)), None
        gens = c.effective(gens, u)
        if gens.ndim == 2:
            return van_loan(gens, c.b, dt)
        pairs = [van_loan(g, c.b, dt) for g in gens]
        return np.stack([a for a, _ in pairs]), np.stack([b for _, b in pairs])

    def advance(self, z: np.ndarray, u=None, dt: float = 1.0) -> np.ndarray:
        self.control.check(u)
        if dt == 0:
            if u is not None:
                raise ValueError("no time passes for the control")
            return z
        f, g = self._factors(z, dt, u)
        out = z @ f.T if f.ndim == 2 else np.einsum("nd,ned->ne", z, f)
        if g is None:
            return out
        u = np.asarray(u, float)
        return out + (u @ g.T if g.ndim == 2 else np.einsum("...u,neu->ne", np.broadcast_to(u, (len(z), u.shape[-1])), g))

    def inverse_step(self, z: np.ndarray, u=None, dt: float = 1.0) -> np.ndarray:
        self.control.check(u)
        f, g = self._factors(z, dt, u)
        if g is not None:
            u = np.asarray(u, float)
            z = z - (u @ g.T if g.ndim == 2 else np.einsum("...u,neu->ne", np.broadcast_to(u, (len(z), u.shape[-1])), g))
        if f.ndim == 2:
            return z @ (expm(-self.matrix() * dt) if u is None or self.control.mode == "additive" else inverse(f)).T
        return np.stack([a @ inverse(m).T for a, m in zip(z, f, strict=True)])

    def column(self, z: Column | str, u: Column | str | None = None, dt: float = 1.0) -> Column:
        self.control.check(u)
        if self.kind == "auxiliary_spectral" or self.control.mode == "bilinear":
            raise ValueError("this step depends on each row: use advance_rows")
        if u is None:
            return V.matvec(self.transition(dt), z)
        f, g = van_loan(self.matrix(), self.control.b, dt)
        return V.add(V.matvec(f, z), V.matvec(g, u))

    def column_by_dt(self, z: Column | str, dt: Column | str, deltas: list[float]) -> Column:
        """The free step where rows differ in dt, of a stated small set: one
        exponential for each, chosen by value."""
        m = F.create_map(*[x for d in sorted(set(deltas)) for x in (F.lit(float(d)), V.literal(self.transition(d)))])
        return V.matvec(F.element_at(m, V.col(dt)), z)

    def max_real(self) -> float:
        return float(np.linalg.eigvals(self.matrix()).real.max())

    def spectral_radius(self) -> float:
        return self.max_real()

    def bound(self) -> float:
        if self.kind == "auxiliary_spectral":
            raise ValueError("a state-dependent generator has no bound")
        if self.kind == "dense":
            return self.max_real()
        if self.kind == "dissipative":
            return float(np.linalg.eigvalsh(self.matrix()).max())
        return float(self.diagonal().max())

    def certificate(self) -> Certificate | None:
        if self.kind in ("dense", "odo", "auxiliary_spectral"):
            return None
        m = None
        if self.kind == "lyapunov":
            q = cayley(self.params["q"])
            m = q @ np.diag(softplus(self.params["p"]) + LEAST_CERTIFICATE) @ q.T
        return Certificate(-self.bound(), m)

    def spectrum(self, time_step: float | None = None) -> Spectrum:
        return generator_spectrum(self.matrix()) if time_step is None else spectrum_at(self.matrix(), time_step)

    def set_discrete(self, k: np.ndarray, dt: float) -> None:
        """The dense generator whose step of dt is K."""
        self.set_dense(logm(k) / dt)


@dataclass
class GraphOperator:
    """z K_self' + (A_hat z) K_nbr' over a graph."""

    own: DiscreteOperator
    neighbour: DiscreteOperator
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.own.dim != self.neighbour.dim:
            raise ValueError("both parts need the same dimension")

    @property
    def dim(self) -> int:
        return self.own.dim

    def effective_matrix(self, adjacency: np.ndarray) -> np.ndarray:
        """I (x) K_self + A_hat (x) K_nbr for a dense normalised adjacency."""
        return np.kron(np.eye(len(adjacency)), self.own.matrix()) + np.kron(adjacency, self.neighbour.matrix())

    def advance(self, z: np.ndarray, adjacency: np.ndarray, u=None) -> np.ndarray:
        return self.own.advance(z, u) + adjacency @ z @ self.neighbour.matrix().T

    def inverse_step(self, z: np.ndarray, adjacency: np.ndarray, u=None) -> np.ndarray:
        y = z if u is None else z - np.asarray(u, float) @ self.own.control.b
        return (inverse(self.effective_matrix(adjacency)) @ y.ravel()).reshape(z.shape)

    def step(self, snap: DataFrame, normalised: DataFrame, u: Column | None = None) -> DataFrame:
        """One step of a table (traj, t, node, f): an edge join, an aggregation and
        two products a row.  ``normalised`` are entries of A_hat."""
        from nodalis.operators.topology import apply

        near = apply(normalised, snap, self.dim).withColumnRenamed("f", "_n")
        both = snap.join(near, ["traj", "t", "node"])
        return both.select("traj", (F.col("t") + 1).alias("t"), "node", V.add(self.own.column("f", u), V.matvec(self.neighbour.matrix(), "_n")).alias("f"))

    def bound(self) -> float:
        return max(self.own.bound(), self.neighbour.bound())

    def spectral_radius(self) -> float:
        return self.own.spectral_radius()

    def spectrum(self, adjacency: np.ndarray, time_step: float = 1.0) -> Spectrum:
        return compute_spectrum(self.effective_matrix(adjacency), time_step)


def constrain(operator: DiscreteOperator, target: np.ndarray, weight: np.ndarray, dt: float | None = None, steps: int = 100) -> float:
    """Sets the operator's parameters so that its matrix (its step of ``dt``) is
    nearest to ``target`` in the metric of ``weight``, the Gram matrix of the
    states: the least-squares fit of one step within the parameterization.
    Damped Gauss-Newton on the parameters, all of them small matrices on the
    driver.  Returns the squared distance that is left."""
    if operator.kind == "dissipative":  # at its own start small factors have hardly a slope
        w, q = np.linalg.eigh((target + target.T) / 2)
        loss = (q * np.maximum(-np.log(np.clip(w, 1e-9, None)) / (dt or 1.0) - LEAST_DISSIPATION, 1e-6)) @ q.T
        low = np.linalg.cholesky(loss)
        operator.params["low"] = np.tril(low, -1) + np.diag(np.log(np.expm1(np.maximum(np.diag(low) - LEAST_DISSIPATION, 1e-6))))
    names = sorted(operator.params)
    shapes = [operator.params[k].shape for k in names]
    root = np.linalg.cholesky(weight + 1e-12 * np.trace(weight) / len(weight) * np.eye(len(weight)))

    def put(v: np.ndarray) -> None:
        at = 0
        for k, shape in zip(names, shapes, strict=True):
            n = int(np.prod(shape))
            operator.params[k] = v[at : at + n].reshape(shape)
            at += n

    def rest(v: np.ndarray) -> np.ndarray:
        put(v)
        m = operator.matrix() if dt is None else operator.transition(dt)
        return ((m - target) @ root).ravel()

    v = np.concatenate([operator.params[k].ravel() for k in names])
    r, damp = rest(v), 1e-2
    for _ in range(steps):
        jac = np.stack([(rest(v + 1e-6 * e) - r) / 1e-6 for e in np.eye(len(v))], axis=1)
        normal, slope = jac.T @ jac, jac.T @ r
        while damp < 1e8:
            move = np.linalg.solve(normal + damp * (np.diag(np.diag(normal)) + 1e-9 * np.eye(len(v))), -slope)
            new = rest(v + move)
            if new @ new < r @ r:
                break
            damp *= 4
        else:
            break
        done = r @ r - new @ new < 1e-14 * (1 + r @ r)
        v, r, damp = v + move, new, max(damp / 5, 1e-12)
        if done:
            break
    put(v)
    return float(r @ r)


def advance_rows(operator: DiscreteOperator, snap: DataFrame, u: str = "u", dt: float | None = None, back: bool = False) -> DataFrame:
    """``snap`` (.., f) with each row's step, or its inverse, for operators whose
    matrix depends on the row: bilinear controls (array column ``u``) and
    generators from a network.  Arrow batches, no shuffle; the operator's small
    parameters go with the function."""
    controlled = operator.control.dim > 0
    at, from_u = snap.columns.index("f"), snap.columns.index(u) if controlled else None
    how = {} if dt is None else {"dt": dt}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z = np.asarray(b.column(at).flatten(), float).reshape(b.num_rows, -1)
            if not controlled:
                z = operator.inverse_step(z, **how) if back else operator.advance(z, **how)
            else:
                us = np.asarray(b.column(from_u).flatten(), float).reshape(b.num_rows, -1)
                # rows of one control make one step
                each, which = np.unique(us, axis=0, return_inverse=True)
                out = np.empty_like(z)
                for i, own in enumerate(each):
                    rows = which.ravel() == i
                    out[rows] = operator.inverse_step(z[rows], own, **how) if back else operator.advance(z[rows], own, **how)
                z = out
            f = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([f if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return snap.mapInArrow(run, snap.schema)


def eigenvalue_penalty(operator, adjacency: np.ndarray | None = None) -> float:
    """What spectral radii over 1 (real parts over 0) cost."""
    if isinstance(operator, GraphOperator):
        if adjacency is None:
            raise ValueError("a graph operator needs a topology")
        w = np.abs(np.linalg.eigvals(operator.effective_matrix(adjacency)))
        return float((np.maximum(w - 1, 0) ** 2).mean())
    if operator.kind in ("dissipative", "auxiliary_spectral"):
        return 0.0
    if isinstance(operator, ContinuousOperator):
        return float((np.maximum(np.linalg.eigvals(operator.matrix()).real, 0) ** 2).mean()) if operator.kind in ("dense", "odo") else max(operator.bound(), 0) ** 2
    if operator.kind in ("dense", "odo"):
        return float((np.maximum(np.abs(np.linalg.eigvals(operator.matrix())) - 1, 0) ** 2).mean())
    return max(operator.bound() - 1, 0) ** 2


# --- roll-outs ---------------------------------------------------------------------


def rollout(operator: DiscreteOperator, snap: DataFrame, steps: int, controls: list[list[float]] | None = None, decode: np.ndarray | None = None) -> DataFrame:
    """(traj, origin, h, node, f): latent steps of every row from its origin, each
    decoded by a linear map.  One projection: powers come from the driver."""
    op = operator
    if (controls is None) == (op.control.dim > 0) or controls is not None and len(controls) != steps:
        raise ValueError("controls must match the operator and the number of steps")
    c = np.eye(op.dim) if decode is None else np.asarray(decode, float)
    power, push, rows = np.eye(op.dim), np.zeros(op.dim), []
    for h in range(1, steps + 1):
        k = op.matrix()
        if controls is not None:
            k = op.control.effective(k, np.asarray(controls[h - 1], float))
            push = k @ push + np.asarray(controls[h - 1], float) @ op.control.b
        power = k @ power
        f = V.matvec(c @ power, "f")
        if controls is not None:
            f = V.add(f, F.array(*[F.lit(float(v)) for v in c @ push]))
        rows.append(F.struct(F.lit(h).alias("h"), f.alias("f")))
    return snap.select("traj", F.col("t").alias("origin"), "node", F.explode(F.array(*rows)).alias("_r")).select("traj", "origin", "_r.h", "node", "_r.f")


def increments(query_times: list[float] | None = None, deltas: list[float] | None = None, time_step: float | None = None) -> list[float]:
    """Step lengths from either query times (rising from 0) or themselves; with a
    time step they must all equal it."""
    if (query_times is None) == (deltas is None):
        raise ValueError("exactly one of query times and step lengths is needed")
    out = list(deltas) if deltas is not None else [b - a for a, b in zip([0.0, *query_times], query_times, strict=False)]
    if not out or min(out) <= 0:
        raise ValueError("time must pass at every step")
    if time_step is not None and any(abs(d - time_step) > max(1e-6, 1e-4 * time_step) for d in out):
        raise ValueError("a discrete operator needs uniform steps")
    return out


def rollout_at(operator: ContinuousOperator, snap: DataFrame, query_times: list[float]) -> DataFrame:
    """(traj, origin, h, node, f) at irregular times after each origin."""
    increments(query_times=query_times)
    rows = [F.struct(F.lit(i).alias("h"), V.matvec(operator.transition(t), "f").alias("f")) for i, t in enumerate(query_times, 1)]
    return snap.select("traj", F.col("t").alias("origin"), "node", F.explode(F.array(*rows)).alias("_r")).select("traj", "origin", "_r.h", "node", "_r.f")
