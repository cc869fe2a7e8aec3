"""Small dense matrices on the driver or inside an Arrow function (NumPy only)."""

from __future__ import annotations

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling, a [6/6] rational approximation, squaring."""
    a = np.asarray(a, float if not np.iscomplexobj(a) else complex)
    norm = np.abs(a).sum(0).max() if a.size else 0.0
    s = max(0, int(np.ceil(np.log2(norm))) + 1) if norm > 0.5 else 0
    a = a / 2**s
    eye = np.eye(len(a), dtype=a.dtype)
    num, den, term, c = eye.copy(), eye.copy(), eye.copy(), 1.0
    for k in range(1, 7):
        c *= (6 - k + 1) / (k * (12 - k + 1))
        term = term @ a
        num += c * term
        den += c * (-1) ** k * term
    out = np.linalg.solve(den, num)
    for _ in range(s):
        out = out @ out
    return out


def logm(a: np.ndarray) -> np.ndarray:
    """Principal logarithm by eigenvalues, real part."""
    w, v = np.linalg.eig(np.asarray(a, float))
    return ((v * np.log(w.astype(complex))) @ np.linalg.inv(v)).real


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse, or the pseudo-inverse of a singular matrix."""
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def cayley(params: np.ndarray) -> np.ndarray:
    """(I - S)^-1 (I + S) of the skew part S: an orthogonal matrix."""
    s = (params - params.T) / 2
    eye = np.eye(len(s))
    return np.linalg.solve(eye - s, eye + s)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def van_loan(generator: np.ndarray, control: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of exp([[L, B^T], [0, 0]] dt): transition and control factor."""
    d, u = len(generator), len(control)
    m = np.zeros((d + u, d + u))
    m[:d, :d], m[:d, d:] = generator, np.asarray(control).T
    e = expm(m * dt)
    return e[:d, :d], e[:d, d:]


def van_loan_generator(k: np.ndarray, b: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Generator and control whose step of dt is (K, B)."""
    d, u = len(k), len(b)
    m = np.eye(d + u)
    m[:d, :d], m[:d, d:] = k, np.asarray(b).T
    e = logm(m) / dt
    return e[:d, :d], e[:d, d:].T


def strict(radius: float) -> float:
    """A bound strictly under ``radius``."""
    return max(radius - 1e-4, 1e-4)


def safe_reciprocal(d: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return 1 / np.where(np.abs(d) < eps, np.where(d < 0, -eps, eps), d)


def rls_update(w: np.ndarray, p: np.ndarray, phi: np.ndarray, target: np.ndarray, forget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One recursive least-squares step: (weights, covariance, error)."""
    error = target - phi @ w
    gain = p @ phi / (forget + phi @ p @ phi)
    return w + np.outer(gain, error), (p - np.outer(gain, phi @ p)) / forget, error
