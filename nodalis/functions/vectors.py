"""Vector arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def mul(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def scale(a, k) -> Column:
    return F.transform(col(a), lambda x: x * (k if isinstance(k, Column) else F.lit(float(k))))


def total(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return total(a) / F.size(col(a))


def dot(a, b) -> Column:
    return total(mul(a, b))


def distance2(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n).cast("array<double>")


def literal(rows: Sequence[Sequence[float]]) -> Column:
    """A small matrix as array<array<double>>."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def matvec(matrix, a) -> Column:
    """A z for each row's vector z: the row form z A^T.  ``matrix`` is a column
    of array<array<double>> or a small dense matrix."""
    m = matrix if isinstance(matrix, Column) else literal(matrix)
    return F.transform(m, lambda r: F.aggregate(F.zip_with(r, col(a), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def polynomial(a, degree: int) -> Column:
    """[x, x^2 .. x^degree] by power, without cross terms and constant."""
    if degree < 1:
        raise ValueError("degree must be at least 1")

    def power(k: int) -> Column:
        return F.transform(col(a), lambda x: F.pow(x, F.lit(float(k)))) if k > 1 else col(a)

    return F.concat(*[power(k) for k in range(1, degree + 1)])


def rbf(a, centers: Sequence[Sequence[float]], length: float) -> Column:
    """exp(-|x - c|^2 / (2 l^2)) for each center."""
    if length <= 0:
        raise ValueError("length scale must be positive")
    return F.transform(literal(centers), lambda c: F.exp(-distance2(a, c) / (2 * length * length)))


def polynomial_kernel(a, centers, degree: float = 2, gamma: float = 1.0, coef0: float = 1.0) -> Column:
    return F.transform(literal(centers), lambda c: F.pow(gamma * dot(a, c) + coef0, F.lit(float(degree))))


def linear_kernel(a, centers) -> Column:
    return F.transform(literal(centers), lambda c: dot(a, c))


def block_rotation(a, mu: Sequence[float], omega: Sequence[float], real: Sequence[float], dt) -> Column:
    """z exp(L dt)^T for L of 2x2 blocks [[mu, -w], [w, mu]] and trailing reals,
    in closed form."""
    z, dt = col(a), dt if isinstance(dt, Column) else F.lit(float(dt))
    out = []
    for k, (m, w) in enumerate(zip(mu, omega, strict=True)):
        x, y, g, c, s = z[2 * k], z[2 * k + 1], F.exp(F.lit(float(m)) * dt), F.cos(F.lit(float(w)) * dt), F.sin(F.lit(float(w)) * dt)
        out += [g * (c * x - s * y), g * (s * x + c * y)]
    for k, r in enumerate(real):
        out.append(F.exp(F.lit(float(r)) * dt) * z[2 * len(mu) + k])
    return F.array(*out)


def unflatten(a, nodes: int, dim: int) -> Column:
    """(nodes x dim) rows of a flat vector; an error if the size differs."""
    z = col(a)
    rows = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda i: F.slice(z, i * dim + 1, dim))
    return F.when(F.size(z) == nodes * dim, rows).otherwise(F.raise_error(F.lit(f"latent vector is not of {nodes} x {dim}")).cast("array<array<double>>"))
