"""Gradients of NumPy code by a tape.

A ``Node`` wraps an array and takes part in ufuncs and the array functions below,
so forward passes written for arrays run on it as they are; ``gradients`` walks
the tape back.  Shapes are small (one graph, one step), everything is float64.
"""

from __future__ import annotations

import numpy as np


def value(x):
    """The array behind a node; anything else as it is."""
    return x.value if isinstance(x, Node) else x


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over the axes that broadcasting added."""
    g = np.asarray(g, float)
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


class Node(np.lib.mixins.NDArrayOperatorsMixin):
    __array_priority__ = 1000

    def __init__(self, value, parents=()):
        self.value = np.asarray(value, float)
        self.parents = parents  # (node, gradient of it from this node's)

    shape = property(lambda self: self.value.shape)
    ndim = property(lambda self: self.value.ndim)
    T = property(lambda self: Node(self.value.T, [(self, lambda g: g.T)]))

    def __len__(self) -> int:
        return len(self.value)

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __getitem__(self, at):
        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, at, g)
            return out

        return Node(self.value[at], [(self, back)])

    def reshape(self, *shape):
        return Node(self.value.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            g = np.asarray(g)
            return np.broadcast_to(np.expand_dims(g, axis) if axis is not None and not keepdims else g, self.shape)

        return Node(self.value.sum(axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims=False):
        total = self.sum(axis, keepdims)
        return total * (total.value.size / self.value.size)

    def max(self, axis=None, keepdims=False):
        """The greatest values; where several are, the first has the gradient."""
        if axis is None:
            return self.reshape(-1)[int(self.value.argmax())]
        best = np.expand_dims(self.value.argmax(axis), axis)
        out = Node(np.take_along_axis(self.value, best, axis), [(self, lambda g: _put(self.shape, best, g, axis))])
        return out if keepdims else Node(out.value.squeeze(axis), [(out, lambda g: np.expand_dims(g, axis))])

    def scatter(self, at: np.ndarray, n: int):
        """Rows added up at places."""
        out = np.zeros((n, *self.shape[1:]))
        np.add.at(out, at, self.value)
        return Node(out, [(self, lambda g: g[at])])

    def __array_ufunc__(self, ufunc, method, *inputs, **how):
        if method != "__call__" or how:
            return NotImplemented
        x = [value(v) for v in inputs]
        y = ufunc(*x)
        if ufunc in _PLAIN:
            return y
        if ufunc not in _BACK:
            return NotImplemented
        parents = []
        for i, v in enumerate(inputs):
            if isinstance(v, Node):
                parents.append((v, lambda g, i=i, v=v: _fit(_BACK[ufunc][i](g, y, *x), v.shape)))
        return Node(y, parents)

    def __array_function__(self, func, types, args, how):
        if func not in _FUNCTIONS:
            return NotImplemented
        return _FUNCTIONS[func](*args, **how)


def _put(shape, at, g, axis):
    out = np.zeros(shape)
    np.put_along_axis(out, at, g, axis)
    return out


def _matmul(side: int):
    def back(g, y, a, b):
        if side == 0:
            return g @ np.swapaxes(b, -1, -2) if b.ndim > 1 else np.multiply.outer(g, b)
        if a.ndim > 1 and b.ndim > 1:
            return np.swapaxes(a, -1, -2) @ g
        return a.T @ g if a.ndim > 1 else np.multiply.outer(a, g)

    return back


_PLAIN = {np.greater, np.less, np.greater_equal, np.less_equal, np.equal, np.not_equal, np.isfinite, np.sign}
_BACK = {
    np.add: (lambda g, y, a, b: g, lambda g, y, a, b: g),
    np.subtract: (lambda g, y, a, b: g, lambda g, y, a, b: -g),
    np.multiply: (lambda g, y, a, b: g * b, lambda g, y, a, b: g * a),
    np.divide: (lambda g, y, a, b: g / b, lambda g, y, a, b: -g * y / b),
    np.power: (lambda g, y, a, b: g * b * np.power(a, b - 1.0), lambda g, y, a, b: g * y * np.log(np.where(a > 0, a, 1))),
    np.matmul: (_matmul(0), _matmul(1)),
    np.maximum: (lambda g, y, a, b: g * (a >= b), lambda g, y, a, b: g * (a < b)),
    np.minimum: (lambda g, y, a, b: g * (a <= b), lambda g, y, a, b: g * (a > b)),
    np.negative: (lambda g, y, a: -g,),
    np.absolute: (lambda g, y, a: g * np.sign(a),),
    np.exp: (lambda g, y, a: g * y,),
    np.expm1: (lambda g, y, a: g * (y + 1),),
    np.log: (lambda g, y, a: g / a,),
    np.sqrt: (lambda g, y, a: g / (2 * y),),
    np.tanh: (lambda g, y, a: g * (1 - y * y),),
}


def _where(cond, a, b):
    c = np.asarray(value(cond))
    parents = []
    if isinstance(a, Node):
        parents.append((a, lambda g: _fit(np.where(c, g, 0), a.shape)))
    if isinstance(b, Node):
        parents.append((b, lambda g: _fit(np.where(c, 0, g), b.shape)))
    return Node(np.where(c, value(a), value(b)), parents)


def _clip(x, low, high):
    return Node(np.clip(x.value, low, high), [(x, lambda g: g * ((x.value >= low) & (x.value <= high)))])


def _einsum(spec: str, *parts):
    ins, out = spec.split("->")
    ins = ins.split(",")
    own = [value(p) for p in parts]

    def back(i):
        def run(g):
            others = [(s, x) for j, (s, x) in enumerate(zip(ins, own, strict=True)) if j != i]
            return np.einsum(",".join([out, *[s for s, _ in others]]) + "->" + ins[i], g, *[x for _, x in others], optimize=True)

        return run

    return Node(np.einsum(spec, *own, optimize=True), [(p, back(i)) for i, p in enumerate(parts) if isinstance(p, Node)])


def _concatenate(parts, axis=0):
    parts = list(parts)
    ends = np.cumsum([value(p).shape[axis] for p in parts])
    return Node(np.concatenate([value(p) for p in parts], axis), [(p, lambda g, i=i: np.split(g, ends[:-1], axis)[i]) for i, p in enumerate(parts) if isinstance(p, Node)])


def _stack(parts, axis=0):
    parts = list(parts)
    return Node(np.stack([value(p) for p in parts], axis), [(p, lambda g, i=i: np.take(g, i, axis)) for i, p in enumerate(parts) if isinstance(p, Node)])


def _split(x, n, axis=0):
    size, out = x.shape[axis] // n, []
    for i in range(n):
        at = [slice(None)] * x.ndim
        at[axis] = slice(i * size, (i + 1) * size)
        out.append(x[tuple(at)])
    return out


def _inverse(x):
    y = np.linalg.inv(x.value)
    return Node(y, [(x, lambda g: -y.T @ g @ y.T)])


_FUNCTIONS = {np.where: _where, np.clip: _clip, np.einsum: _einsum, np.concatenate: _concatenate, np.stack: _stack, np.split: _split, np.linalg.inv: _inverse}


def gradients(out: Node, of: list[Node]) -> list[np.ndarray]:
    """Of a node of one number the gradients by others."""
    order, seen, stack = [], set(), [(out, False)]
    while stack:
        n, done = stack.pop()
        if done:
            order.append(n)
        elif id(n) not in seen:
            seen.add(id(n))
            stack.append((n, True))
            stack += [(p, False) for p, _ in n.parents]
    grads: dict[int, np.ndarray] = {id(out): np.ones(out.shape)}
    for n in reversed(order):
        g = grads.get(id(n))
        if g is not None:
            for p, back in n.parents:
                part = back(g)
                grads[id(p)] = grads[id(p)] + part if id(p) in grads else part
    return [np.broadcast_to(grads.get(id(n), np.zeros(n.shape)), n.shape) for n in of]


# --- trees of arrays -------------------------------------------------------------------------


def leaves(tree) -> list:
    """All float arrays (or nodes) of nested dicts, lists, tuples, in order."""
    if isinstance(tree, (np.ndarray, Node)):
        return [tree]
    if isinstance(tree, dict):
        return [x for k in sorted(tree) for x in leaves(tree[k])]
    if isinstance(tree, (list, tuple)):
        return [x for v in tree for x in leaves(v)]
    return []


def rebuilt(tree, new):
    """``tree`` with its leaves replaced in order by those of iterator ``new``."""
    if isinstance(tree, (np.ndarray, Node)):
        return next(new)
    if isinstance(tree, dict):
        own = {k: rebuilt(tree[k], new) for k in sorted(tree)}
        return {k: own[k] for k in tree}
    if isinstance(tree, (list, tuple)):
        return type(tree)(rebuilt(v, new) for v in tree)
    return tree
