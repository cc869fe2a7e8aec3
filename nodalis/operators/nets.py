"""Graph networks and graph forecasters in NumPy; ``learning`` trains them by
running the same code on the nodes of a tape.

A layer maps features (N x C) of one graph; messages run from src to dst.
``encode`` applies a stack to every (trajectory, step) of a sequence in one Arrow
call each, with the static edge list shipped to the workers if it has MAX_EDGES
edges at most; larger or changing topologies go through ``encode_joined``, the
same layers as edge joins and aggregations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodalis import schema
from nodalis.functions import vectors as V
from nodalis.functions.tape import Node, value
from nodalis.operators.frames import Frames

MAX_EDGES = 5_000_000
ACTIVATIONS = {"relu": lambda x: np.maximum(x, 0), "tanh": np.tanh, "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), "none": lambda x: x}
KINDS = ("gcn", "gat", "sage", "transformer", "diffusion")


def _sum(values, at: np.ndarray, n: int):
    if isinstance(values, Node):
        return values.scatter(at, n)
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, at, values)
    return out


def _softmax(score, at: np.ndarray, n: int):
    top = np.full((n, *score.shape[1:]), -np.inf)
    np.maximum.at(top, at, value(score))
    e = np.exp(score - top[at])
    return e / _sum(e, at, n)[at]


def gcn(x, src, dst, w, p):
    """Symmetric normalisation of A + I, one weight matrix, a bias."""
    n = len(x)
    s, d = np.r_[src, np.arange(n)], np.r_[dst, np.arange(n)]
    v = np.r_[w, np.ones(n)]
    deg = _sum(v, d, n)
    r = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1e-300)), 0)
    return _sum((r[s] * v * r[d])[:, None] * (x @ p["w"])[s], d, n) + p["b"]


def sage(x, src, dst, w, p):
    """Mean of neighbours and the node itself, each with its own matrix."""
    n = len(x)
    count = np.maximum(_sum(np.ones(len(dst)), dst, n), 1)
    return _sum(x[src], dst, n) / count[:, None] @ p["w"] + x @ p["own"] + p["b"]


def gat(x, src, dst, w, p):
    """Additive attention over in-neighbours and the node, heads averaged."""
    n = len(x)
    s, d = np.r_[src, np.arange(n)], np.r_[dst, np.arange(n)]
    h = np.einsum("nc,hco->nho", x, p["w"])
    score = (h * p["from"]).sum(-1)[s] + (h * p["to"]).sum(-1)[d]
    a = _softmax(np.where(score > 0, score, 0.2 * score), d, n)
    return _sum(a[:, :, None] * h[s], d, n).mean(1) + p["b"]


def transformer(x, src, dst, w, p):
    """Dot-product attention over in-neighbours, heads averaged, plus a skip."""
    n = len(x)
    q, k, v = (np.einsum("nc,hco->nho", x, p[m]) for m in ("q", "k", "v"))
    key = k[src] + (w[:, None, None] * p["edge"] if "edge" in p else 0)
    a = _softmax((q[dst] * key).sum(-1) / np.sqrt(q.shape[-1]), dst, n) if len(src) else np.zeros((0, q.shape[1]))
    val = v[src] + (w[:, None, None] * p["edge"] if "edge" in p else 0)
    return _sum(a[:, :, None] * val, dst, n).mean(1) + x @ p["own"] + p["b"]


def walks(src, dst, w, n: int, steps: int, interleaved: bool = False) -> np.ndarray:
    """Identity, then powers of the forward and backward random walk."""
    a = np.zeros((n, n))
    np.add.at(a, (src, dst), w)
    both = []
    for m in (a, a.T):
        base = m / np.maximum(m.sum(1, keepdims=True), 1e-6)
        power, own = base, []
        for _ in range(steps):
            own.append(power)
            power = power @ base
        both.append(own)
    order = [s for pair in zip(*both, strict=True) for s in pair] if interleaved else both[0] + both[1]
    return np.array([np.eye(n), *order])


def diffusion(x, src, dst, w, p):
    s = walks(src, dst, w, len(x), (len(p["w"]) - 1) // 2)
    return np.einsum("knm,mc,kco->no", s, x, p["w"]) + p["b"]


LAYERS = {"gcn": gcn, "gat": gat, "sage": sage, "transformer": transformer, "diffusion": diffusion}


def parameters(kind: str, a: int, b: int, r, heads: int = 1, steps: int = 2, edge: bool = False) -> dict[str, np.ndarray]:
    g = lambda *s: r.uniform(-1, 1, s) * np.sqrt(6 / (a + b))
    if kind == "gcn":
        return {"w": g(a, b), "b": np.zeros(b)}
    if kind == "sage":
        return {"w": g(a, b), "own": g(a, b), "b": np.zeros(b)}
    if kind == "gat":
        return {"w": g(heads, a, b), "from": g(heads, b), "to": g(heads, b), "b": np.zeros(b)}
    if kind == "transformer":
        return {**{m: g(heads, a, b) for m in "qkv"}, "own": g(a, b), "b": np.zeros(b), **({"edge": g(heads, b)} if edge else {})}
    if kind == "diffusion":
        return {"w": g(1 + 2 * steps, a, b), "b": np.zeros(b)}
    raise ValueError(f"unknown layer {kind!r}")


class GraphNet:
    """A stack of layers with an activation between them and none at the end."""

    def __init__(self, kind: str, channels: int, hidden: int, out: int, layers: int = 2, activation: str = "relu", heads: int = 1, steps: int = 2, edge: bool = False, seed: int = 0):
        if min(channels, hidden, out, layers, heads, steps) < 1 or activation not in ACTIVATIONS or kind not in KINDS:
            raise ValueError("sizes must be positive, kind and activation known")
        sizes = [channels, *[hidden] * (layers - 1), out]
        r = np.random.default_rng(seed)
        self.kind, self.activation, self.out, self.channels = kind, activation, out, channels
        self.layers = [parameters(kind, a, b, r, heads, steps, edge) for a, b in zip(sizes, sizes[1:], strict=False)]

    def __call__(self, x, src, dst, w=None):
        w = np.ones(len(src)) if w is None else np.asarray(w, float)
        for i, p in enumerate(self.layers):
            x = LAYERS[self.kind](x, np.asarray(src, int), np.asarray(dst, int), w, p)
            x = ACTIVATIONS[self.activation](x) if i + 1 < len(self.layers) else x
        return x


def _edge_arrays(frames: Frames):
    if frames.dynamic:
        raise ValueError("a static topology is needed")
    if frames.edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: use encode_joined")
    e = frames.edges.select("src", "dst", "w").toPandas()
    return e.src.to_numpy(), e.dst.to_numpy(), e.w.fillna(1.0).to_numpy()


def encode(net, frames: Frames) -> DataFrame:
    """(traj, t, node, f): the stack's output at every step."""
    if isinstance(net, GraphNet) and (frames.dynamic or frames.edges.count() > MAX_EDGES):
        return encode_joined(net, frames)
    src, dst, w = _edge_arrays(frames)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        z = net(np.array(pdf.f.tolist(), float), src, dst, w)
        return pd.DataFrame({"traj": pdf.traj, "t": pdf.t, "node": pdf.node, "f": list(z)})

    return frames.snap.groupBy("traj", "t").applyInPandas(one, schema.SNAP)


# --- the layers as joins ------------------------------------------------------------------


def _added(n: int, value: Column) -> Column:
    """Sums of an array column's entries over a group."""
    return F.array(*[F.sum(value[i]) for i in range(n)])


class Joined:
    """Edge joins of one sequence: ``edges`` (traj, [t,] src, dst, w)."""

    def __init__(self, frames: Frames):
        self.on = ["traj", "t"] if frames.dynamic else ["traj"]
        self.edges = frames.edges.select(*self.on, "src", "dst", F.coalesce("w", F.lit(1.0)).alias("w"))

    def degree(self, end: str, weighted: bool = True) -> DataFrame:
        return self.edges.groupBy(*self.on, end).agg((F.sum("w") if weighted else F.count("*").cast("double")).alias(f"{end}_n"))

    def ends(self, snap: DataFrame, *columns: str) -> DataFrame:
        """One row for each edge and step, with both ends' columns (s_.., d_..)."""
        a = snap.select("traj", "t", F.col("node").alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
        b = snap.select("traj", "t", F.col("node").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in columns])
        return self.edges.join(a, [*self.on, "src"]).join(b, ["traj", "t", "dst"])

    def onto(self, snap: DataFrame, sums: DataFrame, node: str = "dst") -> DataFrame:
        return snap.join(sums.withColumnRenamed(node, "node"), ["traj", "t", "node"], "left")

    def walk(self, snap: DataFrame, n: int, forward: bool) -> DataFrame:
        """One step of a random walk of the features: each node's from where its
        edges lead (or come from), by their share of its weight."""
        here, there = ("src", "dst") if forward else ("dst", "src")
        e = self.edges.join(self.degree(here), [*self.on, here]).withColumn("w", F.col("w") / F.greatest(F.col(f"{here}_n"), F.lit(1e-6)))
        far = snap.select("traj", "t", F.col("node").alias(there), "f")
        sums = e.join(far, [*self.on, there]).groupBy("traj", "t", here).agg(_added(n, V.scale("f", F.col("w"))).alias("_s"))
        out = self.onto(snap.select("traj", "t", "node"), sums, here)
        return out.select("traj", "t", "node", F.coalesce("_s", V.zeros(n)).alias("f"))

    def gcn(self, snap: DataFrame, p: dict) -> DataFrame:
        n = p["w"].shape[1]
        deg = self.degree("dst")
        r = lambda c: 1 / F.sqrt(1 + F.coalesce(F.col(c), F.lit(0.0)))
        both = self.edges.join(deg, [*self.on, "dst"]).join(deg.withColumnRenamed("dst", "src").withColumnRenamed("dst_n", "src_n"), [*self.on, "src"], "left")
        both = both.withColumn("w", F.col("w") * r("src_n") * r("dst_n"))
        h = snap.withColumn("h", V.matvec(p["w"].T, "f"))
        far = h.select("traj", "t", F.col("node").alias("src"), F.col("h").alias("s_h"))
        sums = both.join(far, [*self.on, "src"]).groupBy("traj", "t", "dst").agg(_added(n, V.scale("s_h", F.col("w"))).alias("_s"), F.first("dst_n").alias("_d"))
        own = V.scale("h", 1 / (1 + F.coalesce("_d", F.lit(0.0))))
        return self.onto(h, sums).select("traj", "t", "node", V.add(V.add(own, F.coalesce("_s", V.zeros(n))), _constant(p["b"])).alias("f"))

    def sage(self, snap: DataFrame, p: dict) -> DataFrame:
        n = len(p["w"])
        sums = self.ends(snap, "f").groupBy("traj", "t", "dst").agg(_added(n, F.col("s_f")).alias("_s"), F.count("*").alias("_n"))
        mean = V.scale(F.coalesce("_s", V.zeros(n)), 1 / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))
        return self.onto(snap, sums).select("traj", "t", "node", V.add(V.add(V.matvec(p["w"].T, mean), V.matvec(p["own"].T, "f")), _constant(p["b"])).alias("f"))

    def attention(self, snap: DataFrame, score, message, heads: int, n: int, *columns: str, itself: bool) -> DataFrame:
        """(.., _a): of each node the heads' mean of messages weighed by a softmax of
        scores over its in-edges (and itself)."""
        rows = self.ends(snap, *columns)
        if itself:
            own = [F.col(c).alias(f"{e}_{c}") for e in "sd" for c in columns]
            rows = rows.select("traj", "t", "dst", "w", *[f"{e}_{c}" for e in "sd" for c in columns]).unionByName(snap.select("traj", "t", F.col("node").alias("dst"), F.lit(1.0).alias("w"), *own))
        rows = rows.select("traj", "t", "dst", F.array(*[score(k) for k in range(heads)]).alias("e"), F.array(*[message(k) for k in range(heads)]).alias("m"))
        top = rows.groupBy("traj", "t", "dst").agg(F.array(*[F.max(F.col("e")[k]) for k in range(heads)]).alias("top"))
        rows = rows.join(top, ["traj", "t", "dst"]).withColumn("e", F.zip_with("e", "top", lambda a, b: F.exp(a - b)))
        parts = [F.sum(F.col("e")[k]).alias(f"_n{k}") for k in range(heads)] + [_added(n, V.scale(F.col("m")[k], F.col("e")[k])).alias(f"_m{k}") for k in range(heads)]
        sums = rows.groupBy("traj", "t", "dst").agg(*parts)
        total = None
        for k in range(heads):
            each = V.scale(F.col(f"_m{k}"), 1 / (heads * F.col(f"_n{k}")))
            total = each if total is None else V.add(total, each)
        return self.onto(snap, sums.select("traj", "t", "dst", total.alias("_a")))

    def gat(self, snap: DataFrame, p: dict) -> DataFrame:
        heads, _, n = p["w"].shape
        h = snap.withColumn("h", F.array(*[V.matvec(p["w"][k].T, "f") for k in range(heads)]))

        def score(k):
            e = V.dot(F.col("s_h")[k], _constant(p["from"][k])) + V.dot(F.col("d_h")[k], _constant(p["to"][k]))
            return F.when(e > 0, e).otherwise(0.2 * e)

        out = self.attention(h, score, lambda k: F.col("s_h")[k], heads, n, "h", itself=True)
        return out.select("traj", "t", "node", V.add("_a", _constant(p["b"])).alias("f"))

    def transformer(self, snap: DataFrame, p: dict) -> DataFrame:
        heads, _, n = p["q"].shape
        h = snap.select("*", *[F.array(*[V.matvec(p[m][k].T, "f") for k in range(heads)]).alias(m) for m in "qkv"])
        edge = (lambda k: V.scale(_constant(p["edge"][k]), F.col("w"))) if "edge" in p else (lambda k: V.zeros(n))
        score = lambda k: V.dot(F.col("d_q")[k], V.add(F.col("s_k")[k], edge(k))) / float(np.sqrt(n))
        out = self.attention(h, score, lambda k: V.add(F.col("s_v")[k], edge(k)), heads, n, "q", "k", "v", itself=False)
        return out.select("traj", "t", "node", V.add(V.add(F.coalesce("_a", V.zeros(n)), V.matvec(p["own"].T, "f")), _constant(p["b"])).alias("f"))

    def diffusion(self, snap: DataFrame, p: dict) -> DataFrame:
        a, steps = p["w"].shape[1], (len(p["w"]) - 1) // 2
        out = snap.select("traj", "t", "node", V.add(V.matvec(p["w"][0].T, "f"), _constant(p["b"])).alias("_o"))
        for way, forward in enumerate((True, False)):
            here = snap.select("traj", "t", "node", "f")
            for k in range(steps):
                here = self.walk(here, a, forward)
                out = out.join(here, ["traj", "t", "node"]).select("traj", "t", "node", V.add("_o", V.matvec(p["w"][1 + way * steps + k].T, "f")).alias("_o"))
        return out.withColumnRenamed("_o", "f")


def _constant(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


COLUMNS = {"relu": lambda x: F.greatest(x, F.lit(0.0)), "tanh": F.tanh, "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(F.least(x, F.lit(0.0)))), "none": lambda x: x}


def encode_joined(net: GraphNet, frames: Frames) -> DataFrame:
    """``encode`` by edge joins: any number of edges, static or changing; what is
    shuffled is one row for each edge, step and layer."""
    joined, out = Joined(frames), frames.snap.select("traj", "t", "node", "f")
    for i, p in enumerate(net.layers):
        out = getattr(joined, net.kind)(out, p)
        if i + 1 < len(net.layers):
            out = out.withColumn("f", F.transform("f", COLUMNS[net.activation]))
    return out


# --- forecasters: x (history x N x C) to the next step's (N x C) -----------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class DiffusionGRU:
    """A gated recurrent unit whose products are diffusion convolutions."""

    def __init__(self, channels: int, hidden: int, out: int, steps: int = 2, history: int = 1, seed: int = 0):
        r = np.random.default_rng(seed)
        self.hidden, self.history, self.steps = hidden, history, steps
        self.p = {g: parameters("diffusion", channels + hidden, hidden, r, steps=steps) for g in ("reset", "update", "new")}
        self.out = r.normal(size=(hidden, out)) / np.sqrt(hidden)

    def __call__(self, x, src, dst, w):
        s = walks(src, dst, w, x.shape[1], self.steps, interleaved=True)
        mix = lambda v, p: np.einsum("knm,mc,kco->no", s, v, p["w"]) + p["b"]
        h = np.zeros((x.shape[1], self.hidden))
        for v in x:
            both = np.concatenate([v, h], 1)
            r, z = _sigmoid(mix(both, self.p["reset"])), _sigmoid(mix(both, self.p["update"]))
            h = z * h + (1 - z) * np.tanh(mix(np.concatenate([v, r * h], 1), self.p["new"]))
        return h @ self.out


class TemporalGraphConv:
    """Blocks of gated temporal convolution, graph convolution, and another gate."""

    def __init__(self, channels: int, hidden: int, out: int, blocks: int = 2, kernel: int = 3, history: int = 1, seed: int = 0):
        r = np.random.default_rng(seed)
        self.kernel, self.history, self.blocks = kernel, history, []
        c = channels
        for _ in range(blocks):
            self.blocks.append((r.normal(size=(kernel, c, 2 * hidden)) / np.sqrt(kernel * c), parameters("gcn", hidden, hidden, r), r.normal(size=(kernel, hidden, 2 * hidden)) / np.sqrt(kernel * hidden)))
            c = hidden
        self.out = r.normal(size=(hidden, out)) / np.sqrt(hidden)

    def _gate(self, x, k):
        pad = np.concatenate([np.zeros((len(k) - 1, *x.shape[1:])), x])
        y = sum(pad[i : i + len(x)] @ k[i] for i in range(len(k)))
        a, b = np.split(y, 2, axis=-1)
        return a * _sigmoid(b)

    def __call__(self, x, src, dst, w):
        for first, graph, second in self.blocks:
            x = self._gate(x, first)
            x = np.stack([np.maximum(gcn(v, src, dst, w, graph), 0) for v in x])
            x = self._gate(x, second)
        return x[-1] @ self.out


class DilatedGraphNet:
    """Dilated gated convolutions with fixed and learned adjacencies and skips."""

    def __init__(self, channels: int, hidden: int, out: int, layers: int = 4, nodes: int | None = None, embed: int = 10, history: int = 1, seed: int = 0):
        r = np.random.default_rng(seed)
        self.history = history
        g = lambda *s: r.normal(size=s) / np.sqrt(s[-2])
        self.start, self.out = g(channels, hidden), g(hidden, out)
        self.layers = [{"f": g(2, hidden, hidden), "g": g(2, hidden, hidden), "mix": g(4 if nodes else 3, hidden, hidden), "skip": g(hidden, hidden)} for _ in range(layers)]
        self.e = (r.normal(size=(nodes, embed)), r.normal(size=(embed, nodes))) if nodes else None

    def adaptive(self) -> np.ndarray:
        s = np.maximum(self.e[0] @ self.e[1], 0)
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def __call__(self, x, src, dst, w):
        s = list(walks(src, dst, w, x.shape[1], 1)) + ([self.adaptive()] if self.e else [])
        h, skip = x @ self.start, 0
        for i, p in enumerate(self.layers):
            d = 2**i
            back = np.concatenate([np.zeros((d, *h.shape[1:])), h])[: len(h)]
            z = np.tanh(back @ p["f"][0] + h @ p["f"][1]) * _sigmoid(back @ p["g"][0] + h @ p["g"][1])
            skip = skip + z[-1] @ p["skip"]
            h = h + sum(np.einsum("nm,tmc,co->tno", a, z, m) for a, m in zip(s, p["mix"], strict=False))
        return np.maximum(skip, 0) @ self.out


def autoregress(net, frames: Frames, steps: int) -> DataFrame:
    """(traj, origin, h, node, f) of each step's features as origin; the history is
    the origin repeated, then the forecasts themselves."""
    src, dst, w = _edge_arrays(frames)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = np.array(pdf.f.tolist(), float)
        past, rows = [x] * net.history, []
        for h in range(1, steps + 1):
            y = net(np.array(past), src, dst, w)
            past = [*past[1:], y]
            rows.append(pd.DataFrame({"traj": pdf.traj.to_numpy(), "origin": pdf.t.to_numpy(), "h": h, "node": pdf.node.to_numpy(), "f": list(y)}))
        return pd.concat(rows)

    return frames.snap.groupBy("traj", "t").applyInPandas(one, schema.FORECAST)
