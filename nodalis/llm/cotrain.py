"""Document quality by co-training two views.

One classifier sees a document's text alone (its words, hashed to WORD_BINS
shares; shares of character kinds and marks, repetition, word lengths), the other
its metadata alone (language, source and length, hashed).  Both are logistic.
They start from labelled documents; then, ROUNDS times, every unlabelled document
is scored by both views on the executors, and each view gives the other the ones
it is surest of as pseudo-labels: those of SURE or more, the surest PER_ROUND
share of all unlabelled documents for each class (ties with the last one too),
once more that share in each round.  A class's pseudo-labels weigh together PSEUDO
times its labels, however many they are, so any size of corpus behaves alike.
A quarter of the labelled documents stays out and calibrates each view's
log-odds; the sum of what both views add to the prior log-odds is the score.

Fits are Newton's method on sums over all rows that teach, made by partition and
added up in two steps; the driver sees FOLDED matrices of some hundred rows a
step.  Labels come from a bounded sample (TRAIN_ROWS documents of each class);
unlabelled documents are never sampled.  Features are checkpointed once (half
floats, about 400 bytes a document); every document is scored whole.

Null texts are empty, null metadata a value of its own; null labels teach
nothing; without labels of both classes every score is 0.5.  A labelled document
of several rows teaches with each.  Repeated rows get repeated results, an empty
table none.  Other columns may have any names.
"""

from __future__ import annotations

import ast

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import bounded_sample, cut, held_out, mapped, table

TRAIN_ROWS = 3000
ROUNDS = 3
SURE = 0.95
PER_ROUND = 0.05
PSEUDO = 0.5
META_BINS = 64
WORD_BINS = 128
RIDGE = 1.0
STEPS = 6
#: Rows that sums of all partitions are folded into before the driver adds them up.
FOLDED = 8
#: Log-odds are counted in bins of this width, up to MOST either way.
BIN, MOST = 0.05, 30.0
CACHE = 400_000

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordBins(dict):
    """Bin of each written word, without outer marks and in lower case."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = xxhash.xxh64_intdigest(raw.strip(PUNCTUATION).lower()) % WORD_BINS
        if len(raw) <= 64:
            self[raw] = out
        return out


PUNCTUATION = MARKS.decode()
_bins = WordBins()


def text_view(text: str | None) -> np.ndarray:
    """Features of a text, each in 0..1 or so."""
    t = text or ""
    raw = t.encode()
    n = max(1, len(raw))
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = t.split()
    w = max(1, len(words))
    lines = [x for x in t.split("\n") if x]
    out = np.zeros(WORD_BINS + len(MARKS) + 12)
    if words:
        out[:WORD_BINS] = np.sqrt(np.bincount(np.fromiter(map(_bins.__getitem__, words), np.int64, len(words)), minlength=WORD_BINS) / w)
    out[WORD_BINS : WORD_BINS + len(MARKS)] = np.sqrt(kinds[list(MARKS)] / n)
    out[WORD_BINS + len(MARKS) :] = (
        kinds[65:91].sum() / n,
        kinds[97:123].sum() / n,
        kinds[48:58].sum() / n,
        kinds[128:].sum() / n,
        (kinds[9:14].sum() + kinds[32]) / n,
        min(1.0, n / w / 20),
        1 - len(set(words)) / w,
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, w - 1),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x.isupper() for x in words) / w,
        sum(not x[-1].isalnum() for x in words) / w,
        min(1.0, np.log1p(n) / 14),
    )
    return out


def meta_view(lang, source, chars) -> np.ndarray:
    """Hashed features of language, source and length."""
    out = np.zeros(META_BINS)
    for v in (f"lang={lang}", f"source={source}", f"size={int(np.log2(max(1, chars)))}" if chars is not None else "size=None"):
        out[xxhash.xxh64_intdigest(v) % META_BINS] = 1
    return out


def half(x: np.ndarray) -> np.ndarray:
    """Features as they are kept and scored."""
    return x.astype(np.float16).astype(np.float64)


class TwoViews:
    """Two logistic classifiers on standardised features and their calibration."""

    def __init__(self, moments: list[tuple[float, np.ndarray, np.ndarray]]):
        """Count, sums and sums of squares of each view's features."""
        self.mean = [total / n for n, total, _ in moments]
        scale = [np.sqrt(np.maximum(0, squares / n - m * m)) for (n, _, squares), m in zip(moments, self.mean, strict=True)]
        self.scale = [np.where(s < 1e-9, 1, s) for s in scale]
        self.w = [np.zeros(len(m) + 1) for m in self.mean]
        # of each class and view: least log-odds that give a pseudo-label, and its weight
        self.bar = np.full((2, 2), np.inf)
        self.weight = np.zeros((2, 2))
        self.prior, self.curve = 0.0, [(1.0, 0.0), (1.0, 0.0)]

    def of(self, v: int, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean[v]) / self.scale[v], np.ones(len(x))]

    def odds(self, v: int, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 in view ``v``."""
        return np.clip(self.of(v, x) @ self.w[v], -MOST, MOST)

    def given(self, g: int, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, weight) of the pseudo-labels that view ``g`` gives, -1 for none."""
        out = np.where(odds >= self.bar[1, g], 1, np.where(-odds >= self.bar[0, g], 0, -1))
        return out, np.where(out < 0, 0.0, np.where(out == 1, self.weight[1, g], self.weight[0, g]))

    def sums(self, views: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """Of each view the gradient and Hessian of the weighted log-likelihood;
        y is -1 for unlabelled rows."""
        out = []
        odds = [self.odds(v, x) for v, x in enumerate(views)]
        for v, x in enumerate(views):
            target, weight = self.given(1 - v, odds[1 - v])
            target, weight = np.where(y >= 0, y, target), np.where(y >= 0, 1.0, weight)
            at = np.flatnonzero(weight > 0)
            a, p = self.of(v, x[at]), 1 / (1 + np.exp(-odds[v][at]))
            out += [a.T @ (weight[at] * (target[at] - p)), (a * (weight[at] * p * (1 - p))[:, None]).T @ a]
        return out

    def step(self, sums: list[np.ndarray]) -> float:
        """One Newton step of both views; the greatest change."""
        far = 0.0
        for v in (0, 1):
            keep = np.r_[np.full(len(self.w[v]) - 1, RIDGE), 1e-6]
            move = np.clip(np.linalg.solve(sums[2 * v + 1] + np.diag(keep), sums[2 * v] - keep * self.w[v]), -5, 5)
            self.w[v] = self.w[v] + move
            far = max(far, float(np.abs(move).max()))
        return far

    def counts(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Of each view the numbers of rows by bin of log-odds."""
        n = int(2 * MOST / BIN) + 1
        return [np.bincount(((self.odds(v, x) + MOST) / BIN).astype(int), minlength=n).astype(float) for v, x in enumerate(views)]

    def choose(self, counts: list[np.ndarray], labels: np.ndarray, share: float) -> None:
        """Sets the bars that give the surest ``share`` of all counted rows for
        each class, and the weights; labels: numbers of labelled rows by class."""
        least = np.log(SURE / (1 - SURE))
        edge = np.arange(len(counts[0])) * BIN - MOST  # lower edges
        for g, n in enumerate(counts):
            for c, far in enumerate((-(edge + BIN), edge)):
                order = np.argsort(-far, kind="stable")
                total = np.cumsum(n[order])
                last = int(np.searchsorted(total, share * n.sum()))
                bar = max(least, far[order[min(last, len(order) - 1)]] - 1e-9)
                given = n[far >= bar].sum()
                self.bar[c, g], self.weight[c, g] = (bar, PSEUDO * labels[c] / given) if given else (np.inf, 0.0)

    def calibrate(self, odds: np.ndarray, y: np.ndarray) -> None:
        """Curves of each view's log-odds from labelled rows that taught nothing."""
        self.curve = [_curve(odds[:, v], y) for v in (0, 1)]

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        odds = self.prior + sum(self.curve[v][0] * self.odds(v, x) + self.curve[v][1] - self.prior for v, x in enumerate((text, meta)))
        return 1 / (1 + np.exp(-np.clip(odds, -MOST, MOST)))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method."""
    scale = x.std() or 1.0
    a, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-6]), a.T @ (y - p) - np.array([ridge, 1e-6]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


META = ("text", "lang", "source", "n_chars")


def _views(b: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of a batch whose first columns are META."""
    text = np.array([text_view(t) for t in b.column(0).to_pylist()])
    return [half(text), half(np.array([meta_view(*r) for r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]))]


def _source(df: DataFrame, *carry) -> DataFrame:
    kinds = ("string", "string", "string", "long")
    return df.select(*[F.col(c).cast(k).alias(f"_{i}") for i, (c, k) in enumerate(zip(META, kinds, strict=True))], *carry)


def _kept(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(len(col), -1).astype(np.float64)


def _total(feat: DataFrame, of) -> list[np.ndarray]:
    """The sum over all rows of ``of(views, y)``'s arrays, by partition, then in
    FOLDED rows, then on the driver."""

    def each(batches):
        out, shapes = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                own = of([_kept(b.column(0)), _kept(b.column(1))], b.column(2).to_numpy())
                shapes = [x.shape for x in own]
                flat = np.concatenate([x.ravel() for x in own])
                out = flat if out is None else out + flat
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([str(shapes)])], names=["sums", "shapes"])

    def fold(batches):
        out, shapes = None, ""
        for b in batches:
            for raw, shapes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = np.frombuffer(raw) if out is None else out + np.frombuffer(raw)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([shapes])], names=["sums", "shapes"])

    kind = "sums binary, shapes string"
    rows = mapped(feat.select("x", "m", "y"), each, kind).repartition(FOLDED).mapInArrow(fold, kind).collect()
    if not rows:
        return []
    flat, out, at = sum(np.frombuffer(r.sums) for r in rows), [], 0
    for shape in ast.literal_eval(rows[0].shapes):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def _moments(views: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    return [np.array([float((y == 0).sum()), float((y == 1).sum())]), *[z for x in views for z in (x.sum(0), (x * x).sum(0))]]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> TwoViews | None:
    spark = docs.sparkSession
    own = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).groupBy("_id").agg(F.min("_y").alias("_y"))
    some = F.broadcast(bounded_sample(own, "_id", "_y", TRAIN_ROWS))  # 2 * TRAIN_ROWS rows
    rows = _source(docs, F.col(key).alias("_k")).join(some, F.col("_k") == F.col("_id"), "left")
    rows = rows.select(*[f"_{i}" for i in range(4)], "_id", F.coalesce("_y", F.lit(-1)).alias("_y"), F.coalesce(F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(4)) == 0, F.lit(False)).alias("_out"))

    def featured(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x, m = _views(b)
                yield pa.RecordBatch.from_arrays([*[pa.array([r.astype(np.float16).tobytes() for r in v], pa.binary()) for v in (x, m)], b.column(5), b.column(4), b.column(6)], names=["x", "m", "y", "id", "out"])

    feat = cut(mapped(rows, featured, f"x binary, m binary, y int, id {rows.schema['_id'].dataType.simpleString()}, out boolean"))
    labelled, free = feat.where("y >= 0"), feat.where("y < 0")
    teach = labelled.where("not out")
    got = _total(teach, _moments)
    if not got or not got[0].all():
        teach, got = labelled, _total(labelled, _moments)
        if not got or not got[0].all():
            return None
    n = got[0]
    model = TwoViews([(n.sum(), got[1], got[2]), (n.sum(), got[3], got[4])])

    def fit(rows: DataFrame) -> None:
        for _ in range(STEPS):
            own = spark.sparkContext.broadcast(model)
            if model.step(_total(rows, lambda views, y: own.value.sums(views, y))) < 1e-3:
                break

    fit(teach)
    for r in range(ROUNDS):
        own_ = spark.sparkContext.broadcast(model)
        counts = _total(free, lambda views, y: own_.value.counts(views))
        if not counts:
            break
        model.choose(counts, n, PER_ROUND * (r + 1))
        fit(teach.unionByName(free))
    tested = labelled.where("out")
    shares = {x.y: x.n for x in labelled.groupBy("y").agg(F.countDistinct("id").alias("n")).collect()}  # two rows
    model.prior = float(np.log(shares[1] / shares[0]))
    odds = _odds(tested, model)
    if not 0 < odds[2].sum() < len(odds[2]):
        odds = _odds(labelled, model)
    model.calibrate(np.c_[odds[0], odds[1]], odds[2])
    return model


def _odds(rows: DataFrame, model: TwoViews) -> tuple:
    """(odds, odds, label) of each labelled document: 2 * TRAIN_ROWS at most."""
    own = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(3), pa.array(own.value.odds(0, _kept(b.column(0)))), pa.array(own.value.odds(1, _kept(b.column(1)))), b.column(2)], names=["id", "a", "b", "y"])

    got = mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, a double, b double, y int").groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("y").alias("y")).orderBy("id").toArrow()
    return tuple(got.column(c).to_numpy() for c in ("a", "b", "y"))


def score(docs: DataFrame, model: TwoViews | None, key: str = "doc_id") -> DataFrame:
    """(key, score) for each row of ``docs``."""
    if model is None:
        return docs.select(key, F.lit(0.5).alias("score"))
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([b.column(4), pa.array(own.value.score(*_views(b)))], names=[key, "score"])

    src = _source(docs, F.col(key))
    return mapped(src, run, f"`{key}` {src.schema[key].dataType.simpleString()}, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
