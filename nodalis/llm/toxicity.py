"""Toxicity from two class-conditional Kneser-Ney models.

Texts are lower-cased characters with every run of other things than letters as
one space, so contexts go on across words.  A class's probability of a character
after the ORDER - 1 before it is, from orders above SHARED down,

    p(x | c) = (max(n(c x) - DISCOUNT, 0) + rest(c) p(x | shorter c)) / n(c)

with n the class's own counts and rest(c) what the discount takes from them;
contexts that the class never saw are passed over.  Orders up to SHARED are one
Kneser-Ney model of both classes together, whose counts are in how many places a
gram continues, so an expression that is rare in a class falls back to the same
shared counts in both models and speaks for neither.

The two log-likelihoods are compared by passage and normalised by length: of all
passages of up to WINDOW characters (several words) the greatest difference, a
character of WINDOW, is the document's evidence, so a long text is not excused
by its ordinary parts.  A logistic curve,
fitted on labelled documents that gave no counts and shifted to the labels' own
share of toxic ones, turns it into a score.

Each gram's log-ratio and each context's log-ratio of back-off weights are tables
in sorted arrays, so texts are scored in a few vectorised look-ups a character.
Labels are learned from a bounded sample: the first TRAIN_ROWS documents of each
class by hash, one text of each, those that keep the class within TRAIN_CHARS
characters together; every document is scored whole, in blocks whose results don't depend
on the block.  Settings come from folds of training labels, see
``toxicity_folds``.

Null and empty texts have evidence 0.  Labels that are null, and documents
without a label, teach nothing; repeated labels of a document count once each.
Without labels of both classes every score is 0.  Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import bounded_sample, held_out, mapped, table

ORDER = 4
SHARED = 2
DISCOUNT = 0.75
WINDOW = 60
#: Labelled documents of each class that the models are fitted on, and characters of them, at most.
TRAIN_ROWS = 3000
TRAIN_CHARS = 16_000_000
#: Probability of any character that nothing is known of.
FLOOR = 1 / 500
BLOCK = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Of each code point the lower-case letter that it counts as, else a space."""
    global _letters
    if _letters is None:
        own = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                own[c] = ord(x.lower()[0])
        _letters = own
    return _letters


def normalised(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, where each text starts); each begins and ends
    with a space, an empty one is a space alone."""
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    out = letters()[raw]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    keep[first] = True
    return out[keep], (np.cumsum(keep) - 1)[first]


def places(n: int, starts: np.ndarray) -> np.ndarray:
    """Place of each character in its text."""
    size = np.diff(np.r_[starts, n])
    return np.arange(n) - np.repeat(starts, size)


def longer(h: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the grams of n characters that end at each place, from those of
    n - 1; places under n - 1 hold nothing of use."""
    out = h.copy()
    if n <= len(chars):
        out[n - 1 :] = (out[n - 1 :] ^ (chars[: len(chars) - n + 1].astype(np.uint64) + np.uint64(1))) * MIX
        out ^= out >> np.uint64(29)
    return out


def count_grams(texts: list, order: int = ORDER):
    """(n, gram, context, shorter gram, count) arrays for each order; a text's
    first space is context only."""
    chars, starts = normalised(texts)
    place = places(len(chars), starts)
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, order + 1):
        below, h = h, longer(h, chars, n)
        at = np.flatnonzero((place >= n - 1) & (place > 0))
        g, first, count = np.unique(h[at], return_index=True, return_counts=True)
        at = at[first]
        yield n, g, below[at - 1] if n > 1 else np.zeros(len(at), np.uint64), below[at], count


class TwoModels:
    """Log-ratios of the two classes' probabilities.

    ``grams[n]``: (gram, context, shorter gram, ordinary count, toxic count) of
    order n."""

    def __init__(self, grams: dict[int, tuple], order: int = ORDER, shared: int = SHARED, discount: float = DISCOUNT):
        self.order = order
        self.tables: list = [None]
        below = None
        for n in range(1, order + 1):
            by = np.argsort(grams[n][0], kind="stable")
            gram, context, shorter, *own = (np.asarray(x)[by] for x in grams[n])
            if n <= shared:
                more = np.searchsorted(gram, np.asarray(grams[n + 1][2])) if n < order else None
                there = np.bincount(more, minlength=len(gram)).astype(float) if n < order else own[0] + own[1]
                counts, d = (there, there), min(DISCOUNT, discount)
            else:
                counts, d = (own[0].astype(float), own[1].astype(float)), discount
            contexts, at = np.unique(context, return_inverse=True)
            p, rest = [], []
            for k in (0, 1):
                low = np.full(len(gram), FLOOR) if n == 1 else below[k][np.searchsorted(self.tables[-1][0], shorter)]
                total = np.bincount(at, counts[k], len(contexts))
                left = np.bincount(at, np.minimum(counts[k], d), len(contexts))
                weight = np.divide(left, total, out=np.ones(len(contexts)), where=total > 0)
                top = np.divide(np.maximum(counts[k] - d, 0), total[at], out=np.zeros(len(gram)), where=total[at] > 0)
                p.append(top + weight[at] * low)
                rest.append(weight)
            below = p
            self.tables.append((gram, np.log(p[1] / p[0]), contexts, np.log(rest[1] / rest[0])))

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that are found, where)."""
        at = np.searchsorted(sorted_, x)
        at[at == len(sorted_)] = 0
        return sorted_[at] == x, at

    def ratios(self, chars: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each character the toxic log-probability less the ordinary one."""
        hashes = [np.zeros(len(chars), np.uint64)]
        for n in range(1, self.order + 1):
            hashes.append(longer(hashes[-1], chars, n))
        out = np.zeros(len(chars))
        rest = np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            gram, ratio, contexts, weight = self.tables[n]
            deep = place[rest] >= n - 1
            here, wait = rest[deep], rest[~deep]
            if not len(gram) or not len(here):
                continue
            hit, at = self._find(gram, hashes[n][here])
            out[here[hit]] += ratio[at[hit]]
            here = here[~hit]
            if n > 1 and len(here):
                hit, at = self._find(contexts, hashes[n - 1][here - 1])
                out[here[hit]] += weight[at[hit]]
            rest = np.r_[here, wait]
        return out

    def evidence(self, texts: list, window: int = WINDOW) -> np.ndarray:
        """Greatest difference a character of each text's passages."""
        out, group, size = np.zeros(len(texts)), [], 0
        for i, t in enumerate(texts):
            n = len(t or "")
            if n > BLOCK:
                out[i] = self._long(t, window)
                continue
            if size + n > BLOCK:
                out[group] = self._group([texts[j] for j in group], window)
                group, size = [], 0
            group.append(i)
            size += n + 2
        if group:
            out[group] = self._group([texts[j] for j in group], window)
        return out

    def _group(self, texts: list, window: int) -> np.ndarray:
        chars, starts = normalised(texts)
        place = places(len(chars), starts)
        return np.round(np.maximum.reduceat(passages(self.ratios(chars, place), place, window), starts), 9)

    def _long(self, text: str, window: int) -> float:
        """A long text by blocks, with what each needs of those before."""
        best, place = -np.inf, 0
        chars, before = np.zeros(0, np.uint32), np.zeros(0)
        for a in range(0, len(text), BLOCK):
            piece = (" " if a == 0 else "") + text[a : a + BLOCK] + (" " if a + BLOCK >= len(text) else "")
            own = letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")]
            own = own[(own != SPACE) | (np.r_[chars[-1:] if a else np.zeros(1, np.uint32), own[:-1]] != SPACE)]
            if not len(own):
                continue
            chars = np.r_[chars[-self.order :], own]
            old = len(chars) - len(own)
            each = np.r_[before, self.ratios(chars, place - old + np.arange(len(chars)))[old:]]
            best = max(best, float(passages(each, place - len(before) + np.arange(len(each)), window)[len(before) :].max()))
            before = each[-(window - 1) :]
            place += len(own)
        return round(best, 9)


def passages(each: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Of each place the greatest sum of up to ``window`` of its text's values
    that end there, divided by ``window``."""
    total = np.cumsum(each)
    low = total - each  # the least sum before a start among the last places, by doubling
    span = 1
    while span < min(window, len(low)):
        s = min(span, window - span, len(low) - 1)
        low[s:] = np.where(place[s:] >= s, np.minimum(low[s:], low[: len(low) - s]), low[s:])
        span += s
    return (total - low) / window


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method."""
    scale = x.std() or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / scale, w[1]


def sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """(all labels (key, _y), the sampled documents (key, _text, _y))."""
    own = labels.select(key, F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col(key).isNotNull()).distinct()
    some = bounded_sample(own, key, "_y", rows)
    train = docs.select(key, F.col(text).cast("string").alias("_text")).join(F.broadcast(some), key).groupBy(key, "_y").agg(F.min("_text").alias("_text"))
    # 2 * rows lengths at most
    size = train.select(key, "_y", F.xxhash64(key).alias("h"), F.coalesce(F.length("_text"), F.lit(0)).alias("n")).collect()
    taken, kept = [0, 0], []
    for r in sorted(size, key=lambda r: (r.h, r[key])):
        if taken[r["_y"]] + r.n <= chars:
            taken[r["_y"]] += r.n
            kept.append((r[key], r["_y"]))
    if len(kept) < len(size):
        train = train.join(F.broadcast(docs.sparkSession.createDataFrame(kept, own.schema)), [key, "_y"], "left_semi")
    return own, train


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """(models, slope, offset).  Three of four sampled documents give counts, the
    others fit the curve; counting runs on the executors."""
    own, train = sampled(docs, labels, key, text, label, rows, chars)
    train = train.withColumn("_fit", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(4)) == 0)

    def count(batches):
        texts: tuple[list, list] = ([], [])
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts[y].append(t)
        for y in (0, 1):
            for at in range(0, len(texts[y]), 200):
                for n, *cols, c in count_grams(texts[y][at : at + 200]):
                    ids = [pa.array(x.view(np.int64)) for x in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n, np.int32)), *ids, pa.array(c * (y == 0)), pa.array(c * (y == 1))], names=["n", "gram", "context", "shorter", "a", "b"])

    got = mapped(train.where(~F.col("_fit")).select("_text", "_y"), count, "n int, gram long, context long, shorter long, a long, b long")
    got = got.groupBy("n", "gram").agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    order = got.column("n").to_numpy()
    cols = [got.column(c).to_numpy() for c in ("gram", "context", "shorter", "a", "b")]
    if not len(order) or not cols[3].any() or not cols[4].any():
        return None
    model = TwoModels({n: tuple(c[order == n].view(np.uint64) if i < 3 else c[order == n] for i, c in enumerate(cols)) for n in range(1, ORDER + 1)})
    fit = evidence(train.where("_fit").select(key, "_text", "_y"), model, key, "_text", "_y").toArrow()
    x, y = fit.column("evidence").to_numpy(), fit.column("_y").to_numpy()
    if not 0 < y.sum() < len(y):
        return model, 50.0, -1.0
    slope, offset = logistic(x, y)
    share = dict(own.groupBy("_y").count().collect())  # two rows
    return model, float(slope), float(offset + np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum())))


def _scorer(spark: SparkSession, model: TwoModels):
    """Evidence of a list of texts, in workers."""
    own = spark.sparkContext.broadcast(model)
    return lambda texts: own.value.evidence(texts)


def _pieces(whole: pa.RecordBatch, texts: int):
    """Slices of a batch of some hundred texts each; column ``texts`` has them."""
    for at in range(0, whole.num_rows, 300):
        b = whole.slice(at, 300)
        yield b, b.column(texts).to_pylist()


def evidence(df: DataFrame, model: TwoModels, key: str, text: str, *carry: str) -> DataFrame:
    """(key, *carry, evidence) for every row of ``df``; no shuffle."""
    of = _scorer(df.sparkSession, model)
    src = df.select(F.col(key), *carry, F.col(text).cast("string").alias("_t"))

    def run(batches):
        for whole in batches:
            for b, texts in _pieces(whole, whole.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(of(texts), pa.float64())], names=[*b.schema.names[:-1], "evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return mapped(src, run, f"{fields}, evidence double")


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, evidence, score) for every row of ``docs``."""
    if model is None:
        return docs.select(key, F.lit(0.0).alias("evidence"), F.lit(0.0).alias("score"))
    own, slope, offset = model
    return evidence(docs, own, key, text).withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") * slope + offset))))


def accept(docs: DataFrame, model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they
    are; no shuffle."""
    if model is None:
        return docs
    own, slope, offset = model
    of, column = _scorer(docs.sparkSession, own), docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for b, texts in _pieces(whole, column):
                yield b.filter(pa.array(1 / (1 + np.exp(-(of(texts) * slope + offset))) < threshold))

    return mapped(docs, run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
