"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree with frozen counts
(contexts of up to ORDER bytes).  A symbol seen in its context costs
-log2(n / (total + distinct)), else an escape -log2(distinct / (total +
distinct)) and the cost in the next shorter context; contexts a language never
saw are passed over free; below order 0 all 256 bytes are equal.  A document's
code length in a language is the exact sum over its UTF-8 bytes and the
shortest wins, ties to the smaller name.

The trees of all languages share one node numbering, so code lengths of a
batch come from a few vectorised table look-ups for each byte.

The driver and each worker hold the trees: up to TRAIN_ROWS whole documents a
language, so their size grows with the number of languages (dense count tables;
some hundred are fine), not with the input.

Null texts and texts without a letter (Unicode category L) get ``und`` and score
0.  Without any
learned language every text is ``und``.  Very long texts are scored in blocks;
results do not depend on the block.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import bounded_sample, held_out, mapped, table

ORDER = 3
#: Labelled documents a language is learned from, at most (whole texts).
TRAIN_ROWS = 400
BLOCK = 1 << 20
#: Candidates for letters; numerals such as a half or a superscript are among them.
LETTER = re.compile(r"[^\W\d_]")
PAD = b"\n" * ORDER


def has_letter(text: str) -> bool:
    """Whether a text has a character of the letter categories."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def count_grams(texts: list[bytes], order: int = ORDER) -> list[dict[bytes, int]]:
    """Counts of all grams of 1 to order + 1 bytes, each text begun with PAD."""
    out = []
    for n in range(1, order + 2):
        c: Counter = Counter()
        for t in texts:
            buf = np.frombuffer(PAD + t, np.uint8)
            # grams that end on a byte of the text itself
            at = np.arange(ORDER, len(buf))
            code = np.zeros(len(at), np.uint32)
            for k in range(n):
                code = code << np.uint32(8) | buf[at - (n - 1 - k)].astype(np.uint32)
            u, m = np.unique(code, return_counts=True)
            c.update(dict(zip(u.tolist(), m.tolist(), strict=True)))
        out.append(dict(c))
    return out


class ByteTrees:
    """Frozen context trees of several languages over shared nodes."""

    def __init__(self, grams: dict[str, list[dict[int, int]]], order: int = ORDER):
        self.langs = sorted(grams)
        self.order = order
        size, n_lang = order + 1, len(self.langs)
        codes = [np.array(sorted({g for lang in self.langs for g in grams[lang][k]}), np.uint32) for k in range(size)]
        for k in range(size - 1, 0, -1):  # every context is a node, that of a text's begin too
            codes[k - 1] = np.union1d(codes[k - 1], codes[k] >> np.uint32(8))
        self.symbol = np.zeros(256, np.int32)  # 0: a byte no language saw
        self.symbol[codes[0]] = np.arange(1, len(codes[0]) + 1)
        self.width = len(codes[0]) + 1
        counts = []
        for k in range(size):
            m = np.zeros((len(codes[k]) + 1, n_lang))
            for j, lang in enumerate(self.langs):
                d = grams[lang][k]
                if d:
                    m[np.searchsorted(codes[k], np.fromiter(d.keys(), np.uint32, len(d))) + 1, j] = list(d.values())
            counts.append(m)

        def node(k: int, code: np.ndarray) -> np.ndarray:
            """Numbers of grams of k + 1 bytes; 0 if unseen."""
            at = np.searchsorted(codes[k], code)
            at[at == len(codes[k])] = 0
            return np.where(codes[k][at] == code, at + 1, 0)

        # next[k][node of k bytes, symbol]: node of the gram of k + 1 bytes
        self.next = [None]
        for k in range(1, size):
            step = np.zeros((len(codes[k - 1]) + 1, self.width), np.int32)
            own = node(k - 1, codes[k] >> np.uint32(8))
            step[own, self.symbol[(codes[k] & np.uint32(255)).astype(int)]] = np.arange(1, len(codes[k]) + 1)
            step[0] = 0
            self.next.append(step)
        # cost[k][gram of k + 1 bytes], escape[k][context of k bytes]; row 0 costs nothing
        self.cost, self.escape = [], []
        base = np.full((256 + 1, n_lang), 8.0)
        for k in range(size):
            total, kinds = np.zeros((1 if k == 0 else len(codes[k - 1]) + 1, n_lang)), None
            kinds = np.zeros_like(total)
            own = np.zeros(len(codes[k]), int) if k == 0 else node(k - 1, codes[k] >> np.uint32(8))
            np.add.at(total, own, counts[k][1:])
            np.add.at(kinds, own, counts[k][1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own_cost = -np.log2(counts[k][1:] / (total[own] + kinds[own]))
            if k:
                esc[0] = 0
                below = node(k - 1, codes[k] & np.uint32((1 << 8 * k) - 1))
                low = self.cost[k - 1][below]
                # a shorter gram is in the tree whenever the longer one is
            else:
                low = base[:1].repeat(len(codes[0]), 0)
            cost = np.zeros((len(codes[k]) + 1, n_lang))
            cost[1:] = np.where(counts[k][1:] > 0, own_cost, esc[own] + low)
            self.cost.append(cost)
            self.escape.append(esc)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size, first = [], 0, 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t)), BLOCK):
                if size + len(t) - at > BLOCK and group:
                    self._add(group, out)
                    group, size = [], 0
                before = PAD if at == 0 else t[at - ORDER : at]
                group.append((i, before + t[at : at + BLOCK]))
                size += min(BLOCK, len(t) - at)
        if group:
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        buf = np.frombuffer(b"".join(x for _, x in group), np.uint8)
        sizes = np.array([len(x) for _, x in group])
        ends = np.cumsum(sizes)
        body = np.ones(len(buf), bool)
        for k in range(ORDER):
            body[ends - sizes + k] = False
        sym = self.symbol[buf]
        grams = [sym]
        for k in range(1, self.order + 1):
            g = np.zeros(len(buf), np.int32)
            g[1:] = self.next[k][grams[-1][:-1], sym[1:]]
            grams.append(g)
        cost = np.zeros((len(buf), len(self.langs)))
        open_at = np.flatnonzero(body)
        for k in range(self.order, -1, -1):
            node = grams[k][open_at]
            hit = node > 0
            cost[open_at[hit]] += self.cost[k][node[hit]]
            open_at = open_at[~hit]
            if not len(open_at):
                break
            cost[open_at] += self.escape[k][grams[k - 1][open_at - 1]] if k else self.escape[0][0]
        cost[open_at] += 8.0
        np.add.at(out, [i for i, _ in group], np.add.reduceat(cost * body[:, None], ends - sizes, axis=0))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> dict[str, list[dict[int, int]]]:
    """Gram counts of each language from at most ``rows`` whole documents of it.
    Counting runs on the executors; the driver gets counts only."""
    src = df.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # of a document that repeats, one text counts
    some = bounded_sample(src, key, lang, rows).groupBy(key, lang).agg(F.min(text).alias("_text")).select(F.col(lang).alias("lang"), F.col("_text").alias("text"))

    def count(batches):
        texts: dict[str, list[bytes]] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(t.encode())
        for name, own in texts.items():
            for k, c in enumerate(count_grams(own)):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(c)), pa.array([k] * len(c), pa.int32()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["lang", "k", "gram", "n"])

    got = mapped(some, count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, list[dict[int, int]]] = {}
    for name, k, g, n in zip(*(got.column(c).to_pylist() for c in ("lang", "k", "gram", "n")), strict=True):
        out.setdefault(name, [{} for _ in range(ORDER + 1)])[k][g] = n
    return out


_trees: dict[str, ByteTrees] = {}


def identify(df: DataFrame, grams: dict[str, list[dict[int, int]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits) for each row of ``df``; bits is the code
    length in the predicted language.  The score is the posterior under equal
    priors of the languages."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(grams)
    mark = uuid.uuid4().hex
    src = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches):
        if mark not in _trees:
            _trees.clear()
            _trees[mark] = ByteTrees(model.value)
        trees = _trees[mark]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                ok = [bool(trees.langs) and t is not None and has_letter(t) for t in texts]
                lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                if any(ok):
                    at_ = [i for i, x in enumerate(ok) if x]
                    length = trees.code_lengths([texts[i].encode() for i in at_])
                    best = length.argmin(1)
                    low = length.min(1)
                    p = 1 / np.exp2(-np.minimum(length - low[:, None], 1000)).sum(1)
                    for i, j, s, n in zip(at_, best.tolist(), p.tolist(), low.tolist(), strict=True):
                        lang[i], score[i], bits[i] = trees.langs[j], s, n
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[key, "lang_pred", "score", "bits"])

    kind = src.schema[key].dataType.simpleString()
    return mapped(src, run, f"`{key}` {kind}, lang_pred string, score double, bits double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grams = learn(docs.where(~held_out()))
    return identify(docs, grams).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
