"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document is as many words as a benchmark item has.  Windows and
items are fingerprinted by their five-word shingles (repeats included).  A
multi-index of BLOCKS Hamming blocks has, for each block, the items in order of
that block's value; a window looks up all values within RADIUS // BLOCKS bits of
its own, which meets every item within RADIUS bits and touches only the matching
buckets.  Candidates are verified by the exact weighted similarity: of each
shingle's counts in window and item, the sum of the smaller over the sum of the
larger, best over all windows.

Matches whose fingerprints lie beyond the radius are found exactly: by that
formula a window needs t / (1 + t) of both sizes' sum in shared shingles, so
postings of the known shingles bound what a document shares with each item, and
items that reach the bound without a fingerprint within the radius are verified
like the others.  The same bound spares windows with too few known shingles
their fingerprint.

Words are split at white space, lower-cased and stripped of what is neither
letter nor digit; words of nothing else are left out.  Items of under five words
are one shingle of their own length.  A document shorter than an item is one
window.  Null and empty texts and items match nothing; items with a null id count
like others, as one item; of several windows that match an item the most similar,
then the first, is returned; repeated rows give repeated results, repeated items
count once, an empty table on either side gives none.  Ids keep their types;
other columns may have any names.

The benchmark is taken in blocks of ITEMS different rows and MAX_WORDS words at
most (about a hundred MB in a worker), each broadcast and met by one scan of the
documents, which are neither shuffled nor joined: one scan in all for benchmarks
of up to some 4 million words.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodalis.llm.common import mapped, table

SHINGLE = 5
LEAST = 0.8
#: Somewhat beyond the mean distance (9.7 bits) of windows just at the least similarity.
RADIUS = 11
BLOCKS = 4
#: Benchmark rows, and words of them, that are broadcast at once.
ITEMS = 200_000
MAX_WORDS = 4_000_000
CACHE = 400_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hash of each written word; 0 for words without letters and digits."""

    def __missing__(self, raw: str) -> int:
        a, b = 0, len(raw)
        while a < b and not raw[a].isalnum():
            a += 1
        while b > a and not raw[b - 1].isalnum():
            b -= 1
        h = xxhash.xxh64_intdigest(raw[a:b].lower().encode()) | 1 if b > a else 0
        if len(self) >= CACHE:
            self.clear()
        if len(raw) <= 64:
            self[raw] = h
        return h


def hashes(words: Words, text: str | None) -> np.ndarray:
    raw = (text or "").split()
    h = np.fromiter(map(words.__getitem__, raw), np.uint64, len(raw))
    return h[h != 0]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def votes(s: np.ndarray) -> np.ndarray:
    """Running sums of the bits of shingle hashes (one row more than shingles)."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(s) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=out[1:])
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class HammingBlocks:
    """Multi-index over fingerprints: of each block the items in order of its value."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.fps, self.radius = fps, radius
        bits = 64 // blocks
        values = np.arange(1 << bits, dtype=np.uint64)
        self.near = values[np.bitwise_count(values) <= radius // blocks]  # what a block's value may differ by
        self.parts = [(np.uint64(b * bits), np.uint64((1 << bits) - 1)) for b in range(blocks)]
        self.order = [np.argsort(self._part(fps, b), kind="stable") for b in range(blocks)]
        self.sorted = [self._part(fps, b)[self.order[b]] for b in range(blocks)]

    def _part(self, fps: np.ndarray, b: int) -> np.ndarray:
        shift, mask = self.parts[b]
        return fps >> shift & mask

    def pairs(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the queried, number of the indexed) of all pairs within the
        radius, in order."""
        out = [np.zeros(0, np.int64)]
        for a in range(0, len(fps), 1000):
            q = fps[a : a + 1000]
            for b in range(len(self.parts)):
                keys = (self._part(q, b)[:, None] ^ self.near).ravel()
                first, last = np.searchsorted(self.sorted[b], keys), np.searchsorted(self.sorted[b], keys, "right")
                some = np.flatnonzero(last > first)
                size = last[some] - first[some]
                at = np.repeat(first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                x, y = np.repeat(some // len(self.near), size), self.order[b][at]
                ok = np.bitwise_count(q[x] ^ self.fps[y]) <= self.radius
                out.append((x[ok] + a) * len(self.fps) + y[ok])
        both = np.unique(np.concatenate(out))
        return both // len(self.fps), both % len(self.fps)

    def within(self, fp: np.uint64) -> np.ndarray:
        """Numbers of all fingerprints within the radius."""
        return self.pairs(np.array([fp], np.uint64))[1]


class Items:
    """Items of one shingle size: their shingles, postings and fingerprints."""

    def __init__(self, k: int, own: list[tuple], least: float):
        self.k, self.least = k, least
        self.ids = [i for i, _ in own]
        self.n = np.array([len(s) for _, s in own])
        self.all, at = np.unique(np.concatenate([s for _, s in own]), return_inverse=True)
        who = np.repeat(np.arange(len(own)), self.n)
        pair, count = np.unique(who * len(self.all) + at, return_counts=True)
        # of each item its different shingles, ascending, and their counts
        self.item, self.shingle, self.count = pair // len(self.all), pair % len(self.all), count
        self.starts = np.searchsorted(self.item, np.arange(len(own) + 1))
        # of each shingle its items
        self.post = np.argsort(self.shingle, kind="stable")
        self.post_starts = np.searchsorted(self.shingle[self.post], np.arange(len(self.all) + 1))
        self.fps = np.concatenate([pack(votes(s)[-1:] * 2 > len(s)) for _, s in own])
        sizes = np.unique(self.n)
        self.groups = [(int(n), np.flatnonzero(self.n == n)) for n in sizes]
        self.blocks = [HammingBlocks(self.fps[g]) for _, g in self.groups]
        # a table by low bits spares most look-ups
        bits = min(26, max(16, len(self.all).bit_length() + 4))
        self.low, self.there = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.there[(self.all & self.low).view(np.int64)] = True
        #: shared shingles that any window needs at least
        self.least_need = min(self.need(n, w) for n in sizes for w in (n, int(np.ceil(least * n - 1e-9))))

    def need(self, n, w):
        """Shingles that a window of w and an item of n must share."""
        return self.least / (1 + self.least) * (n + w) - 1e-9

    def known(self, s: np.ndarray) -> np.ndarray:
        """Numbers of shingles, -1 for those of no item."""
        out = np.full(len(s), -1)
        at = np.flatnonzero(self.there[(s & self.low).view(np.int64)])
        place = np.searchsorted(self.all, s[at])
        place[place == len(self.all)] = 0
        ok = self.all[place] == s[at]
        out[at[ok]] = place[ok]
        return out

    def shared(self, known: np.ndarray) -> np.ndarray:
        """Of each item the most shingles that any window can share with it."""
        own, n = np.unique(known[known >= 0], return_counts=True)
        first = self.post_starts[own]
        size = self.post_starts[own + 1] - first
        rows = self.post[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return np.bincount(self.item[rows], np.minimum(np.repeat(n, size), self.count[rows]), len(self.n))

    def best(self, i: int, known: np.ndarray):
        """(first shingle, shingles, similarity) of the most similar window for
        item i, None if none is similar enough."""
        n, w = int(self.n[i]), min(int(self.n[i]), len(known))
        own, count = (x[self.starts[i] : self.starts[i + 1]] for x in (self.shingle, self.count))
        place = np.searchsorted(own, known)
        place[place == len(own)] = 0
        hit = own[place] == known
        total = np.r_[0, np.cumsum(hit)]
        found = None
        for at in np.flatnonzero(total[w:] - total[: len(total) - w] >= self.need(n, w)).tolist():
            inside = place[at : at + w][hit[at : at + w]]
            low = int(np.minimum(np.bincount(inside, minlength=len(own)), count).sum())
            sim = low / (n + w - low)
            if sim >= self.least and (found is None or sim > found[2]):
                found = (at, w, sim)
        return found

    def matches(self, s: np.ndarray, beyond: bool = True) -> list[tuple]:
        """(id, first word, words, similarity, differing bits) for each item in
        shingles ``s``; without ``beyond`` only those that fingerprints find."""
        known = self.known(s)
        total = np.r_[0, np.cumsum(known >= 0)]
        if total[-1] < self.least_need:
            return []
        near: set[int] = set()
        sums = None
        for (n, group), blocks in zip(self.groups, self.blocks, strict=True):
            w = min(n, len(s))
            if w < self.least * n:
                continue
            starts = np.flatnonzero(total[w:] - total[: len(total) - w] >= self.need(n, w))
            if len(starts):
                sums = votes(s) if sums is None else sums
                near.update(group[np.unique(blocks.pairs(pack((sums[starts + w] - sums[starts]) * 2 > w))[1])].tolist())
        if beyond:
            w = np.minimum(self.n, len(s))
            near.update(np.flatnonzero((w >= self.least * self.n) & (self.shared(known) >= self.need(self.n, w))).tolist())
        out = []
        for i in sorted(near):
            if (got := self.best(i, known)) is not None:
                at, w, sim = got
                sums = votes(s) if sums is None else sums
                fp = pack((sums[at + w : at + w + 1] - sums[at : at + 1]) * 2 > w)[0]
                out.append((self.ids[i], at, w + self.k - 1, sim, int(np.bitwise_count(fp ^ self.fps[i]))))
        return out


class Benchmark:
    """Items of a block, by shingle size."""

    def __init__(self, items: list[tuple], least: float = LEAST):
        self.words = Words()
        by: dict[int, list] = {}
        for item, text in items:
            h = hashes(self.words, text)
            if len(h):
                k = min(SHINGLE, len(h))
                by.setdefault(k, []).append((item, shingles(h, k)))
        self.sizes = [Items(k, own, least) for k, own in sorted(by.items())]

    def batch(self, texts: list, beyond: bool = True) -> list[list[tuple]]:
        """``matches`` of each text; texts with too few known shingles are left
        out by one pass over all of them."""
        own = [hashes(self.words, t) for t in texts]
        h = np.concatenate([*own, np.zeros(0, np.uint64)])
        size = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(size)
        some = np.zeros(len(own), bool)
        for items in self.sizes:
            hit = items.known(shingles(h, items.k)) >= 0
            total = np.r_[0, np.cumsum(hit)]
            # shingles that begin in a text, even if they end in the next: too many, never too few
            a, b = np.minimum(ends - size, len(hit)), np.minimum(ends, len(hit))
            some |= total[b] - total[a] >= items.least_need
        return [self.matches(h, beyond) if ok else [] for h, ok in zip(own, some.tolist(), strict=True)]

    def matches(self, h: np.ndarray, beyond: bool = True) -> list[tuple]:
        """(item, first word, words, similarity, differing bits) for each item
        in a text of word hashes ``h``; of rows of one id the most similar."""
        best: dict = {}
        for items in self.sizes:
            s = shingles(h, items.k)
            for i, *rest in items.matches(s, beyond) if len(s) else ():
                if i not in best or rest[2] > best[i][2]:
                    best[i] = rest
        return [(i, *b) for i, b in best.items()]


_models: dict[str, Benchmark] = {}


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Bounded lists of (item, text), different ones."""
    src = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct()
    size = src.agg(F.count("*").alias("n"), F.sum(F.size(F.split("t", r"\s+"))).alias("w")).first()
    n = max(1, -(-size.n // ITEMS), -(-(size.w or 0) // MAX_WORDS))
    for b in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        got = part.toArrow()
        yield sorted(zip(got.column("i").to_pylist(), got.column("t").to_pylist(), strict=True), key=lambda x: (str(x[0]), x[1]))


def _mapped(df: DataFrame, items: list, text: str, least: float):
    """(the worker's Benchmark, a function of the batches) for a block of items."""
    model, mark = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Benchmark:
        if mark not in _models:
            _models.clear()
            _models[mark] = Benchmark(model.value, least)
        return _models[mark]

    return get


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, item_id, start_word, n_words, similarity, differing_bits): one row
    for each document and item that it holds."""
    src = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind, item_kind = src.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    item_type = to_arrow_type(item_kind)
    out = None
    for items in _blocks(benchmark, item, item_text):
        get = _mapped(df, items, text, least)

        def run(batches, get=get):
            m = get()
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    own, rows = [], []
                    for i, got in enumerate(m.batch(b.column(1).to_pylist())):
                        for r in got:
                            own.append(i)
                            rows.append(r)
                    cols = list(zip(*rows, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(own, pa.int64())), pa.array(cols[0], item_type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())],
                        names=[key, "item_id", "start_word", "n_words", "similarity", "differing_bits"],
                    )

        part = mapped(src, run, f"`{key}` {kind}, item_id {item_kind.simpleString()}, start_word int, n_words int, similarity double, differing_bits int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``df`` that hold no item, all columns as they are; no shuffle."""
    for items in _blocks(benchmark, item, item_text):
        get = _mapped(df, items, text, least)

        def run(batches, get=get):
            m = get()
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    texts = b.column(b.schema.get_field_index(text)).to_pylist()
                    yield b.filter(pa.array([not got for got in m.batch(texts)], pa.bool_()))

        df = mapped(df, run, df.schema)
    return df


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
