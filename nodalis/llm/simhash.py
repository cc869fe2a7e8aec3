"""SimHash fingerprints and near-duplicate groups over a Gray-order index.

Fingerprints: texts are lower-cased (A-Z), cut into words at space and control
white space, and hashed by shingles of ``k`` words (XXH64, seed 42, repeats
included); a bit is 1 if set in over half the hashes.  Fewer words than k make
one shingle, no words the fingerprint zero.  The wide search for near copies
counts each distinct shingle once, since its measure is of sets.

Search: distinct fingerprints are dealt out by masked keys, so that whatever may
link shares a group, and every group is searched through a hierarchical index in
Gray order: sorted by Gray rank, neighbours form leaves; each node keeps the bits
its members share and its parent does not; a query adds up differences on the
way down and drops a whole node once they exceed the radius.  Groups above
GROUP_ROWS are split into pairs of chunks, so none needs one task.

Links within a group are kept as a spanning forest (the least that carries the
same components): a group of n copies gives n - 1 edges, not n squared.  Near
copies whose sketches leave doubt are checked exactly along such a forest; where
an edge is refused, the texts of what it would have joined are compared exactly
in place, and again only a forest leaves the task.

Two families of masks: ``exact_masks`` (each pair within the radius agrees on
at least one mask) and ``sampled_masks`` for radii where no small exact family
exists (the chance of a miss is a parameter).

Null text is the empty text.  Repeated rows collapse on their fingerprint
before any search.  An empty table gives an empty table.  A null doc_id keeps
its row, and never becomes a component's id while its group has another.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import HOT_KEYS, cut, if_small, mapped, salted_join, table
from nodalis.llm.components import components

SEED = 42
#: Rows of a group that one task takes at once.
GROUP_ROWS = 16_384
#: Doubtful pairs (and edges) that a task holds at once, about.
DOUBTFUL = 500_000
#: Codes in a leaf and children of a node.
FAN = 16
#: Bins of the one-permutation MinHash sketch (a byte each) that checks wide-radius candidates.
BINS = 128


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, as uint64."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - k + 1].tolist()
    h = xxhash.xxh64_digest
    return np.frombuffer(b"".join([h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation MinHash of BINS bins, a byte of each bin's smallest hash;
    0 marks an empty bin."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
        order = np.sort(mixed)
        bins = (order >> np.uint64(64 - 7)).astype(np.int64)
        where, first = np.unique(bins, return_index=True)
        out[where] = (order[first] >> np.uint64(20)).astype(np.uint8) % 255 + 1
    return out.tobytes()


def fingerprints(df: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text", with_sketch: bool = False, distinct: bool = False) -> DataFrame:
    """(key, fp long[, sketch binary]) for every row of ``df``; no shuffle.  If
    ``distinct``, a shingle votes once however often it stands in a text."""
    src = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    names = [key, "fp", *(["sketch"] if with_sketch else [])]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                fps, sketches = [], []
                for t in b.column(1).to_pylist():
                    h = shingle_hashes(t, k)
                    fps.append(fingerprint(np.unique(h) if distinct else h))
                    if with_sketch:
                        sketches.append(sketch(h))
                cols = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(sketches, pa.binary())] if with_sketch else []), names=names)

    kind = src.schema[key].dataType.simpleString()
    return mapped(src, run, f"`{key}` {kind}, fp long" + (", sketch binary" if with_sketch else ""))


# --- masks ------------------------------------------------------------------


def exact_masks(radius: int, keep: int = 2) -> list[int]:
    """Masks of which every pair of fingerprints within ``radius`` agrees on one:
    radius + keep blocks, each choice of ``keep`` of them a mask."""
    n = radius + keep
    cuts = [round(64 * i / n) for i in range(n + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(n)]
    return [sum(block[i] for i in c) for c in combinations(range(n), keep)]


def sampled_masks(rows: int, differ: float, miss: float, per_group: int = 4096) -> list[int]:
    """Random masks with log2(rows / per_group) bits, so groups of unrelated
    fingerprints keep about ``per_group`` rows at any size, and as many that a
    pair whose bits differ with chance ``differ`` shares none with chance
    ``miss`` at most."""
    bits = max(4, math.ceil(math.log2(max(1, rows) / per_group))) if rows > per_group else 4
    chance = [math.comb(64, d) * differ**d * (1 - differ) ** (64 - d) for d in range(65)]
    meet = [math.comb(64 - d, bits) / math.comb(64, bits) for d in range(65)]
    n = 1
    while sum(c * (1 - p) ** n for c, p in zip(chance, meet, strict=True)) > miss:
        n += 1
    # whole random partitions of the 64 bits: within one, differences can't hit all masks by chance alike
    r, out = random.Random(20240101), []
    while len(out) < n:
        order = r.sample(range(64), 64)
        out += [sum(1 << b for b in order[i : i + bits]) for i in range(0, 64 - bits + 1, bits)]
    return out


# --- the index --------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Static hierarchical index over distinct codes.

    ``levels[0]`` are the codes themselves in Gray order; node i of a level
    covers nodes FAN*i .. FAN*i+FAN-1 of the level below.  For each level:
    ``mask`` (bits that all codes below share and the parent does not factor
    out) and ``bits`` (their values)."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        shared, value = [np.full(len(codes), ones)], [self.codes]
        both, either = self.codes, self.codes
        while len(both) > FAN:
            at = np.arange(0, len(both), FAN)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
            shared.append(~(both ^ either))
            value.append(both)
        self.mask, self.bits = [], []
        for k, (s, v) in enumerate(zip(shared, value, strict=True)):
            up = np.zeros(len(s), np.uint64) if k + 1 == len(shared) else shared[k + 1][np.arange(len(s)) // FAN]
            self.mask.append(s & ~up)
            self.bits.append(v & s & ~up)

    def __len__(self) -> int:
        return len(self.codes)

    def within(self, queries: np.ndarray, radius: int, skip=None):
        """(query number, place in Gray order, distance) of all codes within the
        radius.  ``skip(level, query numbers, nodes)`` may say which nodes need
        no visit."""
        top = len(self.mask) - 1
        q = np.repeat(np.arange(len(queries)), len(self.mask[top]))
        node = np.tile(np.arange(len(self.mask[top])), len(queries))
        dist = np.zeros(len(q), np.uint8)
        for k in range(top, -1, -1):
            dist = dist + np.bitwise_count((queries[q] ^ self.bits[k][node]) & self.mask[k][node])
            ok = dist <= radius
            if skip is not None:
                ok &= ~skip(k, q, node)
            q, node, dist = q[ok], node[ok], dist[ok]
            if k:
                below = len(self.mask[k - 1])
                q, dist = np.repeat(q, FAN), np.repeat(dist, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = node < below
                q, node, dist = q[ok], node[ok], dist[ok]
        return q, node, dist


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches."""
    some = (a != 0) | (b != 0)
    return ((a == b) & some).sum(1) / np.maximum(1, some.sum(1))


def forest(codes: np.ndarray, radius: int, sketches: np.ndarray | None = None, least: float = 0.0, sure: float = 0.0) -> list[tuple[int, int, float]]:
    """Edges (numbers of codes, similarity) that join all codes linked within the
    radius; with sketches all those of ``links``."""
    return [edge for block in links(codes, radius, sketches, least, sure) for edge in block]


def links(codes: np.ndarray, radius: int, sketches: np.ndarray | None = None, least: float = 0.0, sure: float = 0.0):
    """Blocks of edges (numbers of codes, similarity): a spanning forest of all
    codes linked within the radius.  With sketches, an edge needs an estimated
    similarity of ``least``; those of ``sure`` or more make the forest, and of the
    doubtful pairs that it leaves apart the most similar ones that join its trees
    follow, so every doubtful pair's ends are joined by edges."""
    index = GrayIndex(codes)
    n = len(index)
    root = np.arange(n)  # by place in Gray order
    out: list[tuple[int, int, float]] = []
    rest: list[np.ndarray] = []
    kept = 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def labels() -> np.ndarray:
        label = root
        while True:
            up = label[label]
            if (up == label).all():
                return label
            label = up

    def doubtful() -> list[tuple[int, int, float]]:
        label, e = labels(), np.concatenate(rest, axis=1)
        x, y = e[:2].astype(np.int64)
        apart = label[x] != label[y]
        x, y, w = x[apart], y[apart], e[2][apart]
        best = most_similar(label, x, y, w)
        return list(zip(index.order[x[best]].tolist(), index.order[y[best]].tolist(), w[best].tolist(), strict=True))

    step = 512 if n <= 4096 else 128
    for at in range(0, n, step):
        block = np.arange(at, min(n, at + step))
        skip = None
        if n > 64:
            label = labels()
            low, high, whole = label, label, [label]
            for _ in index.mask[1:]:
                cut_at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, cut_at), np.maximum.reduceat(high, cut_at)
                whole.append(np.where(low == high, low, -1))
            last = [np.minimum((np.arange(len(m)) + 1) * FAN**k, n) - 1 for k, m in enumerate(index.mask)]

            def skip(k, q, node, whole=whole, label=label, last=last, block=block):
                # already one component, or only places before the query's own
                return (whole[k][node] == label[block[q]]) | (last[k][node] <= block[q])

        q, p, _ = index.within(index.codes[block], radius, skip)
        q = block[q]
        ok = p > q
        q, p = q[ok], p[ok]
        sim = np.ones(len(q))
        if sketches is not None and len(q):
            for i in range(0, len(q), 50_000):
                sim[i : i + 50_000] = alike(sketches[index.order[q[i : i + 50_000]]], sketches[index.order[p[i : i + 50_000]]])
            maybe = (sim >= least) & (sim < sure)
            rest.append(np.stack([q[maybe], p[maybe], sim[maybe]]))
            kept += int(maybe.sum())
            ok = sim >= sure
            q, p, sim = q[ok], p[ok], sim[ok]
        for x, y, s in zip(q.tolist(), p.tolist(), sim.tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(index.order[x]), int(index.order[y]), s))
        if kept > DOUBTFUL:
            yield doubtful()
            rest, kept = [], 0
    if kept:
        yield doubtful()
    yield out


def most_similar(label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a maximum spanning forest over labelled
    components (Boruvka's rounds)."""
    order = np.argsort(w, kind="stable")
    u, v = u[order], v[order]
    comp, chosen = label.copy(), []
    rank = np.arange(len(order))
    while True:
        a, b = comp[u], comp[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b, rank = u[apart], v[apart], a[apart], b[apart], rank[apart]
        best = np.full(len(comp), -1)
        np.maximum.at(best, a, np.arange(len(a)))
        np.maximum.at(best, b, np.arange(len(a)))
        take = np.unique(best[best >= 0])
        chosen.append(rank[take])
        x, y = a[take], b[take]
        while True:  # the least label of what the taken edges join
            low = np.arange(len(comp))
            np.minimum.at(low, x, y)
            np.minimum.at(low, y, x)
            while (low[low] != low).any():
                low = low[low]
            comp = low[comp]
            x, y = low[x], low[y]
            if (x == y).all():
                break
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)


# --- distributed linking ----------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(codes: DataFrame, masks: list[int], radius: int, least: float | None = None, sure: float = 0.0) -> DataFrame:
    """Edges (u, v, w) between rows of ``codes`` (id long, fp long[, sketch]), whose
    pairs (fp, sketch) are distinct; w is the estimated similarity.  A group of n
    rows gives a few edges a row at most."""
    spark = codes.sparkSession
    wide = least is not None
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    carry = ["id", "fp", *(["sketch"] if wide else [])]
    keyed = codes.select(*carry, key.alias("k")).select(*carry, "k.i", "k.key")
    # only large groups' sizes matter: they fall into chunks that meet in pairs
    size = codes.select(key.alias("k")).groupBy("k.i", "k.key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
    hot = cut(size.select("i", "key", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("chunks")))
    few = hot.count() <= HOT_KEYS  # else both sides are dealt by key
    dealt = keyed.join(F.broadcast(hot) if few else hot, ["i", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp", "id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.where((F.col("chunks") < 3) | (F.col("c") != F.col("o"))).where((F.col("chunks") != 2) | (F.col("o") == 0))
    dealt = dealt.select(*carry, F.xxhash64("i", "key", F.when(F.col("chunks") < 3, F.lit(0)).otherwise(F.least("c", "o")), F.when(F.col("chunks") < 3, F.lit(0)).otherwise(F.greatest("c", "o"))).alias("g"))
    dealt = dealt.repartition("g").sortWithinPartitions("g")

    def group(ids, fps, sks):
        # equal fingerprints of different sketches (wide only) stay apart in the index by place
        for block in links(fps, radius, sks, least or 0.0, sure):
            yield [(int(ids[a]), int(ids[b]), w) for a, b, w in block]

    def run(batches):
        left: pa.Table | None = None

        def work(t: pa.Table):
            g = t.column("g").to_numpy()
            ids, fps = t.column("id").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            sks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS) if wide else None
            cuts = np.flatnonzero(np.diff(g)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(g)]
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            two = two[near]
            ws = np.ones(len(two))
            if wide and len(two):
                ws = alike(sks[two], sks[two + 1])
                two, ws = two[ws >= least], ws[ws >= least]
            out = list(zip(ids[two].tolist(), ids[two + 1].tolist(), ws.tolist(), strict=True))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 2:
                    for block in group(ids[s:e], fps[s:e], None if sks is None else sks[s:e]):
                        out += block
                        if len(out) > DOUBTFUL:
                            yield batch(out)
                            out = []
            yield batch(out)

        def batch(edges: list) -> pa.RecordBatch:
            u, v, w = zip(*edges, strict=True) if edges else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.float64())], names=["u", "v", "w"])

        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            g = t.column("g").to_numpy()
            tail = len(g) - int(np.argmax(g[::-1] != g[-1])) if g[0] != g[-1] else 0
            left = t.slice(tail)
            if tail:
                yield from work(t.slice(0, tail))
        if left is not None and left.num_rows:
            yield from work(left)

    return mapped(dealt, run, "u long, v long, w double")


def near_groups(fps: DataFrame, radius: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fp, component) for rows of ``fingerprints``: fingerprints link at
    ``radius`` or fewer differing bits, exactly; component is the smallest key
    reachable."""
    fps = cut(fps)
    codes = cut(fps.groupBy("fp").agg(F.min(key).alias("id")))
    # fingerprints are the nodes, so that rows without a key link others and rows of one key stay apart
    found = components(link(codes.select(F.col("fp").alias("id"), "fp"), exact_masks(radius), radius))
    reps = cut(codes.join(found, codes.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("root")))
    reps = salted_join(reps, reps.groupBy("root").agg(F.min("id").alias("component")), "root").select("fp", "component")
    return salted_join(fps, reps, "fp", stable=True).select(key, "fp", "component")


#: The wide search for near copies: shingle size, least similarity, bits that may differ, and
#: the chance that a pair just at that similarity shares no mask.
NEAR_SHINGLE = 5
NEAR_LEAST = 0.8
NEAR_RADIUS = 18
NEAR_MISS = 0.02
#: Estimates under least - NEAR_DOUBT are refused and those from least + NEAR_DOUBT on accepted
#: (about three standard errors of a sketch); pairs between are checked exactly.
NEAR_DOUBT = 0.1


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = NEAR_SHINGLE, least: float = NEAR_LEAST, radius: int = NEAR_RADIUS, miss: float = NEAR_MISS) -> DataFrame:
    """(key, component) for rows of ``df`` whose component has another row's key
    as its smallest: copies and near copies of ``least`` similarity or more.

    Fingerprints are of the sets of shingles, as the similarity is.  At
    similarity J the sets' cosine is 2J / (1 + J), and a bit differs with
    chance acos(cosine) / pi; masks are drawn for that chance, so unrelated
    fingerprints meet in groups of bounded size however many there are."""
    fps = cut(fingerprints(df, k, key, text, with_sketch=True, distinct=True))
    codes = cut(fps.groupBy("fp", "sketch").agg(F.min(key).alias("id"), F.count("*").alias("n")))
    differ = math.acos(2 * least / (1 + least)) / math.pi
    masks = sampled_masks(codes.count(), differ, miss)
    edges = cut(link(codes.where("id is not null").select("id", "fp", "sketch"), masks, radius, least - NEAR_DOUBT, least + NEAR_DOUBT).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w")))
    doubt = edges.where(F.col("w") < least + NEAR_DOUBT).select("u", "v")
    good = cut(edges.where(F.col("w") >= least + NEAR_DOUBT).select("u", "v").unionByName(checked(doubt, df, key, text, k, least)))
    found = cut(components(good))
    # an edge that was refused hides no other: what it would have joined is searched exactly
    more = settled(codes.where("id is not null").select("id"), found, doubt, df, key, text, k, least)
    if more is not None:
        found = components(good.unionByName(more))
    # of repeated keys and texts one row stays, but keys are what is dropped: a
    # key that stands for its own group is never listed
    reps = codes.join(found, codes.id == found.node, "left").select("fp", "sketch", F.coalesce("component", "id").alias("component"), F.coalesce(F.col("component") != F.col("id"), F.lit(False)).alias("moved"), "n").where("n > 1 or moved")
    return salted_join(fps, reps, ["fp", "sketch"], stable=True).where(F.col(key) != F.col("component")).select(key, "component")


def checked(pairs: DataFrame, df: DataFrame, key: str, text: str, k: int, least: float) -> DataFrame:
    """The pairs (u, v) of keys of ``df`` whose sets of shingles have a Jaccard
    similarity of ``least`` or more; reads only the texts of the pairs."""
    ends = pairs.select(F.col("u").alias("i")).unionByName(pairs.select(F.col("v").alias("i"))).distinct()
    src = df.select(F.col(key).cast("long").alias("i"), F.col(text).cast("string").alias("t")).join(ends, "i", "left_semi")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [np.unique(shingle_hashes(t, k)).view(np.int64) for t in b.column(1).to_pylist()]
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(cuts, np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["i", "s"])

    sets = mapped(src, run, "i long, s array<long>").groupBy("i").agg(F.min("s").alias("s"))
    both = pairs.join(sets.select(F.col("i").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("i").alias("v"), F.col("s").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.where(same >= least * (F.size("a") + F.size("b") - same)).select("u", "v")


#: Texts, and shingles of them, that one side of an exact search has, about.
SETTLE_ROWS = 1024
SETTLE_SHINGLES = 2_000_000


def settled(codes: DataFrame, found: DataFrame, doubt: DataFrame, df: DataFrame, key: str, text: str, k: int, least: float) -> DataFrame | None:
    """Edges (u, v) that join components of ``found`` further: all components that
    refused edges of ``doubt`` lead between make a group, whose texts of different
    components are compared exactly, through postings of their shingles.  A group
    of n texts, in chunks that meet in pairs, gives n - 1 edges a task at most.
    None if no edge was refused."""
    label = found.select(F.col("node").alias("id"), "component")
    ends = [label.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "uv"]
    apart = doubt.join(ends[0], "u", "left").join(ends[1], "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v")
    apart = cut(apart.distinct())
    if apart.isEmpty():
        return None
    groups = components(apart).select(F.col("node").alias("label"), F.col("component").alias("grp"))
    nodes = codes.join(label, "id", "left").select("id", F.coalesce("component", "id").alias("label")).join(groups, "label")
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).join(cut(nodes), "id")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [np.unique(shingle_hashes(t, k)).view(np.int64) for t in b.column(3).to_pylist()]
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(cuts, np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["id", "label", "grp", "s"])

    sets = mapped(src.select("id", "label", "grp", "t"), run, "id long, label long, grp long, s array<long>")
    sets = cut(sets.groupBy("id", "label", "grp").agg(F.min("s").alias("s")))
    size = sets.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("m")).where("n > 2")
    size = size.select("grp", F.greatest(F.ceil(F.col("n") / SETTLE_ROWS), F.ceil(F.col("m") / SETTLE_SHINGLES)).cast("int").alias("chunks"))
    dealt = sets.join(size, "grp").withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # a chunk meets every other; with one chunk it is alone, with more the pairs hold it too
    dealt = dealt.where((F.col("chunks") == 1) | (F.col("c") != F.col("o"))).select("id", "label", "s", "grp", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        s = t.column("s").combine_chunks() if isinstance(t.column("s"), pa.ChunkedArray) else t.column("s")
        lens = np.diff(s.offsets.to_numpy())
        edges = exact_links(t.column("id").to_numpy(), t.column("label").to_numpy(), s.flatten().to_numpy(), lens, least)
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return cut(dealt.groupBy("grp", "a", "b").applyInArrow(meet, "u long, v long"))


def exact_links(ids: np.ndarray, labels: np.ndarray, flat: np.ndarray, lens: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges between texts of different labels (their sets of shingles one after
    another in ``flat``) of a Jaccard similarity of ``least`` or more, as many as
    join what such pairs join.  The texts of the most common label ask nothing:
    one end of each pair is of another."""
    _, own, n = np.unique(labels, return_inverse=True, return_counts=True)
    root = np.arange(len(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = np.repeat(np.arange(len(ids)), lens)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    posting, starts = owner[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    ends, out = np.cumsum(lens), []
    for q in np.flatnonzero(own != n.argmax()).tolist():
        mine = number[ends[q] - lens[q] : ends[q]]
        size = starts[mine + 1] - starts[mine]
        rows = posting[np.repeat(starts[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        shared = np.bincount(rows, minlength=len(ids))
        near = np.flatnonzero((shared >= least * (lens[q] + lens - shared)) & (own != own[q]))
        for x in near.tolist():
            a, b = find(own[q]), find(own[x])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[q]), int(ids[x])))
    return out


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``df`` with one row of each group of copies and near copies, that of the
    smallest key; rows without a key stay.  Columns may have any names."""
    gone = if_small(near_copies(df, key, text, **how).select(F.col(key).alias("gone")).distinct())
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return rows.join(gone, F.col("row").getField(key) == F.col("gone"), "left_anti").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(fingerprints(table(spark, sf_dir, "documents"), k=3), radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
