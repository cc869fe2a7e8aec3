"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its PREFIX nearest pivots in order and posted, with
its place in that order, in their inverted files.  A query reads the files of its
own PREFIX nearest pivots; the postings add up to the footrule distance of the two
orders (a pivot missing from one stands just behind its end).  The better KEEP
share of a chunk by footrule, and LEAST k at least, is reranked by the exact inner product.

With pos and j the places of a shared pivot in row and query, the footrule
distance is PREFIX (PREFIX + 1) less twice the sum of PREFIX - max(pos, j), so one
running sum over the files ranks all rows of a chunk.

Largest inner product becomes nearest neighbour by one more coordinate that
gives all index vectors the same length; queries have 0 there.

Layout: rows are dealt by id into chunks of about CHUNK, queries into blocks of
about QUERIES, and each chunk meets each block in a task that has the chunk's
files; a file is never longer than its chunk, and a very common vector is spread
like any other.  Equal vectors of a chunk are ranked once.  Only the pivots (of
a bounded sample, SAMPLE rows by hash of the id, those furthest apart) are
broadcast; every row is posted.

Scores are summed in one fixed order of the components, so equal vectors have
equal scores wherever they lie and ties go to the smaller id.

Vectors that are null, zero or hold a null or non-finite component take no part,
nor do rows without an id.  An inner product needs equal lengths: each length is
a search of its own, with one job a length.  Repeated rows of an id count once
(its best score).  Fewer than k candidates give as many rows as there are; an
empty table gives an empty one.  Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.llm.common import cut, mapped, table

#: Pivot numbers are bytes; two places of a prefix add up within a byte.
PIVOTS = 256
SAMPLE = 4096
PREFIX = 120
KEEP = 0.05
LEAST = 16
CHUNK = 8192
QUERIES = 8192


def usable(vec: str) -> Column:
    """True for vectors that take part."""
    v = F.col(vec).cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.Array, dtype) -> np.ndarray:
    """Rows of binary vectors."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1)


class Pivots:
    def __init__(self, points: np.ndarray, longest: float):
        self.longest = longest
        self.points = np.c_[points, self._rest(points)]
        self.prefix = min(PREFIX, len(points))

    def _rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(1)))

    def order(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Numbers of the nearest pivots, nearest first."""
        near = np.c_[x, np.zeros(len(x)) if query else self._rest(x)] @ self.points.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.prefix].astype(np.uint8)


def spread(points: np.ndarray, longest: float, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the furthest from those before, so that a
    group of vectors close together, however large, gives few pivots."""
    all_ = Pivots(points, longest).points
    chosen, near = [0], all_ @ all_[0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, all_ @ all_[chosen[-1]])
    return points[list(dict.fromkeys(chosen))]


class Files:
    """The pivots' inverted files of a chunk: row p has the place of pivot p in
    each row's order, its length for rows that are not posted there."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.prefix = orders.shape
        self.places = np.full((pivots, n), self.prefix, np.uint8)
        at = np.arange(n)
        for i in range(self.prefix):
            self.places[orders[:, i], at] = i

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distances of a query's order to those of all rows."""
        m = self.prefix
        late = np.maximum(self.places[order], np.arange(m, dtype=np.uint8)[:, None])
        if m % 2:
            late = np.concatenate([late, np.zeros((1, late.shape[1]), np.uint8)])
        late = late[0::2] + late[1::2]
        return m * (m + 1) - 2 * (m * m - late.sum(0, dtype=np.uint16).astype(np.int64))

    def nearest(self, order: np.ndarray, most: int) -> np.ndarray:
        """Numbers of the ``most`` rows of least footrule, ties to the first."""
        n = self.places.shape[1]
        if most >= n:
            return np.arange(n)
        return np.argpartition(self.footrule(order) * n + np.arange(n), most - 1)[:most]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same order."""
    return (x * q).sum(1)


def rerank(ids: np.ndarray, x: np.ndarray, orders: np.ndarray, pivots: int, queries, k: int, keep: float):
    """(query number, ids, scores) of the ``k`` nearest found for each query
    (id, vector, order) among the rows of a chunk."""
    by = np.argsort(ids, kind="stable")
    ids, x, orders = ids[by], x[by], orders[by]
    _, first, copy = np.unique(x.view(f"V{x.dtype.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # distinct vectors in order of their smallest id
    first, copy = np.sort(first), rank[copy]
    # rows of each distinct vector, the smallest ids first
    rows = np.argsort(copy, kind="stable")
    starts = np.searchsorted(copy[rows], np.arange(len(first) + 1))
    files, wide = Files(orders[first], pivots), x[first].astype(np.float64)
    most = max(LEAST * k + 1, int(np.ceil(keep * len(first))))
    for number, (qid, q, order) in enumerate(queries):
        at = files.nearest(order, most)
        s = inner(wide[at], q)
        if len(at) > k + 1:  # the query's own vector may be among them
            edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            at, s = at[s >= edge], s[s >= edge]
        size = np.minimum(starts[at + 1] - starts[at], k + 1)
        own = rows[np.repeat(starts[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        s = np.repeat(s, size)
        own, s = own[ids[own] != qid], s[ids[own] != qid]
        best = np.lexsort((ids[own], -s))[:k]
        yield number, ids[own][best], s[best]


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", pivots: int = PIVOTS, keep: float = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's ``k`` nearest found."""
    spark = df.sparkSession
    single = df.schema[vec].dataType.elementType.simpleString() == "float"
    src = df.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vec).cast("array<float>" if single else "array<double>").alias("v"))
    src = cut(src.where(F.col("id").isNotNull()).where(usable("v")).distinct())
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = src.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(square).alias("l")).orderBy("d").collect()  # a row for each length
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for s in sizes:
        if s.nq:
            found = found.unionByName(_found(src.where(F.size("v") == s.d), s.n, s.nq, float(s.l) ** 0.5, np.dtype("<f4" if single else "<f8"), k, pivots, keep))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(src: DataFrame, n: int, n_queries: int, longest: float, dtype, k: int, pivots: int, keep: float) -> DataFrame:
    """(query_id, vec_id, score) for vectors of one length: the nearest of each
    chunk."""
    some = src.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "v").limit(SAMPLE).toArrow().column("v").to_pylist()
    points = spread(np.array(list(dict.fromkeys(map(tuple, some))), np.float64), longest, max(1, min(pivots, PIVOTS, n // 4)))
    n_piv = len(points)
    model = src.sparkSession.sparkContext.broadcast(Pivots(points, longest))

    def assign(batches):
        piv = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten(), dtype).reshape(b.num_rows, -1)
            raw, wide = [r.tobytes() for r in x], x.astype(np.float64)
            q = np.asarray(b.column("q"))
            for kind, at in ((False, np.arange(len(x))), (True, np.flatnonzero(q))):
                if len(at):
                    orders = [r.tobytes() for r in piv.order(wide[at], kind)]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array([kind] * len(at)), pa.array([raw[i] for i in at], pa.binary()), pa.array(orders, pa.binary())], names=["id", "q", "v", "perm"])

    rows = cut(mapped(src, assign, "id long, q boolean, v binary, perm binary"))
    nx, nq = -(-n // CHUNK), -(-n_queries // QUERIES)
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("q"), nq).otherwise(nx)).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("q"), nx).otherwise(nq) - 1)))
    dealt = dealt.select("id", "q", "v", "perm", F.when(F.col("q"), F.col("other")).otherwise(F.col("mine")).alias("cx"), F.when(F.col("q"), F.col("mine")).otherwise(F.col("other")).alias("cq"))

    def meet(t: pa.Table) -> pa.Table:
        is_q = t.column("q").to_numpy()
        xs, qs = t.filter(pa.array(~is_q)).combine_chunks(), t.filter(pa.array(is_q)).combine_chunks()
        found = ([], [], [])
        if len(xs) and len(qs):
            qid = qs.column("id").to_numpy()
            queries = zip(qid, _matrix(qs.column("v"), dtype).astype(np.float64), _matrix(qs.column("perm"), np.uint8), strict=True)
            for i, ids, scores in rerank(xs.column("id").to_numpy(), _matrix(xs.column("v"), dtype), _matrix(xs.column("perm"), np.uint8), n_piv, queries, k, keep):
                found[0].append(np.full(len(ids), qid[i]))
                found[1].append(ids)
                found[2].append(scores)
        cat = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table([pa.array(cat[0].astype(np.int64)), pa.array(cat[1].astype(np.int64)), pa.array(cat[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    return dealt.groupBy("cx", "cq").applyInArrow(meet, "query_id long, vec_id long, score double")


def op1_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
