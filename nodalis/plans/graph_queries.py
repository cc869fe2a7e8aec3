"""Queries of the graph engine on the driver's tables, each through the library's
operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.functions import vectors as V
from nodalis.operators import fit, metrics, spectrum, topology
from nodalis.operators.frames import Frames, hold_last, topology_versions, windows
from nodalis.sources import simulators, tables, traffic

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "graph_operator_ls"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r6(c) -> Column:
    return F.round(c, 6)


# --- common SQL -------------------------------------------------------------------

TRADE = """
g AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS t, CAST(c_nationkey AS INTEGER) AS node,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents, CAST(count(*) AS DOUBLE) AS c
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
snap AS (SELECT s.t, CAST(n.n_nationkey AS INTEGER) AS node, coalesce(g.cents, 0.0) AS cents, coalesce(g.cents, 0.0) / 1e8 AS x, coalesce(g.c, 0.0) AS c
         FROM (SELECT DISTINCT t FROM g) s CROSS JOIN nation n LEFT JOIN g ON g.t = s.t AND g.node = n.n_nationkey),
region_edges AS (SELECT CAST(a.n_nationkey AS INTEGER) AS src, CAST(b.n_nationkey AS INTEGER) AS dst, 1.0 AS w
                 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
rdeg AS (SELECT src AS node, sum(w) AS deg FROM region_edges GROUP BY 1),
ahat AS (SELECT e.src, e.dst, e.w / sqrt(a.deg) / sqrt(b.deg) AS w FROM region_edges e JOIN rdeg a ON a.node = e.src JOIN rdeg b ON b.node = e.dst),
nbr AS (SELECT s.t, e.src AS node, sum(e.w * s.cents) AS cents, sum(e.w * s.x) AS x, sum(e.w * s.c) AS c FROM snap s JOIN ahat e ON e.dst = s.node GROUP BY 1, 2)
"""

FLOWS = """
raw AS (SELECT CAST(c_nationkey AS INTEGER) AS a, CAST(s_nationkey AS INTEGER) AS b, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS w
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY 1, 2),
flow AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM raw WHERE a <> b UNION ALL SELECT b, a, w FROM raw WHERE a <> b) u GROUP BY 1, 2),
fdeg AS (SELECT src AS node, sum(w) AS deg FROM flow GROUP BY 1)
"""

USERS = """
d AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS t, user_id, value FROM events),
v AS (SELECT t, user_id, sum(value) AS s, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1, 2),
ids AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS node FROM (SELECT DISTINCT user_id FROM v) q),
grid AS (SELECT s.t, i.node, v.s IS NOT NULL AS observed, coalesce(v.s, 0.0) AS s, coalesce(v.n, 0.0) AS n
         FROM (SELECT DISTINCT t FROM v) s CROSS JOIN ids i LEFT JOIN v ON v.t = s.t AND v.user_id = i.user_id),
one AS (SELECT node AS src, CAST((node + 1) % (SELECT count(*) FROM ids) AS INTEGER) AS dst FROM ids),
ring AS (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one)
"""


def _first(snap: DataFrame, *names: str) -> DataFrame:
    """t, node and the first features under names, rounded."""
    return snap.select("t", "node", *[r6(F.col("f")[i]).alias(n) for i, n in enumerate(names)])


# --- sources -----------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT t, node, round(x, 6) AS x, c FROM snap")
def trade_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return tables.trade(spark, d).snap.select("t", "node", r6(F.col("f")[0]).alias("x"), F.col("f")[1].alias("c"))


@query(f"WITH {USERS} SELECT t, node, observed, round(s, 6) AS s, n FROM grid")
def user_snapshots(spark, d):
    u = tables.users(spark, d)
    return u.snap.join(u.mask, ["traj", "t", "node"]).select("t", "node", "observed", r6(F.col("f")[0]).alias("s"), F.col("f")[1].alias("n"))


EVENTS = """
d AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS INTEGER) AS t, * FROM events),
kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS node FROM (SELECT DISTINCT event_type FROM events) q)
"""


@query(f"""WITH {EVENTS}, v AS (SELECT t, node, count(*) AS n, sum(value) AS s, avg(value) AS m FROM d JOIN kinds USING (event_type) GROUP BY 1, 2)
SELECT s.t, k.node, CAST(coalesce(n, 0) AS DOUBLE) AS n, round(coalesce(v.s, 0.0), 4) AS s, round(coalesce(m, 0.0), 6) AS m
FROM (SELECT DISTINCT t FROM v) s CROSS JOIN kinds k LEFT JOIN v ON v.t = s.t AND v.node = k.node""")
def event_snapshots(spark, d):
    f = F.col("f")
    return tables.events(spark, d).snap.select("t", "node", f[0].alias("n"), F.round(f[1], 4).alias("s"), r6(f[2]).alias("m"))


@query(f"""WITH {EVENTS}, f AS (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM d JOIN kinds USING (event_type))
SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM f WHERE dst IS NOT NULL GROUP BY 1, 2""")
def event_transitions(spark, d):
    return tables.events(spark, d).edges.select("src", "dst", "w")


# --- topology ----------------------------------------------------------------------


@query(f"WITH {FLOWS} SELECT CAST(n_nationkey AS INTEGER) AS node, round(coalesce(deg, 0.0), 6) AS deg FROM nation LEFT JOIN fdeg ON node = n_nationkey")
def node_degrees(spark, d):
    n = tables.read(spark, d, "nation").select(F.lit(0).alias("traj"), F.lit(None).cast("int").alias("t"), F.col("n_nationkey").cast("int").alias("node"))
    return topology.degrees(tables.flows(spark, d), n).select("node", r6("deg").alias("deg"))


FHAT = "fhat AS (SELECT e.src, e.dst, e.w / sqrt(a.deg) / sqrt(b.deg) AS w FROM flow e JOIN fdeg a ON a.node = e.src JOIN fdeg b ON b.node = e.dst)"


@query(f"WITH {FLOWS}, {FHAT} SELECT src, dst, round(w, 6) AS w FROM fhat")
def normalized_adjacency(spark, d):
    return topology.normalized_adjacency(tables.flows(spark, d)).select("src", "dst", r6("w").alias("w"))


@query(f"WITH {FLOWS}, {FHAT} SELECT src, dst, round(-w, 6) AS w FROM fhat UNION ALL SELECT node, node, 1.0 FROM fdeg WHERE deg > 0")
def normalized_laplacian(spark, d):
    return topology.normalized_laplacian(tables.flows(spark, d)).select("src", "dst", r6("w").alias("w"))


@query(f"WITH {FLOWS} SELECT src, dst, round(w / greatest(sum(w) OVER (PARTITION BY src), 1e-6), 6) AS w FROM flow")
def random_walk(spark, d):
    return topology.random_walk(tables.flows(spark, d)).select("src", "dst", r6("w").alias("w"))


@query(f"""WITH {FLOWS}, p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM flow),
back AS (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS w FROM flow)
SELECT 0 AS support, node AS src, node AS dst, 1.0 AS w FROM (SELECT DISTINCT src AS node FROM flow) q
UNION ALL SELECT 1, src, dst, round(w, 6) FROM p
UNION ALL SELECT 2, x.src, y.dst, round(sum(x.w * y.w), 6) FROM p x JOIN p y ON x.dst = y.src GROUP BY x.src, y.dst
UNION ALL SELECT 3, src, dst, round(w, 6) FROM back
UNION ALL SELECT 4, x.src, y.dst, round(sum(x.w * y.w), 6) FROM back x JOIN back y ON x.dst = y.src GROUP BY x.src, y.dst""")
def diffusion_supports(spark, d):
    e = tables.flows(spark, d)
    n = e.select("traj", "t", F.col("src").alias("node")).distinct()
    return topology.diffusion_supports(e, n, 2).select("support", "src", "dst", r6("w").alias("w"))


@query(f"WITH {TRADE} SELECT s.t, s.node, (s.cents - coalesce(n.cents, 0.0)) / 1e8 AS lx, s.c - coalesce(n.c, 0.0) AS lc FROM snap s LEFT JOIN nbr n ON n.t = s.t AND n.node = s.node")
def laplacian_features(spark, d):
    # weights are quarters and features whole cents, so sums are exact in any order; one division at the end
    out = topology.laplacian(tables.trade(spark, d, unit=1.0))
    return out.select("t", "node", (F.col("f")[0] / 1e8).alias("lx"), F.col("f")[1].alias("lc"))


@query(f"""WITH {TRADE}, l AS (SELECT s.t, s.node, s.cents - n.cents AS x FROM snap s JOIN nbr n ON n.t = s.t AND n.node = s.node)
SELECT l.t, l.node, (any_value(l.x) - sum(e.w * k.x)) / 1e8 AS k FROM l JOIN ahat e ON e.src = l.node JOIN l k ON k.t = l.t AND k.node = e.dst GROUP BY 1, 2""")
def curvature_features(spark, d):
    return topology.curvature(tables.trade(spark, d, unit=1.0)).select("t", "node", (F.col("f")[0] / 1e8).alias("k"))


@query(f"""WITH {TRADE} SELECT a.t, a.node, round(sqrt(greatest(0.0, sum(e.w * pow(b.x - a.x, 2)))), 6) AS gx, round(sqrt(greatest(0.0, sum(e.w * pow(b.c - a.c, 2)))), 6) AS gc
FROM snap a JOIN ahat e ON e.src = a.node JOIN snap b ON b.t = a.t AND b.node = e.dst GROUP BY 1, 2""")
def gradient_features(spark, d):
    return _first(topology.gradient(tables.trade(spark, d)), "gx", "gc")


@query(f"WITH {TRADE} SELECT t, node, round(x, 6) AS x1, round(c, 6) AS c1, round(x * x, 6) AS x2, round(c * c, 6) AS c2, round(x * x * x, 6) AS x3, round(c * c * c, 6) AS c3 FROM snap")
def polynomial_features(spark, d):
    return _first(topology.polynomial(tables.trade(spark, d), 3), "x1", "c1", "x2", "c2", "x3", "c3")


@query(f"""WITH {TRADE} SELECT t, node, round(exp(-(pow(x - 0.5, 2) + pow(c - 3, 2)) / 8), 6) AS k0, round(exp(-(pow(x - 1, 2) + pow(c - 8, 2)) / 8), 6) AS k1 FROM snap""")
def rbf_features(spark, d):
    s = tables.trade(spark, d).snap
    return _first(s.withColumn("f", V.rbf("f", [[0.5, 3.0], [1.0, 8.0]], 2.0)), "k0", "k1")


@query(f"""WITH {FLOWS}, one AS (SELECT a AS src, b AS dst, w FROM raw WHERE a < b OR (a > b AND a % 3 = 0)) SELECT src, dst, round(w, 6) AS w FROM one
UNION ALL SELECT dst, src, round(w, 6) FROM one o WHERE NOT EXISTS (SELECT 1 FROM one p WHERE p.src = o.dst AND p.dst = o.src)""")
def reverse_edges(spark, d):
    li = tables.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("src"))
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("dst"))
    e = li.join(s, "l_suppkey").join(o.join(c, "o_custkey"), "l_orderkey").groupBy("src", "dst").agg((F.sum("rev") / 1e6).alias("w")).where("src < dst or (src > dst and src % 3 = 0)")
    return topology.symmetric_support(e).select("src", "dst", r6("w").alias("w"))


@query("""WITH m AS (SELECT CAST(c_nationkey AS INTEGER) AS node, avg(c_acctbal) AS b FROM customer GROUP BY 1),
d AS (SELECT x.node AS src, y.node AS dst, abs(x.b - y.b) AS cost FROM m x JOIN m y ON x.node <> y.node),
s AS (SELECT stddev_pop(cost) AS std FROM d)
SELECT src, dst, round(exp(-pow(cost / std, 2)), 6) AS w FROM d, s WHERE exp(-pow(cost / std, 2)) >= 0.1""")
def gaussian_adjacency(spark, d):
    m = tables.read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("int").alias("node")).agg(F.avg("c_acctbal").alias("b"))
    x, y = m.select(F.col("node").cast("string").alias("from"), F.col("b").alias("bx")), m.select(F.col("node").cast("string").alias("to"), F.col("b").alias("by"))
    dist = x.crossJoin(F.broadcast(y)).where(F.col("from") != F.col("to")).withColumn("cost", F.abs(F.col("bx") - F.col("by")))  # 25 nations
    ids = m.select(F.col("node").cast("string").alias("id"), "node")
    return topology.gaussian_adjacency(dist, ids).select("src", "dst", r6("w").alias("w"))


@query("""WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))), b.vec_id) AS r
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id <> b.vec_id)
SELECT DISTINCT src, dst FROM (SELECT src, dst FROM p WHERE r <= 6 UNION ALL SELECT dst, src FROM p WHERE r <= 6) u""")
def knn_edges(spark, d):
    return topology.knn_edges(tables.embed(spark, d), 6).select("src", "dst")


@query(f"""WITH {FLOWS}, keep AS (SELECT CAST(n_nationkey AS INTEGER) AS node, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS k FROM nation WHERE n_regionkey IN (1, 3))
SELECT a.k AS src, b.k AS dst, round(w, 6) AS w FROM flow JOIN keep a ON a.node = src JOIN keep b ON b.node = dst""")
def induced_subgraph(spark, d):
    keep = tables.read(spark, d, "nation").where("n_regionkey in (1, 3)").select(F.col("n_nationkey").cast("int").alias("node"))
    return topology.induced(tables.flows(spark, d), keep)[0].select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), r6("w").alias("w"))


def _imputed(rounds: int) -> str:
    steps = ["z0 AS (SELECT t, node, observed, s AS x FROM grid)"]
    for k in range(rounds):
        steps.append(f"m{k} AS (SELECT z.t, e.dst AS node, avg(z.x) AS m FROM z{k} z JOIN ring e ON e.src = z.node GROUP BY 1, 2)")
        steps.append(f"z{k + 1} AS (SELECT z.t, z.node, z.observed, CASE WHEN z.observed THEN z.x ELSE coalesce(m.m, 0.0) END AS x FROM z{k} z LEFT JOIN m{k} m ON m.t = z.t AND m.node = z.node)")
    return ", ".join(steps)


@query(f"WITH {USERS}, {_imputed(8)} SELECT t, node, round(x, 6) AS x FROM z8")
def diffuse_impute(spark, d):
    u = tables.users(spark, d)
    snap = u.snap.withColumn("f", F.array(F.col("f")[0]))
    return _first(topology.diffuse_impute(snap, u.mask, u.edges, 1, 8), "x")


POOLED = f"""WITH {TRADE}, s AS (SELECT *, (0.6 * x + 0.8 * c) / sqrt(0.36 + 0.64) AS score FROM snap),
k AS (SELECT t, node, x, score, CAST(row_number() OVER (PARTITION BY t ORDER BY score DESC, node) - 1 AS INTEGER) AS new FROM s)"""


@query(POOLED + " SELECT t, node, new, round(x * tanh(score), 6) AS x FROM k WHERE new < ceil(25 * 0.3)")
def topk_pool(spark, d):
    return topology.topk_pool(tables.trade(spark, d).snap, [0.6, 0.8], 0.3).select("t", "node", F.col("new").cast("int").alias("new"), r6(F.col("f")[0]).alias("x"))


@query(POOLED + " SELECT s.t, s.node, round(coalesce(k.x * tanh(k.score), 0.0), 6) AS x FROM s LEFT JOIN k ON k.t = s.t AND k.node = s.node AND k.new < ceil(25 * 0.3)")
def scatter_unpool(spark, d):
    snap = tables.trade(spark, d).snap
    p = topology.topk_pool(snap, [0.6, 0.8], 0.3)
    return _first(topology.unpool(p.select("traj", "t", F.col("new").alias("node"), "f"), p, snap, 2), "x")


# --- projections, windows, splits -----------------------------------------------------


@query(f"""WITH {USERS}, w AS (SELECT t, node, CASE WHEN s > 0 THEN s END AS s FROM grid)
SELECT t, node, round(coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS UNBOUNDED PRECEDING),
  first_value(s IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0), 6) AS x FROM w""")
def fill_gaps(spark, d):
    s = tables.users(spark, d).snap.select("t", "node", F.col("f")[0].alias("x"))
    return traffic.clean(s).select("t", "node", r6("x").alias("x"))


@query(f"WITH {TRADE} SELECT t, node, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w < 1e-6 THEN 1 ELSE stddev_pop(x) OVER w END, 6) AS x FROM snap WINDOW w AS (PARTITION BY node)")
def zscores(spark, d):
    s = tables.trade(spark, d).snap.select("t", "node", F.col("f")[0].alias("x"))
    return traffic.zscore(s).select("t", "node", r6("x").alias("x"))


@query(f"WITH {TRADE} SELECT CAST(t / 2 AS INTEGER) AS t, node, round(coalesce(lag(x, 2) OVER w, 0.0), 6) AS d0, round(coalesce(lag(x, 1) OVER w, 0.0), 6) AS d1, round(x, 6) AS d2 FROM snap WINDOW w AS (PARTITION BY node ORDER BY t) QUALIFY t % 2 = 0")
def delay_windows(spark, d):
    f = tables.trade(spark, d)
    return _first(f.with_features(f.snap.withColumn("f", F.slice("f", 1, 1))).windowed(3, stride=2).snap, "d0", "d1", "d2")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), t AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS t, CAST(epoch(day) AS DOUBLE) AS ts FROM d) SELECT t, dt FROM (SELECT t, lead(ts) OVER (ORDER BY t) - ts AS dt FROM t) q WHERE dt IS NOT NULL")
def delta_t(spark, d):
    days = tables.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    t = days.select(F.lit(0).alias("traj"), (F.row_number().over(Window.orderBy("day")) - 1).alias("t"), F.unix_seconds(F.col("day").cast("timestamp")).cast("double").alias("ts"))
    f = tables.trade(spark, d)
    return Frames(f.snap, f.edges, times=t).delta_t().select("t", "dt")


@query(f"WITH {USERS} SELECT t, node, observed AND n AS observed FROM (SELECT t, node, observed, lead(observed) OVER (PARTITION BY node ORDER BY t) AS n FROM grid) q WHERE n IS NOT NULL")
def pair_mask(spark, d):
    return tables.users(spark, d).pair_mask().select("t", "node", "observed")


@query(f"""WITH {TRADE}, n AS (SELECT count(DISTINCT t) AS n FROM snap), p AS (SELECT CASE WHEN t < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS INTEGER) THEN 'train' WHEN t < CAST(floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) AS INTEGER) THEN 'val' ELSE 'test' END AS part, x FROM snap, n)
SELECT part, count(*) AS n, round(sum(x), 6) AS total FROM p GROUP BY 1""")
def temporal_split(spark, d):
    f = tables.trade(spark, d)
    parts = f.split()
    out = None
    for name, p in zip(("train", "val", "test"), parts, strict=True):
        one = p.snap.agg(F.count("*").alias("n"), r6(F.sum(F.col("f")[0])).alias("total")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("part", "n", "total")


@query(f"WITH {TRADE} SELECT CAST(0 AS INTEGER) AS traj, CAST(s AS INTEGER) AS start, CAST(s AS INTEGER) AS rank, CAST(floor(s / 8) AS INTEGER) AS batch FROM (SELECT unnest(range(0, (SELECT max(t) FROM snap) - 10)) AS s) q")
def window_starts(spark, d):
    return windows(tables.trade(spark, d), 12).select("traj", F.col("start").cast("int").alias("start"), F.col("rank").cast("int").alias("rank"), "batch")


@query(f"""WITH {TRADE}, e AS (SELECT s.t, r.src, r.dst FROM (SELECT DISTINCT t FROM snap) s CROSS JOIN region_edges r WHERE s.t % 3 = 0 AND (r.src + r.dst + s.t) % 2 = 0)
SELECT CAST(q.s AS INTEGER) AS t, e.src, e.dst FROM (SELECT unnest(range(0, 24)) AS s) q JOIN e ON e.t = q.s - q.s % 3""")
def hold_last_topology(spark, d):
    f = tables.trade(spark, d)
    e = f.edges.drop("t").crossJoin(f.snap.select("t").distinct()).where("t % 3 = 0 and (src + dst + t) % 2 = 0").select("traj", "t", "src", "dst", "w")  # 80 steps of 100 edges
    return hold_last(e, 24).select("t", "src", "dst")


@query(f"""WITH {TRADE}, e AS (SELECT s.t, r.src, r.dst FROM (SELECT DISTINCT t FROM snap) s CROSS JOIN region_edges r WHERE (r.src + r.dst + s.t % 3) % 2 = 0)
SELECT count(DISTINCT k) AS versions, count(*) AS steps FROM (SELECT t, string_agg(src || '-' || dst, ',' ORDER BY src, dst) AS k FROM e GROUP BY 1) q""")
def topology_changes(spark, d):
    f = tables.trade(spark, d)
    e = f.edges.drop("t").crossJoin(f.snap.select("t").distinct()).where("(src + dst + t % 3) % 2 = 0").select("traj", "t", "src", "dst", "w")
    return topology_versions(e).agg(F.countDistinct("edges").alias("versions"), F.count("*").alias("steps"))


# --- metrics and losses -----------------------------------------------------------------


@query(f"""WITH {TRADE}, h AS (SELECT unnest([3, 6, 12]) AS h), j AS (SELECT a.t AS o, h.h, a.x AS p1, b.x AS y1, a.c AS p2, b.c AS y2 FROM snap a CROSS JOIN h JOIN snap b ON b.node = a.node AND b.t = a.t + h.h WHERE a.t <= (SELECT max(t) FROM snap) - 12),
e AS (SELECT o, h, (abs(p1 - y1) + abs(p2 - y2)) / 2 AS ae, (pow(p1 - y1, 2) + pow(p2 - y2, 2)) / 2 AS se, (abs((p1 - y1) / (abs(y1) + 1e-8)) + abs((p2 - y2) / (abs(y2) + 1e-8))) / 2 AS re FROM j WHERE y1 > 0),
o AS (SELECT o, h, avg(ae) AS mae, sqrt(avg(se)) AS rmse, avg(re) AS mape FROM e GROUP BY 1, 2),
m AS (SELECT CAST(h AS INTEGER) AS horizon, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, count(*) AS origins FROM o GROUP BY 1)
SELECT horizon, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 5) AS mape, origins FROM m
UNION ALL SELECT NULL, round(avg(mae), 6), round(avg(rmse), 6), round(avg(mape), 5), max(origins) FROM m""")
def persistence_errors(spark, d):
    f = tables.trade(spark, d)
    seen = f.snap.select("traj", "t", "node", (F.col("f")[0] > 0).alias("observed"))
    g = Frames(f.snap, f.edges, mask=seen)
    return metrics.evaluate(metrics.persistence(g, (3, 6, 12)), g).select("horizon", r6("mae").alias("mae"), r6("rmse").alias("rmse"), F.round("mape", 5).alias("mape"), "origins")


@query(f"""WITH {USERS}, j AS (SELECT b.t, b.node, a.s AS p, b.s AS y, b.observed AS o FROM grid a JOIN grid b ON b.node = a.node AND b.t = a.t + 1)
SELECT round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs((p - y) / (abs(y) + 1e-8))), 4) AS mape FROM j WHERE o""")
def masked_errors(spark, d):
    u = tables.users(spark, d)
    one = u.snap.withColumn("f", F.slice("f", 1, 1))
    pred = one.withColumn("t", F.col("t") + 1)
    on = ["traj", "t", "node"]
    return metrics.masked(metrics.node_errors(pred, one, on), u.mask, on).select(r6("mae").alias("mae"), r6("rmse").alias("rmse"), F.round("mape", 4).alias("mape"))


@query(f"""WITH {TRADE} SELECT b.t, round(max((pow(a.x - b.x, 2) + pow(a.c - b.c, 2)) / 2), 6) AS worst FROM snap a JOIN snap b ON b.node = a.node AND b.t = a.t + 1 GROUP BY 1""")
def worst_node(spark, d):
    s = tables.trade(spark, d).snap
    e = metrics.node_errors(s.withColumn("t", F.col("t") + 1), s, ["traj", "t", "node"])
    return metrics.worst_node(e).select("t", r6("worst").alias("worst"))


@query(f"""WITH {TRADE}, p AS (SELECT a.t, (pow(0.9 * a.x - b.x, 2) + pow(0.9 * a.c - b.c, 2)) / 2 AS e FROM snap a JOIN snap b ON b.node = a.node AND b.t = a.t + 1), q AS (SELECT t, avg(e) AS e FROM p GROUP BY 1) SELECT round(avg(e), 6) AS loss FROM q""")
def forward_consistency(spark, d):
    return metrics.pair_loss(tables.trade(spark, d), lambda x: V.matvec([[0.9, 0.0], [0.0, 0.9]], x)).select(r6("loss").alias("loss"))


MEMBERS = "m AS (SELECT a.t, a.node, b.cents AS v FROM snap a JOIN snap b ON b.node = a.node AND b.t BETWEEN a.t - 6 AND a.t - 1 WHERE a.t >= 6), i AS (SELECT t, node, avg(v) AS mean, quantile_cont(v, 0.1) AS lower, quantile_cont(v, 0.9) AS upper FROM m GROUP BY 1, 2)"


def _members(spark, d) -> tuple[Frames, DataFrame]:
    """Six members for each step: the values of the six steps before, in cents."""
    f = tables.trade(spark, d, unit=1.0)
    back = f.snap.select("traj", F.explode(F.sequence(F.col("t") + 1, F.col("t") + 6)).alias("t"), "node", (F.col("f")[0]).alias("v"))
    steps = f.snap.select("traj", "t").distinct().where("t >= 6")
    return f, back.join(steps, ["traj", "t"])


@query(f"WITH {TRADE}, {MEMBERS} SELECT t, node, round(mean, 3) / 1e8 AS mean, round(lower, 3) / 1e8 AS lower, round(upper, 3) / 1e8 AS upper FROM i")
def ensemble_interval(spark, d):
    from nodalis.operators.uncertainty import member_interval

    return member_interval(_members(spark, d)[1], ["t", "node"], "v", 0.8).select("t", "node", *[(F.round(c, 3) / 1e8).alias(c) for c in ("mean", "lower", "upper")])


@query(f"WITH {TRADE}, {MEMBERS} SELECT round(avg(CAST(s.cents BETWEEN i.lower AND i.upper AS DOUBLE)), 6) AS coverage FROM i JOIN snap s ON s.t = i.t AND s.node = i.node")
def interval_coverage(spark, d):
    from nodalis.operators.uncertainty import member_interval

    f, m = _members(spark, d)
    return metrics.coverage(member_interval(m, ["t", "node"], "v", 0.8), f.snap.select("t", "node", F.col("f")[0].alias("y")), ["t", "node"]).select(r6("coverage").alias("coverage"))


# --- fits and spectra ---------------------------------------------------------------------


@query(f"""WITH {TRADE}, p AS (SELECT a.x, b.x AS y, n.x AS a FROM snap a JOIN snap b ON b.node = a.node AND b.t = a.t + 1 JOIN nbr n ON n.t = a.t AND n.node = a.node),
s AS (SELECT sum(x * x) AS xx, sum(x * a) AS xa, sum(a * a) AS aa, sum(x * y) AS xy, sum(a * y) AS ay, count(*) AS pairs FROM p)
SELECT round((xy * aa - ay * xa) / (xx * aa - xa * xa), 6) AS k_self, round((ay * xx - xy * xa) / (xx * aa - xa * xa), 6) AS k_nbr, pairs FROM s""")
def graph_operator_ls(spark, d):
    return fit.graph_least_squares(tables.trade(spark, d)).select(r6("k_self").alias("k_self"), r6("k_nbr").alias("k_nbr"), "pairs")


AR1 = "k AS (SELECT a.node, sum(a.x * b.x) / sum(a.x * a.x) AS k FROM snap a JOIN snap b ON b.node = a.node AND b.t = a.t + 1 GROUP BY 1)"


@query(f"WITH {TRADE}, {AR1} SELECT node, round(k, 6) AS k FROM k")
def node_ar1(spark, d):
    return fit.node_ar1(tables.trade(spark, d)).select("node", r6("k").alias("k"))


@query(f"WITH {TRADE} SELECT a.node AS i, b.node AS j, round(sum(a.x * b.x), 6) AS v FROM snap a JOIN snap b ON b.t = a.t GROUP BY 1, 2")
def gram_matrix(spark, d):
    return fit.gram_entries(tables.trade(spark, d)).select("i", "j", r6("v").alias("v"))


REGION = f"""WITH {TRADE}, {AR1}, r AS (SELECT CAST(n_regionkey AS INTEGER) AS grp, list(abs(k) ORDER BY abs(k) DESC) AS m FROM k JOIN nation ON n_nationkey = node GROUP BY 1),
d AS (SELECT a.grp AS a, b.grp AS b, list_sum(list_transform(list_zip(a.m, b.m), lambda z: abs(z[1] - z[2]))) / len(a.m) AS distance FROM r a JOIN r b ON a.grp < b.grp)"""


def _region_spectra(spark, d) -> DataFrame:
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"), F.col("n_regionkey").cast("int").alias("grp"))
    return fit.node_ar1(tables.trade(spark, d)).join(n, "node").select("grp", F.abs("k").alias("magnitude"))


@query(REGION + " SELECT a, b, round(distance, 6) AS distance FROM d")
def spectral_distances(spark, d):
    return spectrum.magnitude_distances(_region_spectra(spark, d)).select("a", "b", r6("distance").alias("distance"))


@query(REGION + " SELECT round(quantile_cont(distance, 0.95), 6) AS threshold FROM d")
def anomaly_threshold(spark, d):
    return spectrum.threshold(spectrum.magnitude_distances(_region_spectra(spark, d))).select(r6("threshold").alias("threshold"))


@query(REGION + " SELECT round(avg(distance) + 2 * stddev_pop(distance), 6) AS threshold FROM d")
def anomaly_threshold_std(spark, d):
    return spectrum.threshold(spectrum.magnitude_distances(_region_spectra(spark, d)), "std").select(r6("threshold").alias("threshold"))


# --- simulated dynamics ---------------------------------------------------------------------


def _steps(n: int, first: str, then: str) -> str:
    return ", ".join([f"z0 AS ({first})", *[f"z{k} AS ({then.format(a=f'z{k - 1}', k=k)})" for k in range(1, n)]])


@query(f"""WITH {TRADE}, {_steps(5, "SELECT node, x FROM snap WHERE t = 0", "SELECT s.node, 0.9 * (s.x - 0.3 * (s.x - coalesce(n.x, 0.0))) AS x FROM {a} s LEFT JOIN (SELECT e.src AS node, sum(e.w * y.x) AS x FROM ahat e JOIN {a} y ON y.node = e.dst GROUP BY 1) n ON n.node = s.node")}
{" UNION ALL ".join(f"SELECT {k} AS t, node, round(x, 6) AS x FROM z{k}" for k in range(5))}""")
def diffusion_rollout(spark, d):
    f = tables.trade(spark, d)
    start = f.snap.where("t = 0").withColumn("f", F.slice("f", 1, 1))
    return _first(simulators.diffusion(start, f.edges, 5, 0.3, 0.9, 1), "x")


@query(f"""WITH {TRADE}, ndeg AS (SELECT src, count(DISTINCT dst) AS d FROM region_edges GROUP BY 1),
{_steps(5, "SELECT node, 1.0 - i AS s, i, 0.0 AS r FROM (SELECT node, CASE WHEN node = 0 THEN 0.08 WHEN node = 1 THEN 0.03 ELSE 0.0 END AS i FROM (SELECT DISTINCT node FROM snap) q) w",
"SELECT node, greatest(0.0, 1 - i - r) AS s, i, r FROM (SELECT s.node, greatest(0.0, s.i + 0.6 * s.s * coalesce(p.p, 0.0) - 0.2 * s.i) AS i, greatest(0.0, s.r + 0.2 * s.i) AS r FROM {a} s LEFT JOIN (SELECT e.src AS node, sum(y.i / n.d) AS p FROM region_edges e JOIN ndeg n ON n.src = e.src JOIN {a} y ON y.node = e.dst GROUP BY 1) p ON p.node = s.node) q")}
{" UNION ALL ".join(f"SELECT {k} AS t, node, round(s, 6) AS s, round(i, 6) AS i, round(r, 6) AS r FROM z{k}" for k in range(5))}""")
def epidemic_rollout(spark, d):
    f = tables.trade(spark, d)
    i = F.when(F.col("node") == 0, 0.08).when(F.col("node") == 1, 0.03).otherwise(0.0)
    start = f.snap.where("t = 0").select("traj", "t", "node", F.array(1 - i, i, F.lit(0.0)).alias("f"))
    return _first(simulators.epidemic(spark, start, f.edges, 5, 0.6, 0.2), "s", "i", "r")


@query(f"""WITH {TRADE}, z AS (SELECT node, x FROM snap WHERE t = 0), nb AS (
SELECT a.node, b.x, CASE WHEN b.node = a.node - 1 THEN 0.7 WHEN b.node = a.node - 5 THEN 0.2 ELSE 0.0 END AS w, CASE WHEN b.node > a.node THEN 1 ELSE 0 END AS o
FROM z a JOIN z b ON (b.node = a.node - 1 AND a.node % 5 > 0) OR (b.node = a.node + 1 AND a.node % 5 < 4) OR b.node = a.node - 5 OR b.node = a.node + 5),
s AS (SELECT node, x, CASE WHEN o = 1 THEN 0.1 / sum(o) OVER (PARTITION BY node) ELSE w END AS w FROM nb)
SELECT 1 AS t, z.node, round(0.85 * any_value(z.x) + 0.15 * sum(s.w * s.x) / sum(s.w), 6) AS x FROM z JOIN s ON s.node = z.node GROUP BY z.node""")
def advection_step(spark, d):
    start = tables.trade(spark, d).snap.where("t = 0").withColumn("f", F.slice("f", 1, 1))
    return _first(simulators.advection_step(start, 5, 5), "x")


# --- models (no SQL: iterative or matrix valued; tested against dense algebra) -----------------


def _channel(f: Frames) -> Frames:
    return f.with_features(f.snap.withColumn("f", F.slice("f", 1, 1)))


@query()
def dmd_forecast(spark, d):
    """Dynamic-mode forecasts of the last tenth of the months from the first seventy per cent."""
    f = _channel(tables.trade(spark, d))
    parts = f.split()
    m = fit.DMD().fit(parts.train)
    return m.predict(parts.test.snap, 3).select("origin", "h", "node", r6(F.col("f")[0]).alias("x"))


@query()
def dmd_errors(spark, d):
    f = _channel(tables.trade(spark, d))
    m = fit.DMD(rank=10).fit(f.split().train)
    return metrics.evaluate(m.predict(f.snap, 6), f, (1, 3, 6))


@query()
def edmd_spectrum(spark, d):
    return fit.EDMD(rank=12).fit(_channel(tables.trade(spark, d))).spectrum().to_df(spark)


@query()
def controlled_dmd(spark, d):
    """Months as a seasonal control of all nations."""
    f = _channel(tables.trade(spark, d))
    u = f.snap.select("traj", "t").distinct().select("traj", "t", F.lit(None).cast("int").alias("node"), F.array(F.sin(F.col("t") * 0.5235987755982988), F.cos(F.col("t") * 0.5235987755982988)).alias("u"))
    m = fit.DMDc(rank=10).fit(Frames(f.snap, f.edges, u))
    return fit.save_matrix(spark, "control", m.control)


@query()
def graph_model_errors(spark, d):
    """A model with graph observables and fixed convolution features."""
    from nodalis.operators.model import GraphModel
    from nodalis.operators.nets import GraphNet

    f = tables.trade(spark, d)
    return GraphModel(observables=["laplacian", "gradient"], network=GraphNet("gcn", 2, 8, 4)).fit(f.split().train).evaluate(f)


@query()
def ensemble_forecast(spark, d):
    from nodalis.operators.model import Ensemble, GraphModel
    from nodalis.operators.nets import GraphNet

    f = tables.trade(spark, d)
    e = Ensemble.of(lambda s: GraphModel(network=GraphNet("sage", 2, 8, 4, seed=s), penalty=1e-3), 3).fit(f)
    return e.predict_interval(f.slice(f.num_timesteps - 1, f.num_timesteps), 3)


@query()
def pooled_forecast(spark, d):
    from nodalis.operators.model import GraphModel, Hierarchical

    f = tables.trade(spark, d)
    return Hierarchical(GraphModel(), [1.0, 0.0], 0.4).fit(f).predict(f.slice(f.num_timesteps - 1, f.num_timesteps), 3).select("h", "node", "f")


@query()
def attention_encoding(spark, d):
    from nodalis.operators.nets import GraphNet, encode

    return encode(GraphNet("gat", 2, 8, 4, heads=2), tables.trade(spark, d))


@query()
def recurrent_forecast(spark, d):
    from nodalis.operators.nets import DiffusionGRU, autoregress

    f = tables.trade(spark, d)
    return autoregress(DiffusionGRU(2, 8, 2), f.slice(f.num_timesteps - 1, f.num_timesteps), 3)


@query()
def chaotic_trajectories(spark, d):
    """Twelve trajectories of a chaotic ring and three of a spectral equation."""
    a = simulators.trajectories(spark, list(range(12)), 16, 20).withColumn("kind", F.lit("ring"))
    return a.unionByName(simulators.trajectories(spark, [0, 1, 2], 32, 20, "kuramoto").withColumn("kind", F.lit("spectral")))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    """The streaming aggregation over everything there is."""
    from nodalis.streaming.snapshots import tumbling

    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE >= ts THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    from nodalis.streaming.snapshots import sessions

    e = tables.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
