import random
from collections import Counter

import numpy as np

from nodalis.llm import decontaminate as D


def brute(text, items, least=0.8):
    """Best similarity of each item over all windows of its size."""
    norm = lambda t: [w for w in ("".join(x).lower() for x in (strip(y) for y in (t or "").split())) if w]
    out = {}
    d = norm(text)
    for i, t in items:
        w = norm(t)
        if not w:
            continue
        k = min(5, len(w))
        sh = lambda x, k=k: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
        own = sh(w)
        for a in range(max(1, len(d) - len(w) + 1)):
            s = sh(d[a : a + len(w)])
            if s:
                low, high = sum((s & own).values()), sum((s | own).values())
                if low / high >= least:
                    out[i] = max(out.get(i, 0), low / high)
    return out


def strip(y):
    a, b = 0, len(y)
    while a < b and not y[a].isalnum():
        a += 1
    while b > a and not y[b - 1].isalnum():
        b -= 1
    return y[a:b]


def cases():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([8, 20, 33, 60])))) for i in range(30)]
    items += [(30, "short one"), (31, None), (32, ""), (33, "la la la la la la la la la la"), (34, items[2][1])]
    docs = []
    for _ in range(150):
        body = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if r.random() < 0.7:
            w = r.choice(items[:30])[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit"
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() + r.choice(["", ",", "%%%"]) for x in w]
        docs.append(" ".join(body))
    docs += [None, "", "short one", "Short, ONE!", items[0][1], " ".join(items[5][1].split()[:-1]), "la " * 500]
    return docs, items


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(1)
    fps = r.integers(0, 2**63, 300, dtype=np.uint64)
    ix = D.HammingBlocks(fps)
    for q in np.r_[fps[:20] ^ np.uint64(0b1011), r.integers(0, 2**63, 20, dtype=np.uint64)]:
        assert ix.within(q).tolist() == np.flatnonzero(np.bitwise_count(fps ^ q) <= D.RADIUS).tolist()


def test_matches_equal_brute_force():
    docs, items = cases()
    m = D.Benchmark(items)
    found = 0
    for d in docs:
        got = {i: s for i, _, _, s, _ in m.batch([d, None])[0]}
        want = brute(d, items)
        assert got.keys() == want.keys(), d
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
        found += len(got)
    assert found > 50


def test_rows(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(D, "ITEMS", 10)  # several blocks
    df = spark.createDataFrame([(i if i != 3 else None, d, i) for i, d in enumerate(docs)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*items, (None, docs[7]), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()}
    items = [*items, (None, docs[7])]  # an item without an id is one too
    want = {(i if i != 3 else None, k) for i, d in enumerate(docs) for k in brute(d, items)}
    assert got == want
    kept = {r.item_id for r in D.clean(df, bench).collect()}
    assert kept == {i for i, d in enumerate(docs) if not brute(d, items)}
    assert D.contaminated(df, bench.where("false")).count() == 0
    assert D.clean(df.where("false"), bench).count() == 0
    assert D.clean(df, bench.where("false")).count() == len(docs)


def test_fingerprints_find_most_and_the_bound_finds_the_rest():
    docs, items = cases()
    m = D.Benchmark(items)
    near = sum(len(x) for x in m.batch(docs, beyond=False))
    both = m.batch(docs)
    assert 0.7 * sum(map(len, both)) < near <= sum(map(len, both))
    assert any(bits > D.RADIUS for x in both for *_, bits in x)


def test_a_shingle_that_all_items_share(spark):
    same = "one and the same begin of all items"
    items = [(f"i{i}", f"{same} {i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(300)]
    docs = [items[7][1], f"{same} " * 50, items[8][1] + f" {same}" * 400]
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "doc_id string, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {("0", "i7"), ("2", "i8")}
