import random

import numpy as np

from nodalis.llm import cotrain as Q


def rows(n=400):
    r = random.Random(4)
    out = []
    for i in range(n):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(20, 80))]
        text = " ".join(w) if good else " ".join(x + r.choice(["!!", "$$$", ""]) for x in w[:8] * 5)
        out.append((i, text, "en", f"s{r.randint(0, 2) if good or r.random() < 0.3 else 3}", len(text), int(good)))
    return out


def views(rs):
    return np.array([Q.text_view(t) for _, t, *_ in rs]), np.array([Q.meta_view(a, s, n) for _, _, a, s, n, _ in rs])


def brute(x, y, out):
    """Co-training by the docstring on whole matrices: scores of all rows; y is
    -1 for unlabelled rows, ``out`` marks those that calibrate.  Also the
    numbers of pseudo-labels given in the last round."""

    def odds(v):
        a = np.c_[(x[v] - mean[v]) / sd[v], np.ones(len(y))]
        return np.clip(a @ w[v], -Q.MOST, Q.MOST), a

    teach, free = (y >= 0) & ~out, y < 0
    mean = [z[teach].mean(0) for z in x]
    sd = [np.sqrt(np.maximum(0, (z[teach] ** 2).mean(0) - m * m)) for z, m in zip(x, mean, strict=True)]
    sd = [np.where(s < 1e-9, 1, s) for s in sd]
    w = [np.zeros(z.shape[1] + 1) for z in x]
    bars, given = None, [0, 0]
    for r in range(Q.ROUNDS + 1):
        if r:
            bars = {}
            for g in (0, 1):
                o = odds(g)[0][free]
                for c, q in ((1, np.floor((o + Q.MOST) / Q.BIN) * Q.BIN - Q.MOST), (0, -(np.floor((o + Q.MOST) / Q.BIN) * Q.BIN - Q.MOST + Q.BIN))):
                    down = np.sort(q)[::-1]
                    k = Q.PER_ROUND * r * len(q)
                    bar = max(np.log(Q.SURE / (1 - Q.SURE)), down[min(len(q) - 1, int(np.ceil(k)) - 1)] - 1e-9)
                    n = (q >= bar - 1e-9).sum()
                    bars[g, c] = (bar, Q.PSEUDO * (y[teach] == c).sum() / n if n else 0)
        for _ in range(Q.STEPS):
            both, far = [odds(0), odds(1)], 0
            for v in (0, 1):
                target, weight = np.where(teach, y, -1), teach.astype(float)
                if bars:
                    o, given[v] = both[1 - v][0], 0
                    for c in (0, 1):
                        bar, share = bars[1 - v, c]
                        sure = free & ((o if c else -o) >= bar) & (share > 0)
                        target, weight = np.where(sure, c, target), np.where(sure, share, weight)
                        given[v] += sure.sum()
                a, p = both[v][1], 1 / (1 + np.exp(-both[v][0]))
                keep = np.r_[np.full(a.shape[1] - 1, Q.RIDGE), 1e-6]
                h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(keep)
                move = np.clip(np.linalg.solve(h, a.T @ (weight * (target - p)) - keep * w[v]), -5, 5)
                w[v] = w[v] + move
                far = max(far, np.abs(move).max())
            if far < 1e-3:
                break
    prior = np.log((y == 1).sum() / (y == 0).sum())
    total = prior
    for v in (0, 1):
        o = odds(v)[0]
        slope, offset = Q._curve(o[out], y[out])
        total = total + slope * o + offset - prior
    return 1 / (1 + np.exp(-np.clip(total, -Q.MOST, Q.MOST))), given


def test_views_teach_each_other(spark):
    rs = rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rs], schema).repartition(5)
    few = {r[0]: r[-1] for r in rs[:60]}
    model = Q.learn(docs, spark.createDataFrame(list(few.items()), "doc_id long, quality int"))
    x, m = (Q.half(v) for v in views(rs))
    y = np.array([few.get(r[0], -1) for r in rs])
    bit = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 9), 4) = 0 as o").collect()}
    out = np.array([y[i] >= 0 and bit[r[0]] for i, r in enumerate(rs)])
    want, given = brute([x, m], y, out)
    assert min(given) > 0
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert np.allclose([got[r[0]] for r in rs], want, atol=1e-6)
    truth = np.array([r[-1] for r in rs])
    assert ((want[60:] >= 0.5) == truth[60:]).mean() > 0.95


def test_words_speak(spark):
    r = random.Random(9)
    vocab = [["anchor", "harbour", "vessel", "tide"], ["magnet", "copper", "voltage", "coil"]]
    rs = []
    for i in range(400):
        y = i % 2
        words = [r.choice(vocab[y]) if r.random() < 0.3 else r.choice(["the", "of", "and", "with", "under"]) for _ in range(40)]
        rs.append((i, " ".join(words), "en", "s", 100, y))
    docs = spark.createDataFrame([x[:5] for x in rs], "doc_id long, text string, lang string, source string, n_chars long")
    model = Q.learn(docs, spark.createDataFrame([(x[0], x[-1]) for x in rs[:200]], "doc_id long, quality int"))
    got = {x.doc_id: x.score for x in Q.score(docs, model).collect()}
    assert np.mean([(got[x[0]] >= 0.5) == x[-1] for x in rs[200:]]) > 0.95


def test_scores(spark):
    rs = rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    docs = spark.createDataFrame([(*r[:5], 1.0) for r in rs] + [(900, None, None, None, None, 0.0), (901, "", "en", "s1", 0, None), (None, "abc de", "en", "s0", 6, 0.0), (902, "abc " * 100000, "en", "s1", 400000, 0.0)], schema)
    labels = spark.createDataFrame([(r[0], r[-1]) for r in rs if r[0] < 250] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = Q.learn(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert len(got) == 404
    test = [r for r in rs if r[0] >= 250]
    assert np.mean([(got[r[0]] >= 0.5) == r[-1] for r in test]) > 0.95
    assert Q.learn(docs, labels.where("quality = 1")) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.5}
    assert Q.score(docs.where("false"), model).count() == 0
