import math

import numpy as np

from nodalis.llm import toxicity as T
from nodalis.llm.toxicity_folds import auc, model_of


def corpus(n=160):
    out = []
    for i in range(n):
        words = ["plain", "river", "house", "tree", f"un{i % 7}seen", "walking"] * (3 + i % 5)
        if i % 4 == 0:
            words[2] = "vilex"
            words[7] = "vilexen"
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def brute(texts, y, order, shared, discount):
    """The definition, with dictionaries of strings: log-ratio of each character."""
    import re

    def norm(t):
        return " " + "".join(c.lower()[0] if c.isalpha() else " " for c in t or "") + " "

    def clean(t):
        return re.sub(" +", " ", norm(t))

    own = ({}, {})
    left = {}
    kinds = {}
    for t, k in zip(texts, y, strict=True):
        s = clean(t)
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    g = s[i - n + 1 : i + 1]
                    own[k][g] = own[k].get(g, 0) + 1
                    left.setdefault(g[1:], set()).add(g)
                    kinds.setdefault((n, g[:-1]), set()).add(g)

    def p(k, g):
        if not g:
            return T.FLOOR
        n, ctx = len(g), g[:-1]
        if n <= shared:
            count, d = {x: len(left.get(x, ())) for x in kinds.get((n, ctx), ())}, 0.75
        else:
            count, d = {x: own[k].get(x, 0) for x in kinds.get((n, ctx), ())}, discount
        total = sum(count.values())
        if not total:
            return p(k, g[1:])
        return (max(count.get(g, 0) - d, 0) + sum(min(c, d) for c in count.values()) * p(k, g[1:])) / total

    def ratios(t):
        s = clean(t)
        return [0.0] + [math.log(p(1, s[max(0, i - order + 1) : i + 1]) / p(0, s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s))]

    def evidence(t, window):
        r = ratios(t)
        return max(sum(r[i:j]) for j in range(1, len(r) + 1) for i in range(max(0, j - window), j)) / window

    return ratios, evidence


def test_models_against_the_definition(monkeypatch):
    r = np.random.default_rng(3)
    for order, shared, discount in ((5, 2, 0.75), (4, 1, 1.5), (3, 2, 0.75)):
        texts = ["".join(r.choice(list("aabbcdé .,7E"), r.integers(0, 60))) for _ in range(30)] + ["", "ab ba"]
        y = np.arange(len(texts)) % 2
        m = model_of(texts, y, order, shared, discount)
        ratios, evidence = brute(texts, y, order, shared, discount)
        new = texts[:6] + [None, "", "a", "zzz abba", "abé" * 30, "x\n\n y"]
        for t in new:
            chars, starts = T.normalised([t])
            assert np.allclose(m.ratios(chars, T.places(len(chars), starts)), ratios(t), atol=1e-9)
        for window in (4, 25):
            want = [evidence(t, window) for t in new]
            assert np.allclose(m.evidence(new, window), want, atol=1e-9)
            monkeypatch.setattr(T, "BLOCK", 7)
            assert np.allclose(m.evidence(new, window), want, atol=1e-9)
            monkeypatch.undo()


def test_expressions_of_two_words_count():
    texts = ["red dog went home", "blue cat went home"] * 20 + ["red cat went home", "blue dog went home"] * 20
    y = np.array([0] * 40 + [1] * 40)
    m = model_of(texts, y, 8, 1, 0.75)
    bad, good = m.evidence(["red cat", "red dog"])
    assert bad > 0.01 > good


def test_logistic_curve_separates():
    slope, offset = T.logistic(np.array([0.0, 0.1, 0.2, 1.0, 1.1, 1.2]), np.array([0, 0, 0, 1, 1, 1]))
    assert slope * 0.2 + offset < 0 < slope * 1.0 + offset
    assert math.isfinite(slope)


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", None), (None, "plain tree", "x"), (902, "vilex " * 20000, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 120] * 2 + [(5, None), (None, 1), (7000, 1)], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for i, _, y in rows:
        assert (got[i] >= 0.5) == bool(y), (i, got[i])
    assert got[900] == got[901] < 0.5
    assert got[902] > 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.learn(docs, empty) is None
    assert {r.score for r in T.score(docs, None).collect()} == {0.0}
    assert T.score(docs.where("false"), model).count() == 0


def test_stage_keeps_columns_of_any_name(spark):
    rows = corpus()
    names = ["evidence", "_t", "score", "_text", "_y"]
    docs = spark.createDataFrame([(i, t, *names) for i, t, _ in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    model = T.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = T.accept(docs, model)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(i, t, *names) for i, t, y in rows if not y}


def test_sample_is_bounded_by_characters_and_repeats(spark):
    docs = spark.createDataFrame([(i % 10, "word " * 100) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    own, train = T.sampled(docs, labels, "doc_id", "text", "toxic", 3000, 1200)
    assert own.count() == 10 and train.groupBy("_y").count().collect() and {r["count"] for r in train.groupBy("_y").count().collect()} == {2}
    assert auc(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0, 0, 1, 1])) == 0.875
