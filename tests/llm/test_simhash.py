import random

import numpy as np
import xxhash

from nodalis.llm import simhash as S
from nodalis.llm.components import components

TEXT = "doc_id long, text string, text2 string"


def brute_components(fps, radius):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_definition():
    text = "One two\tTHREE  four\nfive É"
    words = "one two three four five É".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert S.fingerprint(S.shingle_hashes(text, 3)) == want
    assert S.fingerprint(S.shingle_hashes("A b", 3)) == xxhash.xxh64_intdigest("a b", 42)
    assert S.fingerprint(S.shingle_hashes(None, 3)) == S.fingerprint(S.shingle_hashes(" \n", 3)) == 0


def test_exact_masks_cover_every_pair_within_the_radius():
    r = random.Random(1)
    masks = S.exact_masks(3)
    for _ in range(500):
        d = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not d & m for m in masks)


def test_index_finds_what_brute_force_finds():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 63, 40).astype(np.uint64)) for _ in range(30)]))
    ix = S.GrayIndex(codes)
    for radius in (0, 2, 3, 20):
        q, p, d = ix.within(codes[:50], radius)
        got = {(int(a), int(ix.codes[b]), int(c)) for a, b, c in zip(q, p, d)}
        want = {(i, int(c), int(codes[i] ^ c).bit_count()) for i in range(50) for c in codes.tolist() if (int(codes[i]) ^ c).bit_count() <= radius}
        assert got == {(a, b, (int(codes[a]) ^ b).bit_count()) for a, b, _ in want}


def test_forest_joins_the_same_components_as_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 25, dtype=np.uint64)
    codes = base
    for _ in range(5):
        codes = np.unique(np.concatenate([codes, codes ^ (np.uint64(1) << r.integers(0, 63, len(codes)).astype(np.uint64))]))
    edges = S.forest(codes, 3)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in edges:
        assert (int(codes[a]) ^ int(codes[b])).bit_count() <= 3
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = brute_components(codes.tolist(), 3)
    assert len(edges) == len(codes) - len(set(want))
    assert [find(i) for i in range(len(codes))] == want


def test_groups_against_brute_force_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 3)  # hot groups fall into pairs of chunks
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(0, None, "x"), (1, "", "x"), (2, " \t", "x")]
    for i in range(12):
        t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 60, 300]))]
        for _ in range(r.choice([1, 2, 9])):
            u = list(t)
            if r.random() < 0.7:
                u[r.randrange(len(u))] = "changed"
            rows.append((len(rows), " ".join(u), "x"))
    rows.append((len(rows), rows[-1][1], None))
    df = spark.createDataFrame(rows, TEXT)
    got = {x.doc_id: (x.fp, x.component) for x in S.near_groups(S.fingerprints(df)).collect()}
    fps = [S.fingerprint(S.shingle_hashes(t, 3)) for _, t, _ in rows]
    assert [got[i][0] & (2**64 - 1) for i in range(len(rows))] == fps
    assert [got[i][1] for i in range(len(rows))] == brute_components(fps, 3)


def test_one_hot_ball_of_codes(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    codes = [1 << a | 1 << b for a in range(14) for b in range(a)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "doc_id long, fp long")
    assert {x.component for x in S.near_groups(df).collect()} == {0}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], TEXT)
    assert S.near_groups(S.fingerprints(empty)).count() == 0
    df = spark.createDataFrame([(None, "a b c d", "x"), (7, "a b c d", "x"), (None, "zz", "x")], TEXT)
    got = sorted((x.doc_id or -1, x.component or -1) for x in S.near_groups(S.fingerprints(df)).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(40, 30), (30, 40), (50, 50), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 40: 30}


def test_sampled_masks_keep_their_promise():
    r = random.Random(5)
    masks = S.sampled_masks(100_000, 0.15, 0.02)
    hit = sum(any(not d & m for m in masks) for d in (sum((r.random() < 0.15) << b for b in range(64)) for _ in range(2000)))
    assert hit > 0.93 * 2000


def test_strongest_forest_equals_kruskal():
    r = np.random.default_rng(6)
    n, m = 60, 400
    u, v, w = r.integers(0, n, m), r.integers(0, n, m), r.random(m)
    got = S.most_similar(np.arange(n), u, v, w)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for i in np.argsort(-w):
        a, b = find(u[i]), find(v[i])
        if a != b:
            root[a] = b
            want.append(i)
    assert sorted(got.tolist()) == sorted(want)


def similar(a, b):
    a, b = (set(S.shingle_hashes(t, S.NEAR_SHINGLE).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_that_repeat_a_line_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(40):
        body = " ".join(f"w{r.randrange(10**9)}" for _ in range(150))
        line = " ".join(f"l{r.randrange(10**9)}" for _ in range(8))
        rows += [(2 * i, f"{body} " + f"{line} " * 2, "x"), (2 * i + 1, f"{body} " + f"{line} " * r.choice([10, 20, 40]), "x")]
    got = {(x.doc_id, x.component) for x in S.near_copies(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {(j, i) for i, a, _ in rows for j, b, _ in rows if i < j and similar(a, b) >= S.NEAR_LEAST}
    assert len(got) == 40


def test_a_refused_pair_hides_no_other(spark):
    codes = np.array([0, 1, 3], np.uint64)  # two sure copies, and a third doubtful with both
    sketches = np.ones((3, S.BINS), np.uint8)
    sketches[1, :6] = 2
    sketches[2, 6:24] = 3
    edges = {(min(a, b), max(a, b)) for a, b, _ in S.forest(codes, 18, sketches, 0.7, 0.9)}
    # the sure copies, and the more similar of the doubtful pairs; a refusal is settled exactly below
    assert (0, 1) in edges and len(edges) == 2 and edges <= {(0, 1), (0, 2), (1, 2)}
    r = random.Random(8)
    made, near = [], 0
    while near < 6:  # x is more like c by the sketches, but only d is a near copy of it
        c = [f"w{r.randrange(10**9)}" for _ in range(300)]
        d, x = list(c), list(c)
        for i in range(4, 300, 44):
            x[i] = "x"
        d[4] = d[48] = "x"
        d[20] = "d"
        t = [" ".join(w) for w in (c, d, x)]
        h = [S.shingle_hashes(w, S.NEAR_SHINGLE) for w in t]
        s = [np.frombuffer(S.sketch(w), np.uint8)[None] for w in h]
        cd, cx, dx = (float(S.alike(s[a], s[b])[0]) for a, b in ((0, 1), (0, 2), (1, 2)))
        if cd >= 0.9 > cx > dx >= 0.7 and similar(t[0], t[2]) < 0.8 <= similar(t[1], t[2]):
            made += [(3 * near + i, w, "x") for i, w in enumerate(t)]
            near += 1
    got = {(x.doc_id, x.component) for x in S.near_copies(spark.createDataFrame(made, TEXT)).collect()}
    assert got == {(3 * i + j, 3 * i) for i in range(near) for j in (1, 2)}


def test_null_and_repeated_ids_do_not_change_the_links(spark):
    rows = [(1, 0b111), (9, 0b111111111), (None, 0b111111), (7, 0xFF << 40), (None, 0xFE << 40), (5, 0xFF << 20), (5, 0xFFFF << 48), (None, 0xFFFFFF << 8)]
    got = {(x.doc_id, x.fp & (2**64 - 1)): x.component for x in S.near_groups(spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")).collect()}
    assert [got[r] for r in rows] == [1, 1, 1, 7, 7, 5, 5, None]
    rows = [(5, 0xFF << 20), (5, 0xFF << 50), (6, 0x7F << 20), (3, 0x7F << 50)]
    got = {(x.doc_id, x.fp): x.component for x in S.near_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert [got[r] for r in rows] == [5, 3, 5, 3]


def test_exact_links_join_what_brute_force_joins(spark, monkeypatch):
    r = random.Random(11)
    sets = []
    for _ in range(12):
        base = [r.randrange(10**6) for _ in range(60)]
        for _ in range(r.randint(1, 9)):
            s = set(base)
            for _ in range(r.randint(0, 12)):
                s.discard(r.choice(base))
            sets.append(sorted(s | {r.randrange(10**6) for _ in range(r.randint(0, 4))}))
    sets.append([])
    n = len(sets)
    near = {(i, j) for i in range(n) for j in range(i) if sets[i] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    for labels in (np.arange(n), np.arange(n) // 3):
        ids = np.arange(n) * 10
        edges = S.exact_links(ids, labels, np.array([x for s in sets for x in s]), np.array([len(s) for s in sets]), 0.8)
        assert len(edges) < n

        def joined(pairs, labels=labels):
            root = {int(x): int(x) for x in labels}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                a, b = find(int(labels[a])), find(int(labels[b]))
                root[max(a, b)] = min(a, b)
            return [find(int(x)) for x in labels]

        assert joined([(a // 10, b // 10) for a, b in edges]) == joined(near)


def test_a_large_doubtful_group_gives_few_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "SETTLE_ROWS", 40)  # chunks meet in pairs
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(200), 2):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w), "x"))
    got = {x.doc_id: x.component for x in S.near_copies(spark.createDataFrame(rows, TEXT)).collect()}
    root = list(range(120))
    sets = [set(S.shingle_hashes(t, S.NEAR_SHINGLE).tolist()) for _, t, _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(120):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert 0 < len(got) and {i: find(i) for i in range(120) if find(i) != i} == got
