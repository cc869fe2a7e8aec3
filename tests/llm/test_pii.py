import hashlib
import random
import re

from pyspark.sql import functions as F

from nodalis.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (name, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if name == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    r = random.Random(7)
    bits = ["a@b.c", "@", ".", "_", "+", " ", "-", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 010-9999", "x", "é", "😀", "a.b%c@d-e.f.g", "1.2.3.4", "(", ")", "\n", "378282246310005", "0000"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a@b.c@d.e", "a@b.c_d@e.f", "9" * 5000, "+1" + "(" * 3000, "a" * 20000 + "@b", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111 0", "+1234567890123456"]
    texts.append("word x@y.zz 10.0.0.1 " * 2000)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    got = {x["_k"]: [(b.s, b.k, b.e) for b in x.base] for x in pii.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t, got[i], brute(t))


def contextual():
    rows = []
    for i in range(12):
        rows.append((i, f"hello there, client mail u{i}@mail.example then more words {i}"))
    rows.append((50, "hello there, client mail k9-77231x then more"))
    rows.append((51, "nothing here but version 20.04.15 words"))
    rows.append((52, None))
    return rows


def test_patterns_discover_unseen_identifiers(spark):
    rows = contextual()
    df = spark.createDataFrame(rows + [rows[-3], (None, "client mail q8-8812z now")], "doc_id long, text string")
    got = pii.find(df).collect()
    assert len(got) == len(df.collect())
    new = {(x.doc_id, rows_text[s.s : s.e]) for x in got for s in x.spans if s.k == 4 for rows_text in [dict(rows).get(x.doc_id) or "client mail q8-8812z now"]}
    assert (50, "k9-77231x") in new and (None, "q8-8812z") in new
    assert all(x.doc_id != 51 or not x.spans for x in got)
    base = {x.doc_id: [(b.s, b.k, b.e) for b in x.base] for x in got}
    assert all(base[i] == brute(t) for i, t in rows)


def test_redaction_and_digests(spark):
    df = spark.createDataFrame([(1, "é a@b.cc and +1 555 010 9999 😀 end", "k"), (2, None, None), (3, "plain", "z")], "doc_id long, text string, h string")
    got = {x.doc_id: x for x in pii.redact(df).collect()}
    assert got[1].text == "é [EMAIL] and [PHONE] 😀 end" and got[1].h == "k"
    assert got[2].text is None and got[3].text == "plain"
    assert pii.redact(df.where("false")).count() == 0
    d = pii.find(df).select("doc_id", pii._list("base").alias("b"), F.sha2(pii._list("base").cast("binary"), 256).alias("s")).collect()
    assert {x.doc_id: x.b for x in d} == {1: "email:2:8,phone:13:28", 2: "", 3: ""}
    assert {x.doc_id: x.s for x in d}[2] == hashlib.sha256(b"").hexdigest()


def test_main_path_has_no_python(spark, tmp_path):
    df = spark.createDataFrame(contextual(), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/plan.parquet")
    plan = pii.scan(spark.read.parquet(f"{tmp_path}/plan.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[x.doc_id][s.s : s.e] for x in pii.find(df).collect() for s in x.spans if s.k == 4}


def test_base_spans_of_several_tokens_or_no_digit_teach(spark):
    phones = [f"+1 (743) 555-{i:04}" for i in range(12)]
    cards = [c for c in (f"4111 1111 1111 {i:04}" for i in range(200)) if luhn(c.replace(" ", ""))][:12]
    for base in (phones, cards):
        assert found(spark, [f"please ring desk {b} now" for b in base] + ["so ring desk AB-99812 now"]) == {"AB-99812"}
    assert found(spark, [f"their client mail {c}@mail.example then more" for c in "abcdefghijkl"] + ["client mail AB-99812 too"]) == {"AB-99812"}


def test_an_identifier_after_a_digit_token_is_found(spark):
    assert found(spark, [f"in room 12 u{i}@mail.example sits" for i in range(12)] + ["go to room 12 AB-99812 now"]) == {"AB-99812"}


def test_found_instances_support_new_patterns(spark):
    base = [f"their client mail u{i}@mail.example then" for i in range(40)]
    ids = [f"XK-{i:05}" for i in range(6)]
    texts = base + [f"a client mail {v} then" for v in ids] + [f"the badge number {v} here" for v in ids] + ["a badge number QQ-77777 here", "other word 123456 here"]
    assert found(spark, texts) == {*ids, "QQ-77777"}


def brute_ids(texts):
    """Spans of kind id by the docstring's rules, in plain Python."""
    edges = []  # (text number, start, end, instance, seed, patterns)

    def context(text, s, e):
        left = re.sub(r"\S+$", "", text[max(0, s - pii.CONTEXT_CHARS) : s])
        right = re.sub(r"^\S+", "", text[e : e + pii.CONTEXT_CHARS])
        left, right = ([re.sub("[0-9]", "0", w.lower()) for w in x.split()] for x in (left, right))
        one, two, after = (left[-1:] or [""])[0], (left[-2:-1] or [""])[0], (right[:1] or [""])[0]
        return (("before", one), ("two", one, two), ("around", one, after))

    for n, text in enumerate(texts):
        base = brute(text)
        edges += [(n, s, e, text[s:e], True, context(text, s, e)) for s, _, e in base]
        for m in re.finditer(r"\S*[0-9@_]\S*", text):
            s, e = m.start(), m.end()
            a, b = s, e
            while a < b and not text[a].isalnum():
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if b - a >= pii.TOKEN_CHARS and not any(x < b and y > a for x, _, y in base):
                edges.append((n, a, b, text[a:b], False, context(text, s, e)))
    seeds = {v for *_, v, seed, _ in edges if seed}
    pairs = {(p, v) for *_, v, _, ps in edges for p in ps}
    conf = {v: float(v in seeds) for _, v in pairs}
    for step in range(pii.ROUNDS):
        of = {}
        for p, v in pairs:
            of.setdefault(p, []).append(conf[v])
        sure = {p: sum(c) / len(c) for p, c in of.items() if sum(c) / len(c) >= pii.LEAST and sum(x >= pii.LEAST for x in c) >= pii.SUPPORT}
        miss = dict.fromkeys(conf, 1.0)
        for p, v in pairs:
            miss[v] *= 1 - min(sure.get(p, 0), 1 - 1e-9)
        conf = {v: max(float(v in seeds), 1 - m) for v, m in miss.items()}
    return {(n, s, e) for n, s, e, _, seed, ps in edges if not seed and any(p in sure for p in ps)}


def test_bootstrapping_against_brute_force(spark):
    r = random.Random(5)
    some = 0
    for words, ids in ((4, 30), (12, 60), (30, 400)):
        vocab = [f"w{'abcdefghijklmnopqrstuvwxyzäöü'[i]}" for i in range(min(words, 29))]
        unknown = [f"K{r.randint(0, ids):05}-{r.choice('xyz')}_" for _ in range(ids)]

        def piece():
            x = r.random()
            return r.choice(vocab) if x < 0.8 else f"({r.choice('abcdefgh')}{r.randint(0, 50)}@m.example)" if x < 0.92 else r.choice(unknown) if x < 0.95 else r.choice(["10.0.0.7", "+1 (555) 010-1234", "12", "300.1.1.1", "4111 1111 1111 1111"])

        texts = [" ".join(piece() for _ in range(r.randint(0, 25))) for _ in range(120)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = {(x.doc_id, s.s, s.e) for x in pii.find(df).collect() for s in x.spans if s.k == 4}
        want = brute_ids(texts)
        assert got == want
        some += len(want)
    assert some > 20


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"ab{i}xyz c +1 555 010 {1000 + i % 9000}" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {x["_k"]: x for x in pii.scan(df).collect()}
    assert [(b.s, b.k, b.e) for b in got[1].base] == brute(text) and len(got[1].tokens) == 20_000
    out = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert out[1] == re.sub(r"\+1 555 010 [0-9]+", "[PHONE]", text)


def test_redaction_with_any_column_names(spark):
    names = ["_k", "_h", "_s", "_t", "f", "row", "t", "k", "h", "spans", "base"]
    df = spark.createDataFrame([(1, "to a@b.cc", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = pii.redact(df)
    assert got.columns == df.columns
    assert got.first() == (1, "to [EMAIL]", *names)
