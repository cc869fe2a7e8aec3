import random

import numpy as np
import pytest

from nodalis.llm import pieces as P
from nodalis.llm import ppm


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    with open(P.default_model(), "rb") as f:
        return P.codec_of(f.read()), sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def test_ids_and_texts_equal_the_library(both):
    codec, ref = both
    r = random.Random(1)
    alphabet = "ab  ▁\n\té́ ﬁ　😀日本語𝕏<s>0x tiontheing   \0"
    for _ in range(3000):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        ids = ref.encode(s, add_bos=True, add_eos=True)
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == ids
        assert codec.decode(codec.encode(s)) == ref.decode(ids)


def test_decode_of_any_ids(both):
    codec, ref = both
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.choice([r.randint(3, 300), r.randint(1, 31999)]) for _ in range(r.randint(0, 9))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == ref.decode(ids), ids


def test_encode_decode_rows(spark, both):
    codec, ref = both
    long = "the of and " * 30000 + "a" * 5000
    rows = [(1, "Hello  world", 1), (2, None, 2), (3, "", None), (None, "x y", 3), (4, long, 4), (4, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = P.encode_decode(df).collect()
    assert len(got) == 6
    for r, (i, t, _) in zip(got, rows, strict=True):
        assert r.doc_id == i and r.decoded == (t or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ref.encode(t or "", add_bos=True, add_eos=True)
    assert P.encode_decode(df.where("false")).count() == 0


def brute_bits(grams, text):
    """Code length of a text in one language by the definition."""
    import math

    buf, bits = ppm.PAD + text, 0.0
    for i in range(len(ppm.PAD), len(buf)):
        for k in range(ppm.ORDER, -1, -1):
            ctx = buf[i - k : i]
            code = int.from_bytes(ctx, "big")
            seen = {g & 255: n for g, n in grams[k].items() if g >> 8 == code} if k else dict(grams[0])
            total, kinds = sum(seen.values()), len(seen)
            if not total:
                continue
            if buf[i] in seen:
                bits -= math.log2(seen[buf[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition(monkeypatch):
    train = {"aa": [b"the cat sat on the mat", b"that hat"], "bb": ["le chat était là".encode()]}
    grams = {k: ppm.count_grams(v) for k, v in train.items()}
    trees = ppm.ByteTrees(grams)
    texts = [b"the hat", "chatte éà".encode(), b"zzz\xff\x00", b"", b"t", b"the cat " * 40]
    want = [[brute_bits(grams[k], t) for k in ("aa", "bb")] for t in texts]
    assert np.allclose(trees.code_lengths(texts), want)
    monkeypatch.setattr(ppm, "BLOCK", 7)
    assert np.allclose(trees.code_lengths(texts), want)


def test_language_rows(spark):
    rows = [(i, "the cat and the dog walk in the wood " * 3, "en", 1) for i in range(20)] + [(100 + i, "der hund und die katze gehen in den wald " * 3, "de", 1) for i in range(20)]
    more = [(200, None, "en", 1), (201, "12 34 !", None, 1), (202, "", "de", 1), (203, "die katze und der hund", None, 1), (None, "the dog", "en", 1), (204, "the wood and the cat " * 50000, None, 1)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, score int")
    grams = ppm.learn(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in ppm.identify(df, grams).collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[203][0] == "de" and got[204][0] == "en" and got[None][0] == "en"
    assert all(got[i][0] == "en" and 0.5 <= got[i][1] <= 1 for i in range(20))
    assert {r.lang_pred for r in ppm.identify(df, {}).collect()} == {"und"}
    assert ppm.identify(df.where("false"), grams).count() == 0


def test_numerals_are_no_letters(spark):
    df = spark.createDataFrame([(i, "the cat and the dog " * 5, "en", 1) for i in range(5)] * 3, "doc_id long, text string, lang string, bits int")
    grams = ppm.learn(df)
    assert sum(grams["en"][0].values()) == 5 * 100
    odd = spark.createDataFrame([(1, "½ ²"), (2, "٣ Ⅷ ①"), (3, "½ a"), (4, "ª"), (5, "字")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in ppm.identify(odd, grams).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en", 5: "en"}
