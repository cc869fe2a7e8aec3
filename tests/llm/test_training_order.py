import numpy as np
import pytest

from nodalis.llm import training_order as T


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = T.Feistel(n, 5)
    x = np.arange(n, dtype=np.uint64)
    y = p(x)
    assert sorted(y.tolist()) == list(range(n))
    assert (p(y, back=True) == x).all()
    if n >= 64:
        assert (y != x).mean() > 0.9
        assert (T.Feistel(n, 6)(x) != y).mean() > 0.9


def encoder():
    with open(T.default_ranks(), "rb") as f:
        return T.Encoder(f.read())


def test_encoder_equals_the_library():
    enc = encoder()
    for t in ("a b", "  x  y ", "q é\n\n z", "日本 語", "a", "<|endoftext|>", "a" * 100_000):
        ids = np.frombuffer(enc(t), "<u2").tolist()
        assert ids == enc.bpe.encode_ordinary(t) + [50256] and enc.bpe.decode(ids[:-1]) == t
    assert np.frombuffer(enc(None), "<u2").tolist() == np.frombuffer(enc(""), "<u2").tolist() == [50256]


def test_round_trip_and_resume(spark, tmp_path):
    enc = encoder()
    rows = [(i, "word " * (i * 7), "x") for i in range(40)] + [(40, None, "x"), (None, "z", "x"), (41, "dup", "x"), (41, "dup", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3)
    df.write.parquet(f"{tmp_path}/in")
    src = spark.read.parquet(f"{tmp_path}/in")
    out = f"file:{tmp_path}/out"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "manifest.json").write_text('{"of": "another run"}')
    (tmp_path / "out" / "00000000.bin").write_bytes(b"old")
    got = T.materialise(src, out, length=16, shard=10, stable=True)
    got = got.limit(1).collect() and got.collect()  # an action more writes nothing
    want = {}
    for i, t, _ in rows:
        ids = np.frombuffer(enc(t), "<u2").tolist()
        want.setdefault(i, []).append([ids[a : a + 16] for a in range(0, len(ids), 16)])
    n = sum(len(s) for v in want.values() for s in v)
    assert sorted(r.slot for r in got) == list(range(n))
    read = dict(T.read_from(out))
    assert sorted(read) == list(range(n))
    at = {r.slot: r for r in got}
    back = {}
    for s, ids in read.items():
        r = at[s]
        assert (r.shard, r.record, r.n_tokens) == (s // 10, s % 10, len(ids))
        back.setdefault(r.doc_id, []).append((r.part, ids.tolist()))
    assert {i: sorted(x) for i, x in back.items()} == {i: sorted((j, c) for v in vs for j, c in enumerate(v)) for i, vs in want.items()}
    assert [s for s, _ in T.read_from(out, 23)] == list(range(23, n))
    # a run that lost two shards makes those again, the same, and returns all rows
    late = (tmp_path / "out" / "00000002.bin").stat().st_mtime_ns
    first = (tmp_path / "out" / "00000001.bin").read_bytes()
    (tmp_path / "out" / "00000001.bin").unlink()
    (tmp_path / "out" / "00000003.bin").write_bytes(b"cut off")
    again = T.materialise(src, out, length=16, shard=10, stable=True).collect()
    assert sorted(again, key=lambda r: r.slot) == sorted(got, key=lambda r: r.slot)
    assert (tmp_path / "out" / "00000002.bin").stat().st_mtime_ns == late
    assert not list((tmp_path / "out").glob("*.tmp*"))
    assert (tmp_path / "out" / "00000001.bin").read_bytes() == first


def test_empty_and_unstable(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.materialise(df, f"{tmp_path}/e").count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").repartition(2)
    assert sorted(r.slot for r in T.materialise(df, f"{tmp_path}/u").collect()) == [0, 1]
