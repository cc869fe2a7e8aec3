"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a unit the table stores the one token that ends the
prefix's encoding.  A token t ending at i and starting at j ends the encoding
of prefix i exactly when t encodes to itself and the pair (last token of prefix
j, t) is compatible, that is, the two keep their boundary when merged on their
own: BPE merges by priority, leftmost first on ties, so a sequence is an
encoding iff each adjacent pair is.  Candidates come from an Aho-Corasick
automaton over the pieces; ids are recovered backwards from the table.

A piece never holds a space mark after another character, so texts fall apart
at those places and each unit's ids can be kept in a bounded cache.  Characters
without a piece become their UTF-8 byte pieces and separate what surrounds them.

Null text counts as empty: begin and end id only.  Ids and decoded texts are
whole whatever a text's length; repeated rows give repeated results, an empty
table an empty one.  Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import mapped, table

MARK = "▁"
#: Entries of the unit cache and the pair memo before they start anew; memory bound of a worker.
CACHE = 400_000


def _fields(buf: bytes):
    """(field, value) pairs of one protobuf message."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """A BPE model file with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        model_type, bos, eos = 1, 1, 2
        norm = {"name": b"", "map": b"", "prefix": 1, "squeeze": 1, "escape": 1}
        for f, v in _fields(data):
            if f == 1:
                d = dict(_fields(v))
                self.pieces.append(d.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.kinds.append(d.get(3, 1))
            elif f == 2:
                d = dict(_fields(v))
                model_type, bos, eos = d.get(3, 1), d.get(41, 1), d.get(42, 2)
            elif f == 3:
                d = dict(_fields(v))
                norm = {"name": d.get(1, b""), "map": d.get(2, b""), "prefix": d.get(3, 1), "squeeze": d.get(4, 1), "escape": d.get(5, 1)}
        if model_type != 2 or norm["map"] or norm["squeeze"] or not norm["prefix"] or not norm["escape"]:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and kept spaces are supported")
        self.bos, self.eos = bos, eos
        self.vocab = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("pieces that cross a space are not supported")


class PieceCodec:
    """Encoder and decoder; one for each Python worker."""

    def __init__(self, model: PieceModel):
        import ahocorasick

        self.m = model
        self.automaton = ahocorasick.Automaton()
        for p, i in model.vocab.items():
            if self._merge(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = {p for p in model.vocab if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        codec = self

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                ids = codec._unit(unit)
                out = struct.pack(f"<{len(ids)}I", *ids)
                if len(unit) <= 64:
                    if len(self) >= CACHE:
                        self.clear()
                    self[unit] = out
                return out

        self.units = Units()
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.head, self.tail = struct.pack("<I", model.bos), struct.pack("<I", model.eos)
        surface = []
        for p, k in zip(model.pieces, model.kinds, strict=True):
            surface.append(b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else p.replace(MARK, " ").encode())
        self.surface = surface
        self.control = {i for i, k in enumerate(model.kinds) if k == 3}

    def _merge(self, s: str) -> list[str]:
        """The pieces that merging by priority, leftmost first on ties, leaves."""
        sym, vocab, scores = list(s), self.m.vocab, self.m.scores
        while len(sym) > 1:
            best, at = None, -1
            for k in range(len(sym) - 1):
                i = vocab.get(sym[k] + sym[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
        return sym

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is None:
            x, y = self.m.pieces[a], self.m.pieces[b]
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[key] = self._merge(x + y) == [x, y]
        return ok

    def _run(self, s: str) -> list[int]:
        """Ids of a string whose characters all have pieces."""
        n = len(s)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end, (i, size) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            j = end - size
            if j == 0 or last[j] >= 0 and self._compatible(last[j], i):
                last[end], start[end] = i, j
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _unit(self, unit: str) -> list[int]:
        out, at = [], 0
        for k, ch in enumerate(unit):
            if ch not in self.known:
                out += self._run(unit[at:k]) if k > at else []
                out += [self.m.byte_id[b] for b in ch.encode()]
                at = k + 1
        return out + (self._run(unit[at:]) if at < len(unit) else [])

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = b"".join(map(self.units.__getitem__, self.split(MARK + text.replace(" ", MARK)))) if text else b""
        return self.head + ids + self.tail if ends else ids

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids vanish, one space of the dummy prefix goes,
        byte pieces form characters, broken ones U+FFFD for each byte."""
        arr = np.frombuffer(ids, "<u4").tolist()
        parts = list(map(self.surface.__getitem__, arr))
        kinds = self.m.kinds
        try:
            if not self.control.isdisjoint(arr[1:-1]):  # a control id parts the bytes around it
                raise ValueError
            text = b"".join(parts).decode()
        except ValueError:
            text = self._broken(arr, parts)
        first = next((i for i in arr if kinds[i] != 3), None)
        return text[1:] if first is not None and self.m.pieces[first][:1] == MARK else text

    def _broken(self, arr: list[int], parts: list[bytes]) -> str:
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i, p in zip(arr, parts, strict=True):
            if self.m.kinds[i] == 6:
                run += p
            else:
                flush()
                out.append(p.decode())
        flush()
        return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def codec_of(data: bytes) -> PieceCodec:
    """The worker's codec for a model; kept from task to task."""
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(PieceModel(data))
    return _codecs[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(df: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", as_array: bool = False) -> DataFrame:
    """(key, ids, decoded string) for each row: whole texts, no shuffle.  Ids are
    little-endian unsigned 32-bit integers, or an array<int>.
    The model (half a MB) is read on the driver and broadcast."""
    spark = df.sparkSession
    with open(model_path or default_model(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    src = df.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches):
        codec = codec_of(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                col = pa.array(ids, pa.binary())
                if as_array:
                    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                    col = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), col, pa.array([codec.decode(x) for x in ids], pa.string())],
                    names=[key, "ids", "decoded"],
                )

    kind = src.schema[key].dataType.simpleString()
    return mapped(src, run, f"`{key}` {kind}, ids {'array<int>' if as_array else 'binary'}, decoded string")


def ids_digest(ids: Column) -> Column:
    return F.sha2(ids, 256)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text for each document."""
    out = encode_decode(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
