"""Training-order materialisation of token ids as fixed-stride binary shards.

Texts become ids with an end id, cut into sequences of LENGTH.  Sequences are
numbered densely (number of earlier sequences of the scan partition and of the
partitions before it), and a keyed Feistel permutation, walking cycles until it
lands below their count, gives each number its global slot.  Slots are dealt to
tasks in ranges of whole shards, sorted, and written as records of one stride:
the number of ids (uint32), then LENGTH ids (uint16, padded with 0).  Slot s is
record s % SHARD of shard s // SHARD: a trainer reads shards in order and resumes
anywhere by seeking.

Ids are made twice (first to count), so nothing is kept between but counts by
partition; one shuffle moves ids to their shards.  The source must give the same
rows in the same partitions again: file scans do, anything else is checkpointed
first.  Shards are written at once, with the rows of their records beside them, under
temporary names and renamed, so a task that runs again replaces its work;
finished shards of an interrupted run are left out of the shuffle when the
manifest (count, key, stride, partition counts) agrees, and their rows are
returned like the others'.

Null and empty texts give one sequence with the end id alone; long texts as many
as they need; repeated rows each their own; an empty table no sequence.  Ids keep
their type; other columns may have any names.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodalis.llm.common import cut, mapped, shared_dir, table

LENGTH = 256
#: Records of a shard.
SHARD = 65_536
ROUNDS = 6
KEY = 20_240_229


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Feistel:
    """A keyed permutation of range(n) for uint64 arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(r.to_bytes(4, "little"), key)) for r in range(ROUNDS)]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return (x ^ x >> np.uint64(31)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._f(left, k), left
            else:
                left, right = right, left ^ self._f(right, k)
        return left << np.uint64(self.half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(x.astype(np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out


class Encoder:
    """Ids (uint16) of texts with an end id, by byte-level BPE ranks."""

    def __init__(self, ranks: bytes):
        import public_tokenizers
        import tiktoken

        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        if len(own) >= 65_536:
            raise ValueError("ids need more than 16 bits")
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
        self.eos = np.array([len(own)], "<u2").tobytes()  # the first free id

    def count(self, text: str | None) -> int:
        """Ids of a text, the end id too."""
        return (len(self.bpe.encode_ordinary(text)) if text else 0) + 1

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.eos
        ids = array("H", self.bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes() + self.eos


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    if (k := hash(model)) not in _encoders:
        _encoders.clear()
        _encoders[k] = Encoder(model)
    return _encoders[k]


def _fs(uri: str):
    """(file system, path) of a folder that all executors see."""
    from pyarrow import fs

    # Hadoop writes local URIs with one slash
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def sequences(n_bytes: int, length: int = LENGTH) -> int:
    return -(-n_bytes // (2 * length))


def materialise(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD, seed: int = KEY, stable: bool = False, ranks_path: str | None = None) -> DataFrame:
    """Writes ``df``'s sequences under ``folder`` and returns their rows (slot,
    shard, record, key, part, n_tokens, digest), those of earlier runs too."""
    spark = df.sparkSession
    with open(ranks_path or default_ranks(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    src = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    src = src if stable else cut(src)

    def count(batches):
        enc, n = _encoder(model.value), 0
        for b in batches:
            n += sum(sequences(2 * enc.count(t), length) for t in b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], names=["p", "n"])

    counts = sorted((r.p, r.n) for r in mapped(src, count, "p long, n long").collect())  # two numbers a partition
    total = sum(n for _, n in counts)
    base, at = {}, 0
    for p, n in counts:
        base[p] = at
        at += n
    kind = src.schema["_k"].dataType
    rows = f"slot long, shard long, record long, `{key}` {kind.simpleString()}, part int, n_tokens int, digest long"
    if not total:
        return spark.createDataFrame([], rows)
    bases, stride, shards = spark.sparkContext.broadcast(base), 4 + 2 * length, -(-total // shard)
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    manifest = {"count": total, "length": length, "shard": shard, "stride": stride, "dtype": "<u2", "key": seed, "partitions": xxhash.xxh64_hexdigest(json.dumps(counts))}
    done = _done(fs, path, manifest, total, shard, stride)
    key_type = to_arrow_type(kind)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())

    def deal(batches):
        enc, order, i = _encoder(model.value), Feistel(total, seed), bases.value[TaskContext.get().partitionId()]
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                keys, parts, ids = [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = enc(t)
                    for j in range(sequences(len(raw), length)):
                        keys.append(k)
                        parts.append(j)
                        ids.append(raw[2 * length * j : 2 * length * (j + 1)])
                slot = order(np.arange(i, i + len(ids), dtype=np.uint64)).view(np.int64)
                i += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(keys, key_type), pa.array(parts, pa.int32()), pa.array(ids, pa.binary())], names=["slot", "k", "part", "ids"])

    def write(batches):
        fs, path = _fs(folder)
        at, out, temp, index = -1, None, "", []

        def close():
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{temp}.rows") as f:
                    pq.write_table(pa.Table.from_batches(index), f)
                fs.move(f"{temp}.rows", f"{path}/{at:08d}.parquet")
                fs.move(temp, f"{path}/{at:08d}.bin")

        for whole in batches:
            shards = whole.column(0).to_numpy() // shard
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                b = whole.slice(a, e - a)
                if e > a and shards[a] != at:
                    close()
                    at, index = int(shards[a]), []
                    temp = f"{path}/{at:08d}.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temp)
                n, digest = [], []
                for raw in b.column(3).to_pylist():
                    record = (len(raw) // 2).to_bytes(4, "little") + raw.ljust(2 * length, b"\0")
                    out.write(record)
                    n.append(len(raw) // 2)
                    digest.append(xxhash.xxh64_intdigest(record))
                slot = b.column(0).to_numpy()
                index.append(
                    pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(slot // shard), pa.array(slot % shard), b.column(1), b.column(2), pa.array(n, pa.int32()), pa.array(np.array(digest, np.uint64).view(np.int64))],
                        names=["slot", "shard", "record", key, "part", "n_tokens", "digest"],
                    )
                )
        close()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["last"])

    dealt = mapped(src, deal, f"slot long, k {kind.simpleString()}, part int, ids binary")
    if done:
        dealt = dealt.where(~(F.col("slot") / shard).cast("long").isin(done)) if len(done) < 1000 else dealt.join(F.broadcast(spark.createDataFrame([(s,) for s in done], "s long")), F.expr(f"slot div {shard} = s"), "left_anti")
    by_shard = dealt.repartitionById(int(shards), (F.expr(f"slot div {shard}")).cast("int")).sortWithinPartitions("slot")
    if len(done) < shards:
        mapped(by_shard, write, "last long").write.format("noop").mode("overwrite").save()
    _sweep(fs, path)
    return spark.read.schema(rows).parquet(f"{folder}/*.parquet")


def _listed(fs, path: str) -> dict[str, int]:
    """Sizes of the files of a folder, by name."""
    from pyarrow.fs import FileSelector, FileType

    return {i.base_name: i.size for i in fs.get_file_info(FileSelector(path)) if i.type == FileType.File}


def _done(fs, path: str, manifest: dict, total: int, shard: int, stride: int) -> list[int]:
    """Shards that an earlier run with the same manifest has finished; those of
    another manifest are removed."""
    found = _listed(fs, path)
    if "manifest.json" in found:
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            if json.loads(f.read()) != manifest:
                for name in found:
                    fs.delete_file(f"{path}/{name}")
                return []
    whole = {int(m[1]) for name, size in found.items() if (m := re.fullmatch(r"(\d{8,})\.bin", name)) and size == stride * (min(total, (int(m[1]) + 1) * shard) - int(m[1]) * shard)}
    return sorted(s for s in whole if f"{s:08d}.parquet" in found)


def _sweep(fs, path: str) -> None:
    """Removes what tasks that failed have left."""
    for name in _listed(fs, path):
        if ".tmp" in name:
            fs.delete_file(f"{path}/{name}")


def read_from(folder: str, slot: int = 0):
    """(slot, ids) of the records from a slot on, in training order."""
    fs, path = _fs(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    for s in range(slot // m["shard"], -(-m["count"] // m["shard"])):
        with fs.open_input_file(f"{path}/{s:08d}.bin") as f:
            first = max(slot, s * m["shard"])
            f.seek((first - s * m["shard"]) * m["stride"])
            for i in range(first, min(m["count"], (s + 1) * m["shard"])):
                raw = f.read(m["stride"])
                n = int.from_bytes(raw[:4], "little")
                yield i, np.frombuffer(raw[4 : 4 + 2 * n], m["dtype"])


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return materialise(table(spark, sf_dir, "documents"), folder, stable=True).withColumn("folder", F.lit(folder))
