"""Op 5: token ids in binary shards with Elias-Fano document boundaries.

Shard file: magic, ids one after another (2 bytes each if the vocabulary allows, else 4), the
Elias-Fano sequence of document boundaries, that of document ids, then a fixed footer with the
places of the parts. A sequence of n values up to u takes about n * (2 + log2(u / n)) bits plus one
sampled position every SAMPLE values; a lookup reads one sample and the bits from there on.

Nulls: a null text is empty; rows with a null id come first. Rows with one id keep the order of
their texts' hashes, then of the texts. Empty input gives no shards and no rows. Other columns of
the input are ignored. Texts are read one Arrow batch at a time, ids are written as they come.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, input_bytes, new_folder, publish, text_of, written
from .encoding import byte_encoder, with_ends

MAGIC = b"LWTOKENS"
SAMPLE = 256
_HEAD = struct.Struct("<QQBq")  # values, bytes of the upper part, lower bits a value, smallest value
_FOOT = struct.Struct("<QQQQBB8s")  # ids' end, boundaries' end, ids' end, null ids, id width, 0, magic
SHARD_BYTES = 64 << 20


def encode_ef(values: np.ndarray) -> bytes:
    """A non-decreasing int64 array as one Elias-Fano sequence."""
    n = len(values)
    base = int(values[0]) if n else 0
    v = (values - base).astype(np.uint64)
    top = int(v[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lower = b""
    if low:
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lower = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    upper[ones] = 1
    upper = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u8").tobytes()
    return _HEAD.pack(n, len(upper), low, base) + samples + lower + upper


class EliasFano:
    """Lookups in an encoded sequence; read(offset, size) gives its bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        self.n, self.upper_size, self.low, self.base = _HEAD.unpack(read(0, _HEAD.size))
        self.lower_at = _HEAD.size + 8 * -(-self.n // SAMPLE)
        self.upper_at = self.lower_at + -(-self.n * self.low // 8)
        self.size = self.upper_at + self.upper_size

    def block(self, k: int) -> np.ndarray:
        """Values k * SAMPLE and on, SAMPLE of them or as many as there are."""
        first = k * SAMPLE
        count = min(SAMPLE, self.n - first)
        (at,) = struct.unpack("<Q", self.read(_HEAD.size + 8 * k, 8))
        if first + count < self.n:
            (end,) = struct.unpack("<Q", self.read(_HEAD.size + 8 * (k + 1), 8))
        else:
            end = 8 * self.upper_size
        raw = np.frombuffer(self.read(self.upper_at + at // 8, -(-end // 8) - at // 8), np.uint8)
        ones = np.flatnonzero(np.unpackbits(raw, bitorder="little")[at % 8 :])[:count] + at
        high = ones - np.arange(first, first + count)
        value = high.astype(np.int64) << self.low
        if self.low:
            a, b = first * self.low, (first + count) * self.low
            raw = np.frombuffer(self.read(self.lower_at + a // 8, -(-b // 8) - a // 8), np.uint8)
            bits = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, self.low)
            value |= (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)
        return value + self.base

    def get(self, i: int) -> int:
        """select: the i-th value."""
        return int(self.block(i // SAMPLE)[i % SAMPLE])


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.bounds, self.doc_ids, self.nulls = array("q", [0]), array("q"), 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents with their ids one after another, and where each one's end."""
        self.out.write(ids.astype(f"<u{self.width}", copy=False).tobytes())
        self.bounds.extend((ends + self.bounds[-1]).tolist())
        known = [i for i in doc_ids if i is not None]
        self.nulls += len(doc_ids) - len(known)
        self.doc_ids.extend(known)

    def close(self) -> None:
        a = len(MAGIC) + self.bounds[-1] * self.width
        bounds = encode_ef(np.frombuffer(self.bounds, np.int64))
        ids = encode_ef(np.frombuffer(self.doc_ids, np.int64) if self.doc_ids else np.empty(0, np.int64))
        self.out.write(bounds)
        self.out.write(ids)
        self.out.write(_FOOT.pack(a, a + len(bounds), a + len(bounds) + len(ids), self.nulls, self.width, 0, MAGIC))


class Shard:
    """One shard file: document k's id, place and ids, by select."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        a, b, _, self.nulls, self.width, _, magic = _FOOT.unpack(self.file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.bounds = EliasFano(lambda at, n: self.file.read_at(n, a + at))
        self.ids = EliasFano(lambda at, n: self.file.read_at(n, b + at))
        self.n_docs = self.bounds.n - 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        start, end = self.bounds.get(k), self.bounds.get(k + 1)
        return (None if k < self.nulls else self.ids.get(k - self.nulls)), start, self.tokens(start, end)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(id, start, end) of every document, block by block."""
        last, ids, held = 0, iter(()), -1
        for k in range(-(-self.bounds.n // SAMPLE)):
            for j, bound in enumerate(self.bounds.block(k).tolist()):
                i = k * SAMPLE + j - 1  # bound ends document i
                if i >= 0:
                    at = i - self.nulls
                    if at >= 0 and at // SAMPLE != held:
                        held = at // SAMPLE
                        ids = iter(self.ids.block(held).tolist())
                    yield (next(ids) if at >= 0 else None), last, bound
                last = bound

    def close(self) -> None:
        self.file.close()


def shard_count(spark: SparkSession, docs: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // SHARD_BYTES))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs in ascending id order; a table of shard (number), file, docs, tokens and base (ids in
    the shards before it).

    One range shuffle of ids and texts; each partition encodes and writes its shard under a name of
    its own, so a second attempt writes the same file again.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(shards, F.asc_nulls_first("i"), "h").sortWithinPartitions(F.asc_nulls_first("i"), "h", "t")

    def write(batches):
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        number = TaskContext.get().partitionId()
        name = f"{folder}/shard-{number:06d}.tok"
        encoder = byte_encoder(vocabulary)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        counts = []

        def fill(out):
            shard = ShardWriter(out, width)
            batch = head
            while batch is not None:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    shard.add(part.column(0).to_pylist(), *with_ends(*encoder.batch(part.column(1)), end_id, f"<u{width}"))
                batch = next(batches, None)
            counts.extend((len(shard.bounds) - 1, shard.bounds[-1]))
            shard.close()

        publish(name, fill)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "file": [name], "docs": [counts[0]], "tokens": [counts[1]]})

    found = written(rows.select("i", "t").mapInArrow(write, "shard int, file string, docs long, tokens long"), "shards")
    # sums before each shard in two steps, so no task sorts more than a thousandth of a long list
    group = F.floor(F.col("shard") / 1024).alias("g")
    below = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy(group).agg(F.sum("tokens").alias("n")).select("g", F.coalesce(F.sum("n").over(below.orderBy("g")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("tokens").over(below.partitionBy("g").orderBy("shard")), F.lit(0))
    return found.select("*", group).join(groups, "g").select("shard", "file", "docs", "tokens", (F.col("before") + within).alias("base"))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, out = Shard(name), []
                for i, a, b in shard.documents():
                    out.append((i, first + a, b - a, zlib.crc32(shard.tokens(a, b).tobytes())))
                    if len(out) == 8192:
                        yield _batch(out)
                        out = []
                shard.close()
                if out:
                    yield _batch(out)

    parts = 4 * shards.sparkSession.sparkContext.defaultParallelism
    return shards.select("file", "base").repartition(parts, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])


def tokenize_to_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    return read_shards(write_shards(docs, folder, vocabulary, end_id, shard_count(spark, docs)))
