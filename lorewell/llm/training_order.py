"""Token shards in training order: a keyed permutation gives every sequence its slot.

The ids of all documents, in the order of the stored table, are cut into sequences of a
fixed length; documents end with a separator and sequences run over document ends, so only
the last one of a scan split is padded. Sequence ``i`` of ``n`` goes to slot ``permute(i)``: a
Feistel network over the next power of four, walked along its cycles until the result is
below ``n``. It needs no table, and its inverse tells which sequence a slot holds.

Slots are dealt to partitions by exact ranges of shards, so a shard is one sorted file of
records of one size, written by Spark's own writer with its commit protocol. A reader
that stopped at slot ``s`` goes on at byte ``s % per_shard * stride`` of shard ``s // per_shard``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import partitions, shared_dir

SEPARATOR = b"\xff"  # never part of UTF-8
LENGTH = 2047  # ids of a record; with the end mark a stride of 2048 bytes
PER_SHARD = 4096
MARK = "\n"
ROWS = "slot long, shard long, doc_id long, n_ids int, ids binary"


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    n: int
    key: int
    rounds: int = 6

    def _keys(self) -> list[np.uint64]:
        return [np.uint64(int.from_bytes(hashlib.blake2b(f"{self.key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(self.rounds)]

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _network(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in reversed(self._keys()) if inverse else self._keys():
            word = (left if inverse else right) ^ key
            word *= np.uint64(0x9E3779B97F4A7C15)
            word ^= word >> np.uint64(32)
            word *= np.uint64(0xD6E8FEB86659FD93)
            word = (word ^ (word >> np.uint64(29))) & mask
            left, right = (right ^ word, left) if inverse else (right, left ^ word)
        return (left << bits) | right

    def __call__(self, places: np.ndarray, inverse: bool = False) -> np.ndarray:
        x = self._network(np.asarray(places, np.uint64), inverse)
        while len(out := np.flatnonzero(x >= self.n)):  # walk the cycle; under four steps on average
            x[out] = self._network(x[out], inverse)
        return x.astype(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _streams(encode: Callable[[bytes], bytes] | None, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                yield doc, (encode(text) if encode else text) + SEPARATOR * width


def _sizes(source: DataFrame, encode, width: int) -> list[tuple[int, int, int]]:
    """Per scan split: its number, the bytes of its ids, and a check sum of its rows in order."""

    def run(batches):
        size = check = 0
        for doc, ids in _streams(encode, width, batches):
            size += len(ids)
            check = (check * 1_000_003 + len(ids) + hash(doc)) % (1 << 61)
        yield pa.RecordBatch.from_pydict({"split": [TaskContext.get().partitionId()], "size": [size], "sum": [check]})

    rows = source.mapInArrow(run, "split long, size long, sum long").collect()  # one row per scan split
    return sorted((r["split"], r["size"], r["sum"]) for r in rows)


def sequences(source: DataFrame, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, encode=None, width: int = 1) -> tuple[DataFrame, int]:
    """Rows ``slot, shard, doc_id`` (of the first id), ``n_ids, ids`` and the number of sequences."""
    record = length * width
    sizes = _sizes(source, encode, width)
    counts = [-(-size // record) for _, size, _ in sizes]
    bases = {split: (base, size, check) for (split, size, check), base in zip(sizes, np.cumsum([0, *counts])[:-1].tolist())}
    total = sum(counts)
    permute = Permutation(total, key)

    def run(batches):
        base, size, expected = bases.get(TaskContext.get().partitionId(), (0, 0, 0))
        held, begins, check, at, read = bytearray(), [], 0, base, 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, begins, at
            n = len(held) // record + (1 if final and len(held) % record else 0)
            if not n:
                return
            starts, docs = np.array([b for b, _ in begins]), [d for _, d in begins]
            owner = np.searchsorted(starts, np.arange(n) * record, "right") - 1
            cut = [bytes(held[i * record : (i + 1) * record]) for i in range(n)]
            slots = permute(np.arange(at, at + n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(slots // per_shard), pa.array([docs[o] for o in owner], pa.int64()), pa.array([len(c) // width for c in cut], pa.int32()), pa.array([c.ljust(record, SEPARATOR) for c in cut], pa.binary())],
                names=["slot", "shard", "doc_id", "n_ids", "ids"])
            used = n * record
            last = int(np.searchsorted(starts, used, "right")) - 1
            begins = [(max(b - used, 0) if i == last else b - used, d) for i, (b, d) in enumerate(begins) if i >= last]
            del held[:used]
            at += n

        for doc, ids in _streams(encode, width, batches):
            check = (check * 1_000_003 + len(ids) + hash(doc)) % (1 << 61)
            read += len(ids)
            begins.append((len(held), doc))
            held += ids
            if len(held) >= 512 * record:
                yield from flush(False)
        if (read, check) != (size, expected):
            raise RuntimeError("the input changed between two scans; store it first")
        yield from flush(True)

    return source.mapInArrow(run, ROWS), total


def materialise(docs: DataFrame, folder: str | None = None, key: int = 20240501, length: int = LENGTH, per_shard: int = PER_SHARD, encode: Callable[[bytes], bytes] | None = None, width: int = 1) -> tuple[DataFrame, str]:
    """Write the shards of ``docs(doc_id, text)`` and return their index and folder.

    ``docs`` is a stored table, as its row order is the corpus order; a change between
    the two scans is an error. Ids are the UTF-8 bytes of a text with 255 as separator,
    or what ``encode`` makes of a text: little-endian ids of ``width`` bytes each.
    The index has a row per sequence: ``slot, shard, byte_offset, doc_id`` (of the
    document of the first id), ``n_ids`` (without padding) ``, sha256`` (of the padded
    ids). Null and empty texts have no ids; a null ``doc_id`` stays null; repeated
    rows are separate documents; other columns are ignored; an empty table gives an
    empty index and no shard. Long texts span as many sequences as they need.
    """
    spark = docs.sparkSession
    source, record = _source(docs), length * width
    splits = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(splits, None)
    spark.conf.set(splits, before or str(spark.sparkContext.defaultParallelism))  # splits must not follow the number of live executors
    try:
        rows, total = sequences(source, key, length, per_shard, encode, width)
        folder = folder or shared_dir(spark, "training-order")
        shards = -(-total // per_shard)
        if total:
            parts = min(partitions(spark), shards)
            dealt = rows.select("slot", "shard", F.col("ids").cast("string").alias("value")).repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int"))
            dealt.sortWithinPartitions("shard", "slot").select("shard", "value").write.partitionBy("shard").option("lineSep", MARK).option("compression", "none").text(folder)
        index = rows.select("slot", "shard", ((F.col("slot") % per_shard) * (record + len(MARK))).alias("byte_offset"), "doc_id", "n_ids", F.sha2("ids", 256).alias("sha256"))
        path = folder.rstrip("/") + "-index"
        index.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(splits)
        else:
            spark.conf.set(splits, before)
    return spark.read.schema(index.schema).parquet(path), folder


def read_from(spark: SparkSession, folder: str, slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 1) -> DataFrame:
    """``slot, ids`` of all sequences from ``slot`` on; earlier shards are not opened."""
    record, stride = length * width, length * width + len(MARK)
    files = spark.read.format("binaryFile").load(folder).where(F.col("shard") >= slot // per_shard).select(F.col("shard").cast("long").alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)[:, :record]
                slots = np.arange(shard * per_shard, shard * per_shard + len(data))
                use = slots >= slot
                yield pa.RecordBatch.from_arrays([pa.array(slots[use]), pa.array([r.tobytes() for r in data[use]], pa.binary())], names=["slot", "ids"])

    return files.mapInArrow(run, "slot long, ids binary")
