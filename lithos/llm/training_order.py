"""Token-id output in training order.

Documents become token ids and an end id, cut into sequences of ``length`` ids; the last is
filled up with the end id.

1. **Numbers.**  A first pass counts each document's sequences.  Documents in the order of
   (id, hash of the text), null ids last, number the corpus' sequences 0, 1, 2, ... without
   gaps.  The order is total but for rows that are equal in both, whose sequences are equal
   too, so it does not depend on how the input happens to be split.
2. **Slots.**  A keyed Feistel permutation of the smallest power of four that holds all
   numbers, walked along its cycles past values beyond the last number, is a permutation of
   the numbers; its value is the sequence's slot.
3. **Shards.**  Equal ranges of slots are the shards: range partitions of known size, no
   sampling, no skew.  Each is sorted by slot and written as one file of little-endian ids
   with a fixed stride, so slot s is byte (s mod per shard) * stride of file s div per
   shard: reads are sequential, resume at any slot and need no index.

Numbers travel by input partition: each partition's are written to a small file in the
shared folder, which the task that encodes the partition reads.  So no text is shuffled.
The number of shards follows from the size of the output (``SHARD_BYTES`` each).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import settled, shared_dir
from lithos.llm.textops import U, mix, slices
from lithos.llm.tokens import SLICE, encoder

LENGTH = 512
ROUNDS = 6
#: Bytes of a shard, about; its task sorts that much.
SHARD_BYTES = 64 << 20
#: Documents whose numbers are put in order by one task, about.
ORDER_ROWS = 2_000_000


class Feistel:
    """A keyed permutation of [0, size), size up to 2**62, on uint64 arrays."""

    def __init__(self, size: int, key: int):
        self.size = max(1, size)
        self.half = max(1, (max(1, self.size - 1).bit_length() + 1) // 2)
        self.mask = U((1 << self.half) - 1)
        self.keys = mix(U(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> U(self.half), x & self.mask
        for k in self.keys:
            a, b = b, a ^ (mix(b ^ k) & self.mask)
        return a << U(self.half) | b

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self._once(x.astype(np.uint64))
        out = np.flatnonzero(x >= U(self.size))
        while len(out):  # cycle walking
            x[out] = self._once(x[out])
            out = out[x[out] >= U(self.size)]
        return x


def _counts(length: int):
    """(part, id, tie, n) of a partition's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(), TaskContext.get().partitionId()
        for rows in slices(batches, "text", SLICE):
            n = enc.counts(rows.column("text")) // length + 1  # with the end id
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part)), rows.column("id"), rows.column("tie"), pa.array(n)], names=["part", "id", "tie", "n"])

    return run


def _numbered(bases):
    """Rows in order, by bin, to (part, id, tie, first number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if b.num_rows:
                n = b.column("n").to_numpy()
                at = bases.value[b.column("bin")[0].as_py()] if at is None else at
                first = at + np.cumsum(n) - n
                at = int(first[-1] + n[-1])
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("id"), b.column("tie"), pa.array(first)], names=["part", "id", "tie", "first"])

    return run


_FIELDS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("first", pa.int64())])


def _file_numbers(uri: str):
    """Writes the numbers of each input partition, which come together, to a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        mine, part, out = TaskContext.get().taskAttemptId(), None, None
        stream = None

        def close() -> int:
            out.close(), stream.close()
            fs.move(f"{root}/.{part}.{mine}", f"{root}/{part}")  # a retried task writes the same rows
            return part

        for b in batches:
            parts = b.column("part").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], np.diff(parts) != 0, [True]])) if len(parts) else [0]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if parts[x] != part:
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([close()], pa.int64())], names=["part"])
                    part = int(parts[x])
                    stream = fs.open_output_stream(f"{root}/.{part}.{mine}")
                    out = pa.ipc.new_stream(stream, _FIELDS)
                out.write_batch(b.slice(x, y - x).select(["id", "tie", "first"]))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([close()], pa.int64())], names=["part"])

    return run


def _sequences(uri: str, length: int, end_id: int, width: int, total: int, per_shard: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, order = encoder(), Feistel(total, key)
        fs, root = pafs.FileSystem.from_uri(uri)
        numbers: dict[tuple, list[int]] | None = None
        for rows in slices(batches, "text", SLICE):
            if numbers is None:
                numbers = {}
                with fs.open_input_stream(f"{root}/{TaskContext.get().partitionId()}") as f, pa.ipc.open_stream(f) as stored:
                    for b in stored:
                        for i, t, n in zip(*(b.column(k).to_pylist() for k in ("id", "tie", "first")), strict=True):
                            numbers.setdefault((i, t), []).append(n)
            first = np.array([numbers[k].pop() for k in zip(rows.column("id").to_pylist(), rows.column("tie").to_pylist(), strict=True)], np.int64)
            ids, at = enc.ids(rows.column("text"))
            real = np.diff(at) + 1
            n = -(-real // length)
            to = np.cumsum(n) - n
            flat = np.full(int(n.sum()) * length, end_id, f"<u{width}")
            flat[np.repeat(to * length - at[:-1], np.diff(at)) + np.arange(len(ids))] = ids
            owner = np.repeat(np.arange(len(n)), n)
            index = np.arange(len(owner)) - to[owner]
            slot = order(first[owner] + index).astype(np.int64)
            raw, stride = memoryview(flat).cast("B"), length * width
            blobs = [raw[i * stride : (i + 1) * stride] for i in range(len(owner))]
            used = np.minimum(length, real[owner] - index * length)
            cols = [rows.column("id").take(pa.array(owner)), pa.array(index, pa.int32()), pa.array(used, pa.int32()), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), pa.array(slot // per_shard), pa.array(slot), pa.array(blobs, pa.binary())]
            for x in range(0, len(owner), 2000):
                yield pa.RecordBatch.from_arrays([c.slice(x, 2000) for c in cols], names=["id", "seq", "n_ids", "ids_crc32", "shard", "slot", "ids"])

    return run


def _write(uri: str, stride: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        mine, shard, out, place = TaskContext.get().taskAttemptId(), None, None, 0

        def close() -> None:
            out.close()
            fs.move(f"{root}/.{shard:06d}.{mine}", f"{root}/{shard:06d}.bin")  # a retried task writes the same bytes

        for b in batches:
            if not b.num_rows:
                continue
            shards, slots = b.column("shard").to_numpy(), b.column("slot").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], np.diff(shards) != 0, [True]]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if shards[x] != shard:
                    if out is not None:
                        close()
                    shard, place = int(shards[x]), 0
                    out = fs.open_output_stream(f"{root}/.{shard:06d}.{mine}")
                if (slots[x:y] - shard * per_shard != np.arange(place, place + y - x)).any():
                    raise ValueError(f"shard {shard} lacks a slot or has one twice: the input changed between its two readings")
                out.write(b"".join(b.column("ids").slice(x, y - x).to_pylist()))
                place += y - x
            cols = [b.column(k) for k in ("slot", "shard", "id", "seq", "n_ids", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols[:2], pa.array(slots % per_shard * stride), *cols[2:]], names=["slot", "shard", "byte_offset", "id", "seq", "n_ids", "ids_crc32"])
        if out is not None:
            close()

    return run


def training_order(
    docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 50256, key: int = 20240607, shards: int | None = None, width: int = 2
) -> DataFrame:
    """Writes the shards under ``uri`` (default: a new folder of the shared one) and returns one row per sequence:
    slot, shard, byte_offset, id_col, seq, n_ids (those before filling up), ids_crc32.

    Null and empty texts give one sequence of end ids (n_ids 1).  Null ids, repeated ids and
    repeated rows are documents like any other and get slots of their own.  A text of any
    length is one unit of a task's memory.  An empty table writes no shard.  Other columns
    are ignored, whatever their names.  docs must give the same partitions when it is read
    twice, as files and checkpoints do; if it does not, an error is raised.
    """
    spark = docs.sparkSession
    uri = uri or f"{shared_dir(spark).rstrip('/')}/training-order-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(uri)
    numbers = f"{uri}/.numbers"
    fs.create_dir(f"{root}/.numbers", recursive=True)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    counted = settled(rows.mapInArrow(_counts(length), "part bigint, id bigint, tie bigint, n bigint"))
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = 1 + documents // ORDER_ROWS
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("part")]
    ordered = settled(counted.repartitionByRange(bins, *order).sortWithinPartitions(*order).withColumn("bin", F.spark_partition_id()))
    sizes = {r["bin"]: r["n"] for r in ordered.groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # one row a bin
    bases, at = {}, 0
    for k in sorted(sizes):
        bases[k], at = at, at + sizes[k]
    numbered = ordered.mapInArrow(_numbered(spark.sparkContext.broadcast(bases)), "part bigint, id bigint, tie bigint, first bigint")
    numbered.repartition(bins, "part").sortWithinPartitions("part", F.desc("first")).mapInArrow(_file_numbers(numbers), "part bigint").count()

    stride = length * width
    shards = shards or max(1, -(-total * stride // SHARD_BYTES))
    per_shard = max(1, -(-total // shards))
    schema = "id bigint, seq int, n_ids int, ids_crc32 bigint, shard bigint, slot bigint, ids binary"
    sequences = rows.mapInArrow(_sequences(numbers, length, end_id, width, total, per_shard, key), schema)
    parts = max(1, -(-total // per_shard))
    written = sequences.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    written = settled(written.mapInArrow(_write(uri, stride, per_shard), "slot bigint, shard bigint, byte_offset bigint, id bigint, seq int, n_ids int, ids_crc32 bigint"))
    fs.delete_dir(f"{root}/.numbers")
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"length": length, "width": width, "end_id": end_id, "key": key, "sequences": total, "per_shard": per_shard}).encode())
    return written.select("slot", F.col("shard").cast("int").alias("shard"), "byte_offset", F.col("id").alias(id_col), "seq", "n_ids", "ids_crc32")


def read_slots(uri: str, first: int, count: int) -> np.ndarray:
    """count x length ids from slot ``first`` on, by one seek for each shard touched; resumable at any slot."""
    fs, root = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    stride, out, each = m["length"] * m["width"], [], m["per_shard"]
    at, end = first, min(first + count, m["sequences"])
    while at < end:
        to = min(end, (at // each + 1) * each)
        with fs.open_input_file(f"{root}/{at // each:06d}.bin") as f:
            f.seek(at % each * stride)
            out.append(f.read((to - at) * stride))
        at = to
    return np.frombuffer(b"".join(out), f"<u{m['width']}").reshape(-1, m["length"])
