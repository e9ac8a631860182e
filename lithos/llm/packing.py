"""Best-fit packing by hierarchical residual packing.

Level 0: each task tokenises its documents, cuts those over the limit and packs the pieces
of its partition best-fit (longest first).  Bins that are nearly full are done.  Levels 1
and 2: the underfull bins of ``FAN_IN`` tasks meet in one task and are packed again as
items.  Root: what is still underfull is packed over all partitions at once, but by the
*counts* of its fills (2047 numbers at most); each bin then finds its place from its rank
among the bins of the same fill, so no task holds more than a partition.

No task holds more than about ``BUFFER`` pieces (some 100 bytes each), whatever their sizes:
a task packs in turns of that many, and if no bin ever fills, as with documents of just
over half a sequence, the upper levels do too, reading bins one after the other.

One routine, ``plan``, serves every level: best-fit decreasing over counts of sizes, where
a whole class of alike bins is placed in a step.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.shared import settled
from lithos.llm.textops import slices
from lithos.llm.tokens import SLICE, encoder

LIMIT = 2048
#: A bin with at most so much room left is done.
SLACK = 4
FAN_IN = 8
LEVELS = 2
#: Most pieces that a task holds at a time; more are packed in turns.
BUFFER = 400_000
#: Bits of a bin's home that hold the turn; the others hold the partition.
TURN_BITS = 32


def plan(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing.  counts[f]: items of size f.

    Returns runs (size, first rank, last rank + 1, first bin, offset): the k-th item of a
    size, with k in that range of ranks, lies in bin (first bin + k - first rank).
    """
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # room left: [first bin, bins]
    rooms: list[int] = []  # its keys, sorted
    bins = 0

    def add(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append([first, n])

    for f in range(len(counts) - 1, 0, -1):
        rank, left = 0, int(counts[f])
        while left:
            k = bisect.bisect_left(rooms, f)
            if k < len(rooms):
                r = rooms[k]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    rooms.pop(k)
                t = min(n, left)
                add(r, first + t, n - t)
            else:
                r, first = limit, bins
                t = max(1, left // (limit // f))
                bins += t
            runs.append((f, rank, rank + t, first, limit - r))
            add(r - f, first, t)
            rank += t
            left -= t
    return runs


class Places:
    """Finds (bin, offset) for (size, rank) from plan()'s runs."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        runs = sorted(runs)
        self.key = np.array([(r[0] << 44) + r[1] for r in runs], dtype=np.int64)
        self.rank, self.bin, self.offset = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 3, 4))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (size.astype(np.int64) << 44) + rank, side="right") - 1
        return self.bin[at] + rank - self.rank[at], self.offset[at]


def ranks(size: np.ndarray) -> np.ndarray:
    """The rank of each item among those of its size, in the order given."""
    order = np.argsort(size, kind="stable")
    s = size[order]
    out = np.empty(len(size), np.int64)
    out[order] = np.arange(len(s)) - np.searchsorted(s, s)
    return out


def pack(size: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, best-fit decreasing."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Places(plan(np.bincount(size, minlength=limit + 1), limit)).find(size, ranks(size))


_STATE = "bin bigint, offset bigint, fill bigint, home bigint, slot bigint"
_NAMES = ["piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "home", "slot"]


def _dealt(level: int, turn: int, bins: np.ndarray) -> np.ndarray:
    return bins + (level << 60) + (TaskContext.get().partitionId() << 36) + turn * BUFFER


def _rows(id_: pa.Array, cols: dict[str, np.ndarray], inner: np.ndarray, offset: np.ndarray, level: int, turn: int, limit: int) -> pa.RecordBatch:
    """One batch of pieces with their bins: fill, and each bin's rank among those of its fill."""
    fill_of = np.bincount(inner, weights=cols["length"]).astype(np.int64) if len(inner) else np.zeros(0, np.int64)
    slot_of = ranks(fill_of)
    home = np.full(len(inner), (TaskContext.get().partitionId() << TURN_BITS) + turn, np.int64)
    cols = cols | {"bin": _dealt(level, turn, inner), "offset": offset, "fill": fill_of[inner], "home": home, "slot": slot_of[inner]}
    return pa.RecordBatch.from_arrays([id_, *(pa.array(cols[k], pa.int32() if k == "piece" else pa.int64()) for k in _NAMES)], names=["id", *_NAMES])


def pieces_of(n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of documents of n ids; only the first piece may be shorter than the limit."""
    count = -(-n // limit)
    owner = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    head = n - (count - 1) * limit
    start = np.where(piece > 0, head[owner] + (piece - 1) * limit, 0)
    return owner, piece, start, np.where(piece > 0, limit, head[owner])


def _level0(limit: int, end_id: int, ranks_path: str | None, json_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, json_path)
        ids: list[pa.Array] = []
        held: list[tuple[np.ndarray, ...]] = []
        turn = 0

        def flush() -> pa.RecordBatch:
            piece, start, length, crc = (np.concatenate(x) for x in zip(*held, strict=True))
            inner, offset = pack(length, limit)
            return _rows(pa.concat_arrays(ids), {"piece": piece, "start": start, "length": length, "ids_crc32": crc}, inner, offset, 0, turn, limit)

        for rows in slices(batches, "text", SLICE):
            flat, at = enc.ids(rows.column("text"))
            n = np.diff(at) + 1
            to = np.cumsum(n) - n
            tokens = np.full(int(n.sum()), end_id, "<u4")
            tokens[np.repeat(to - at[:-1], n - 1) + np.arange(len(flat))] = flat
            owner, piece, start, length = pieces_of(n, limit)
            raw, lo = memoryview(tokens).cast("B"), to[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            ids.append(rows.column("id").take(pa.array(owner)))
            held.append((piece, start, length, np.array(crc, np.int64)))
            if sum(len(x[0]) for x in held) >= BUFFER // 2:
                yield flush()
                ids, held, turn = [], [], turn + 1
        if held:
            yield flush()

    return run


def _again(level: int, limit: int):
    """Bins, each with its pieces one after the other, packed once more in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = turn = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(kept).combine_chunks()
            cols = {k: t.column(k).to_numpy() for k in _NAMES}
            _, one, inverse = np.unique(cols["bin"], return_index=True, return_inverse=True)
            to, shift = pack(cols["fill"][one], limit)
            own = {k: cols[k] for k in ("piece", "start", "length", "ids_crc32")}
            return _rows(t.column("id").combine_chunks(), own, to[inverse], cols["offset"] + shift[inverse], level, turn, limit)

        for batch in batches:
            while batch.num_rows:
                at = batch.num_rows
                if rows + at >= BUFFER // 2:  # to the end of the bin in which the turn ends
                    bins = batch.column("bin").to_numpy()
                    last = bins[max(0, BUFFER // 2 - rows - 1)]
                    at = int(np.searchsorted(bins, last, side="right"))
                kept.append(batch.slice(0, at))
                rows += at
                full = rows >= BUFFER // 2 and at < batch.num_rows
                batch = batch.slice(at)
                if full:
                    yield flush()
                    kept, rows, turn = [], 0, turn + 1
        if kept:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = 0,
    ranks_path: str | None = None,
    json_path: str | None = None,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then ``end_id``; null and empty texts are that id alone.
    Only documents over ``limit`` are cut; their first piece may be shorter than the limit.
    Null ids, repeated ids and repeated rows are packed like any other.  Of pieces of one
    size any may take a place (ties go by the order of the rows).  A text of any length is
    one unit of a task's memory.  Other columns are ignored, whatever their names; no rows,
    no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, {_STATE}"
    packed = settled(rows.mapInArrow(_level0(limit, end_id, ranks_path, json_path), schema))
    done = [packed.filter(F.col("fill") >= limit - SLACK)]
    left = packed.filter(F.col("fill") < limit - SLACK)
    parts = packed.rdd.getNumPartitions()
    for level in range(1, LEVELS + 1):
        parts = -(-parts // FAN_IN)
        if parts < 2:
            break
        met = left.repartition(parts, F.floor(F.shiftright("home", TURN_BITS) / FAN_IN**level)).sortWithinPartitions("bin")
        packed = settled(met.mapInArrow(_again(level, limit), schema))
        done.append(packed.filter(F.col("fill") >= limit - SLACK))
        left = packed.filter(F.col("fill") < limit - SLACK)

    # Root: bins of one home and fill are numbered by slot; homes follow each other within a fill.
    counts = left.groupBy("home", "fill").agg((F.max("slot") + 1).alias("n"))
    before = Window.partitionBy("fill").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    counts = settled(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    total = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("fill").agg(F.sum("n").alias("n")).collect():  # at most `limit` rows
        total[r["fill"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(plan(total, limit)))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, shift = places.value.find(batch.column("fill").to_numpy(), batch.column("rank").to_numpy())
            cols = [batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(to + (7 << 60)), pa.array(batch.column("offset").to_numpy() + shift)], names=[*out_names[:5], "bin", "offset"])

    out_names = ["id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
    ranked = left.join(counts.select("home", "fill", "base"), ["home", "fill"]).select(*out_names[:5], "offset", "fill", (F.col("base") + F.col("slot")).alias("rank"))
    last = ranked.mapInArrow(root, schema.split(", bin ")[0] + ", bin bigint, offset bigint")
    found = last
    for part in done:
        found = found.unionByName(part.select(*out_names))
    return found.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
