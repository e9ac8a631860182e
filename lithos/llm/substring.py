"""Substring dedup over prefix-partitioned subtrees of the corpus' suffix tree.

A *suffix* is a word position with at least ``window`` words of its document ahead; in the
tree of all suffixes, internal nodes at depth >= ``window`` are the repeats.  The tree is
built in parts that fit in memory:

* **Partition.**  The prefix that deals a suffix to its group is the least (by hash) of the
  ``SEED``-word strings inside its window, in place of the first words: equal windows have
  equal prefixes, and neighbouring suffixes mostly share theirs, so they travel as one
  passage (some 3.5 words a suffix, not ``window``).
* **Variable length.**  A census counts the suffixes of every prefix over all documents
  before any is sent.  A prefix with more than ``HOT`` suffixes is lengthened to the whole
  window, so its suffixes are dealt one by one.  The number of groups follows from the
  census, for ``GROUP`` / 2 suffixes a group on average.
* **Subtrees.**  A group's passages hold the words themselves.  Prefix doubling names the
  nodes of the group's subtree at depths 1, 2, 4, 8, ... and ``window``: a node of twice
  the depth is a pair of nodes.  Words are compared byte by byte, and names are exact, so
  no repeat rests on a hash.  Positions alone in their node are leaves and go no deeper.
* **Repeats.**  In a node at depth ``window`` with several leaves, all but the first leaf
  are repeats.  Overlapping ones unite to the document's maximal repeated passages, which
  are cut out.

Each task first builds the subtrees of its own documents, slice by slice.  A suffix that
comes later than an equal one of the same task is a repeat at once and is not sent, so a
passage held by a third of all documents is sent once a task and not once a document.
Within a slice that is decided on the words, between slices of a task on 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import settled
from lithos.llm.textops import SPACED, U, gram_hashes, hash_spans, mix, slices, text_bytes, within, word_spans

WINDOW = 20
SEED = 6
#: Most suffixes of a group, but for the luck of the draw; a group takes some 150 bytes a suffix.
GROUP = 500_000
#: A prefix with more suffixes is lengthened.
HOT = GROUP // 4
#: Most prefixes that are lengthened, the largest first (8 bytes each are broadcast).
HOT_MOST = 2_000_000
#: Bytes of text whose subtrees a task builds at a time.
SLICE = 3 << 20
#: Most suffixes a task remembers to recognise repeats of its own (24 bytes each).
SEEN = 6_000_000
_ZSTD = 3


def least(g: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of n values."""
    size, run = 1, g
    while 2 * size <= n:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    return np.minimum(run[: len(g) - n + 1], run[n - size : n - size + len(g) - n + 1])


def intervals(doc: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to) of the words covered by windows; overlapping windows unite. Sorts by doc, then position."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + window)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], pos[at], pos[last] + window


def _spaced(texts: pa.Array) -> pa.Array:
    """Each text with a space after it, so that every word has a byte of its own behind it."""
    return pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each followed by a space, and where each begins (len + 1)."""
    take = np.zeros(len(data) + 2, np.int8)  # +1 where a word begins, -1 after the byte that follows it
    take[start] += 1
    take[end + 1] -= 1
    to = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.append(data, np.uint8(0))[np.cumsum(take[:-1], dtype=np.int8).view(bool)]
    out[to[1:] - 1] = 0x20
    return out, to


def word_names(packed: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A number for each of the gathered words; equal numbers, equal bytes."""
    words = pa.Array.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def nodes(word: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``depth`` words occur at several positions, and the tree node there.

    word: names of the words; left: how many words of its passage are left from a position.
    By prefix doubling: rank holds the node of a position at depth ``have``, -1 for a leaf.
    """
    rank, have = word, 1
    at = np.arange(len(word))
    while len(at):
        count = np.bincount(rank[at]) if have == 1 else None
        if count is not None:
            at = at[count[rank[at]] > 1]
            rank = np.where(count[rank] > 1, rank, -1)
            if depth == 1:
                return at, rank[at]
        step = min(have, depth - have)
        at = at[left[at] >= have + step]
        at = at[rank[at + step] >= 0]
        if not len(at):
            break
        key = rank[at] * (int(rank.max()) + 1) + rank[at + step]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        several = ~(new[:-1] & new[1:])
        name = np.cumsum(new[:-1])[several]
        at = at[order[several]]
        have += step
        if have == depth:
            return at, name
        rank = np.full(len(word), -1, np.int64)
        rank[at] = name
        at = np.sort(at)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def repeats(node: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Indices of all leaves but the first of each node."""
    order = np.lexsort((pos, doc, node))
    k, d, q = node[order], doc[order], pos[order]
    lead = np.ones(len(k), bool)
    lead[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    return order[(d != d[first]) | (q != q[first])]


def _prefixes(h: np.ndarray, s: np.ndarray, window: int) -> np.ndarray:
    seed = min(SEED, window)
    return mix(least(gram_hashes(h, seed), window - seed + 1)[s])


def _census(window: int, slice_bytes: int):
    """How many suffixes each prefix has, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", slice_bytes):
            data, off = text_bytes(rows.column("text"))
            start, end, first = word_spans(data, off, SPACED)
            s = within(first, window)
            if len(s):
                a = np.sort(_prefixes(hash_spans(data, start, end), s, window))
                edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
                yield pa.RecordBatch.from_arrays([pa.array(a[edge[:-1]].view(np.int64)), pa.array(np.diff(edge))], names=["prefix", "n"])

    return run


def _put(doc: np.ndarray, pos: np.ndarray, count: np.ndarray, text: bytes) -> bytes:
    base = int(doc.min())
    delta = (doc - base).astype(np.uint64)
    wide, far, small = bool(delta.max() >> U(32)), bool(pos.max() >= 1 << 16), len(text) < 256
    head = np.array([len(doc), base, wide + 2 * far + 4 * small, len(text)], dtype="<i8").tobytes()
    body = text if small else pa.Codec("zstd", compression_level=_ZSTD).compress(text, asbytes=True)
    return b"".join([head, delta.astype("<u8" if wide else "<u4").tobytes(), pos.astype("<u4" if far else "<u2").tobytes(), count.tobytes(), body])


def _get(blob: bytes) -> tuple:
    runs, base, flags, size = np.frombuffer(blob, "<i8", 4).tolist()
    at, out = 32, []
    for kind in ("<u8" if flags & 1 else "<u4", "<u4" if flags & 2 else "<u2", "u1"):
        out.append(np.frombuffer(blob, kind, runs, at).astype(np.int64))
        at += runs * np.dtype(kind).itemsize
    text = blob[at:] if flags & 4 else pa.decompress(memoryview(blob)[at:], decompressed_size=size, codec="zstd", asbytes=True)
    return out[0] + base, out[1], out[2], text


class _Seen:
    """Windows of a task's earlier slices, sorted by path, in runs that are merged as they grow."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def later(self, path: np.ndarray, more: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the windows, sorted by path, a document of a smaller id had."""
        out = np.zeros(len(path), bool)
        for p, m, d in self.runs:
            at = np.minimum(np.searchsorted(p, path), len(p) - 1)
            out |= (p[at] == path) & (m[at] == more) & (d[at] < doc)
        return out

    def add(self, path: np.ndarray, more: np.ndarray, doc: np.ndarray) -> None:
        if sum(len(p) for p, *_ in self.runs) > SEEN:
            self.runs = []
        run = (path, more, doc)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):
            run = tuple(np.concatenate(x) for x in zip(run, self.runs.pop(), strict=True))  # of equal paths the newer has the smaller id
            order = np.argsort(run[0], kind="stable")
            run = tuple(x[order] for x in run)
        if len(run[0]):
            self.runs.append(run)


def _suffixes(window: int, buckets: int, slice_bytes: int, hot):
    """Documents to (bucket, blob of passages) and, for repeats within the task, (doc, lo, hi)."""

    def batch(bucket=(), blob=(), doc=(), lo=(), hi=()) -> pa.RecordBatch:
        n, m = len(bucket), len(doc)
        cols = [
            pa.array([*bucket, *(np.asarray(doc, np.int64).view(np.uint64) % U(buckets)).tolist()] if m else list(bucket), pa.int64()),
            pa.array([*blob, *[None] * m], pa.binary()),
            *(pa.array(np.concatenate([np.zeros(n, np.int64), np.asarray(x, np.int64)]), pa.int64()) for x in (doc, lo, hi)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "blob", "doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, longer = _Seen(), hot.value
        for rows in slices(batches, "text", slice_bytes):
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            data, off = text_bytes(_spaced(rows.column("text").take(pa.array(order))))
            start, end, first = word_spans(data, off, SPACED)
            s = within(first, window)
            if not len(s):
                continue
            h = hash_spans(data, start, end)
            path, more = gram_hashes(h, window)[s], gram_hashes(mix(h ^ U(0xC2B2AE3D27D4EB4F)), window)[s]
            anchor = _prefixes(h, s, window)
            row = np.searchsorted(first, s, side="right") - 1
            doc, pos = ids[row], s - first[row]
            packed, to = gathered(data, start, end)
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(start))
            at, node = nodes(word_names(packed, to), left, window)
            at = np.searchsorted(s, at)
            repeat = np.zeros(len(s), bool)
            repeat[at[repeats(node, doc[at], pos[at])]] = True
            one = np.flatnonzero(~repeat)
            one = one[np.argsort(path[one])]
            repeat[one] = seen.later(path[one], more[one], doc[one])
            one = one[~repeat[one]]
            seen.add(path[one], more[one], doc[one])
            cut = intervals(doc[repeat], pos[repeat], window)

            keep = np.flatnonzero(~repeat)
            if len(keep):
                k, a = s[keep], anchor[keep]
                if len(longer):  # lengthened prefixes: the whole window
                    there = longer[np.minimum(np.searchsorted(longer, a), len(longer) - 1)] == a
                    a = np.where(there, mix(path[keep] ^ U(0x165667B19E3779F9)), a)
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1] + 1) | (a[1:] != a[:-1])
                head = np.flatnonzero(new)
                length = np.diff(np.append(head, len(k)))
                if length.max() > 255:  # one prefix over a long monotonous stretch
                    head = np.concatenate([np.arange(x, x + n, 255) for x, n in zip(head, length, strict=True)])
                    length = np.diff(np.append(head, len(k)))
                bucket = (a[head] >> U(32)) * U(buckets) >> U(32)
                by = np.argsort(bucket, kind="stable")
                bucket, head, c = bucket[by], head[by], length[by]
                d, q, c8 = doc[keep][head], pos[keep][head], c.astype("u1")
                lo, hi, text = to[k[head]].tolist(), to[k[head] + c + window - 1].tolist(), memoryview(packed)
                edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])).tolist()
                sent = [_put(d[x:y], q[x:y], c8[x:y], b"".join([text[i:j] for i, j in zip(lo[x:y], hi[x:y], strict=True)])) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield batch(bucket[edge[:-1]].astype(np.int64).tolist(), sent)
            if len(cut[0]):
                yield batch(doc=cut[0], lo=cut[1], hi=cut[2])

    return run


def _subtrees(window: int):
    def solve(blobs: list[bytes]) -> pa.RecordBatch:
        doc, pos, count, text = zip(*map(_get, blobs), strict=True)
        doc, pos, count = (np.concatenate(x) for x in (doc, pos, count))
        packed = np.frombuffer(b"".join(text), np.uint8)
        to = np.concatenate([[0], np.flatnonzero(packed == 0x20) + 1])
        size = count + window - 1
        ends = np.cumsum(size)
        run = np.repeat(np.arange(len(size)), size)
        at, node = nodes(word_names(packed, to), ends[run] - np.arange(len(run)), window)
        own = run[at]
        d, q = doc[own], pos[own] + at - (ends[own] - size[own])
        later = repeats(node, d, q)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in intervals(d[later], q[later], window)], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for b in batches:
            there = b.column("blob").is_valid()
            cut = b.filter(pc.invert(there)).select(["doc", "lo", "hi"])
            if cut.num_rows:
                yield cut
            for k, blob in zip(b.column("bucket").filter(there).to_pylist(), b.column("blob").filter(there).to_pylist(), strict=True):
                if k != bucket and held:
                    yield solve(held)
                    held = []
                bucket = k
                held.append(blob)
        if held:
            yield solve(held)

    return run


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", SLICE):
            data, off = text_bytes(_spaced(rows.column("text")))
            start, end, first = word_spans(data, off, SPACED)
            edge = np.zeros(len(start) + 1, np.int32)
            cuts = rows.column("cuts")
            lists = cuts.flatten()
            if len(lists):
                per = np.diff(np.frombuffer(cuts.buffers()[1], np.int32, len(cuts) + 1, 4 * cuts.offset)) if cuts.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in cuts])
                base = np.repeat(first[:-1], per)
                np.add.at(edge, base + lists.field("lo").to_numpy(), 1)
                np.add.at(edge, base + lists.field("hi").to_numpy(), -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) <= 0)
            out, to = gathered(data, start[kept], end[kept])
            at = np.searchsorted(kept, first)
            texts = [out[to[a] : to[b] - 1].tobytes() if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
            cols = [rows.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(first) - np.diff(at), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([t.decode() for t in texts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False, slice_bytes: int = SLICE, hot: int = HOT) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a window over it has an equal one that starts earlier (smaller integer
    id, or earlier in the same document).  Null and empty texts have no words.  Ids are
    expected to be unique: rows that repeat an id and text tie, so neither is removed for
    the other.  Rows with a null id keep all their words and count for no other row.  A
    text of any length is one unit of a task's memory (some 60 bytes a word).  Columns but
    the two named are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.filter(F.col("id").isNotNull())
    counted = lambda: named.select("text").mapInArrow(_census(window, slice_bytes), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    # One row for all prefixes of common size, and one for each of the hot ones.
    census = settled(counted().groupBy(F.when(F.col("n") > hot, F.col("prefix")).alias("prefix")).agg(F.sum("n").alias("n")))
    total = census.agg(F.sum("n")).first()[0] or 0
    found = census.filter("prefix is not null").orderBy(F.desc("n"), "prefix").limit(HOT_MOST).select("prefix").toArrow()
    longer = spark.sparkContext.broadcast(np.sort(np.array(found.column("prefix").to_pylist(), np.int64).view(np.uint64)))
    buckets = max(parts, -(-2 * total // GROUP))
    sent = named.mapInArrow(_suffixes(window, buckets, slice_bytes, longer), "bucket bigint, blob binary, doc bigint, lo bigint, hi bigint")
    grouped = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    cuts = grouped.mapInArrow(_subtrees(window), "doc bigint, lo bigint, hi bigint").groupBy(F.col("doc").alias("id"))
    cuts = settled(cuts.agg(F.collect_list(F.struct("lo", "hi")).alias("cuts")))  # the passages' shuffle ends before the texts' begins
    joined = rows.join(cuts.hint("shuffle_hash"), "id", "left").select("id", "text", F.coalesce("cuts", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("cuts"))
    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.mapInArrow(_cut(keep_text), schema).withColumnRenamed("id", id_col)
