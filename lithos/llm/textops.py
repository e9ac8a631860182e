"""Vectorised text primitives shared by the Arrow-based operators.

Everything works on one flat UTF-8 buffer per slice of documents.  Word boundaries
and hashes come from numpy passes over that buffer, so no Python loop runs per word.
Slices hold whole documents and about ``SLICE_BYTES`` of text, which bounds the
memory of a worker by the longest single document rather than by the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_LONG_SPAN = 4096

U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)

#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Letters and digits after lower-casing, and every byte beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len+1 offsets of its rows; null is empty."""
    arr = column if column.null_count == 0 else column.fill_null("")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1, offset=8 * arr.offset) if len(arr) else np.zeros(1, np.int64)
    buf = arr.buffers()[2] if len(arr) else None
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document (and one past it) its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = kind[data]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    cut = off[:-1][(off[:-1] > 0) & (off[:-1] < len(data))]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(start, off)


#: Bytes beyond which one text is worked on in pieces.
LONG = 1 << 20


def pieces(data: np.ndarray, kind: np.ndarray, overlap: int, most: int = LONG) -> Iterator[tuple[np.ndarray, int]]:
    """A text in pieces of about ``most`` bytes that part no word; each begins with up to
    ``overlap`` words of the one before, whose number comes along."""
    lo = at = skip = 0
    while True:
        to = min(len(data), at + most)
        while to < len(data) and kind[data[to]]:
            gap = np.flatnonzero(~kind[data[to : to + most]])
            to = min(len(data), to + (int(gap[0]) if len(gap) else most))
        yield data[lo:to], skip
        if to == len(data):
            return
        start, _, _ = word_spans(data[lo:to], np.array([0, to - lo]), kind)
        skip = min(overlap, len(start))
        lo, at = (lo + int(start[-skip]) if skip else to), to


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=pad, strides=(1,))
    length = end - start
    h = mix(U(seed) ^ (length.astype(np.uint64) * _GOLD))
    h = mix(h ^ (view[start] & _MASKS[np.minimum(length, 8)]))
    at, left = 8, np.flatnonzero(length > 8)
    while len(left):
        if at >= _LONG_SPAN:
            for i in left:
                raw = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
                h[i] = int.from_bytes(raw, "little")
            break
        h[left] = mix(h[left] * _GOLD ^ (view[start[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]))
        at += 8
        left = left[length[left] > at]
    return h


_BASE = 0xD6E8FEB86659FD93


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive hashes (len - n + 1 of them), by doubling."""
    out, have, run, size = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = run, size
            else:
                m = len(h) - (have + size) + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] * U(pow(_BASE, size, 2**64)) + run[have : have + m]
                have += size
        left >>= 1
        if left:
            m = len(h) - 2 * size + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            run = run[:m] * U(pow(_BASE, size, 2**64)) + run[size : size + m]
            size *= 2
    return mix(out)


def per_document(first: np.ndarray) -> np.ndarray:
    """The document of each word, from word_spans' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of words from which n words of one document follow."""
    doc = per_document(first)
    if len(doc) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per-document sums of a per-word array."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
