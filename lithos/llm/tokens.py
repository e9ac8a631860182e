"""Token ids of the public byte-level BPE, identical to the ``tokenizers`` file's.

The vocabulary's pattern cuts a text into pieces, and a piece's ids depend on it alone.
Pieces recur, so a slice of texts is cut by a few numpy passes over its bytes, each of its
distinct pieces is encoded once (through tiktoken, from the rank file of the same
vocabulary), and ids are gathered.

The cut knows ASCII and the Latin letters U+00C0 to U+024F, where the Unicode tables of all
libraries agree.  Texts with other characters or the opening of a special token go through
``tokenizers`` itself.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lithos.llm.textops import text_bytes

VOCABULARY = "byte_bpe_50k"
#: Bytes of text to encode at a time, for whoever calls; a slice takes some 60 times its size for a moment.
SLICE = 1 << 20

#: Kinds of bytes: white space, letter (in a known text all of beyond ASCII are), digit, other.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
#: Bytes of no known text: separators U+001C to U+001F and leading bytes of other characters.
_STRANGE = np.zeros(256, bool)
_STRANGE[0x1C:0x20] = _STRANGE[0xC0:0xC3] = _STRANGE[0xCA:] = True
_loaded: dict[tuple[str, str], object] = {}


def strange(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts the cut does not know."""
    bad = _STRANGE[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        bad[:-1] |= (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC9) & (b > 0x8F) | (a == 0x3C) & (b == 0x7C)
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[off[1:]] > total[off[:-1]]


def cut(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin: runs of letters, digits or others, each with one blank before it, if any;
    the endings 's 't 'm 'd 're 've 'll; white space, but for the last one before other text."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # texts
    same = np.zeros(len(data), bool)  # as the byte before, in one text
    same[1:] = (kind[1:] == kind[:-1]) & ~edge[1:-1]
    space = kind == _SPACE
    last = np.zeros(len(data), bool)  # the last white space before other text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    begin = ~same | last
    after = np.zeros(len(data), bool)  # follows the one blank that belongs to its piece
    after[1:] = last[:-1] & (data[:-1] == 0x20)
    begin &= ~after
    # An apostrophe that begins a piece takes its ending along.
    at = np.flatnonzero((data == 0x27) & begin)
    if len(at):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        stop = off[np.searchsorted(off, at, side="right")]
        one, two = pad[at + 1], pad[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < stop)
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & (at + 2 < stop)
        for found, size in ((at[short], 2), (at[long], 3)):
            begin[found + 1] = False
            inside = found + size < len(data)
            begin[found[inside] + size] = True
    return np.flatnonzero(begin)


class Encoder:
    """ids(texts) gives the ids of a column of texts, and where each text's begin (len + 1)."""

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None

    def slow(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def piece(self, raw: bytes) -> list[int]:
        try:
            return self.fast.encode_ordinary(raw.decode())
        except Exception:  # e.g. the pattern engine's stack on a very long run
            return self.slow(raw.decode()).tolist()

    def _cut(self, data: np.ndarray, off: np.ndarray):
        """The distinct pieces' ids and their number, each piece's place among them, and where the pieces begin."""
        begin = cut(data, off)
        to = np.append(begin, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        # A piece needs no pattern; where the library lacks the shorter way, the pattern leaves it whole.
        encode = getattr(getattr(self.fast, "_core_bpe", None), "encode_single_piece", self.piece)
        found = list(map(encode, pieces.dictionary.to_pylist()))
        return found, np.fromiter(map(len, found), np.int64, len(found)), pieces.indices.to_numpy(), begin

    def _cut_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        found, n, index, begin = self._cut(data, off)
        flat, start = np.fromiter(chain.from_iterable(found), "<u4", n.sum()), np.cumsum(n) - n
        n, start = n[index], start[index]
        total = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(start - total[:-1], n) + np.arange(total[-1])], total[np.searchsorted(begin, off)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_bytes(texts)
        odd = np.flatnonzero(strange(data, off))
        if not len(odd):
            return self._cut_ids(data, off)
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        flat, first = self._cut_ids(*text_bytes(pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)))
        out, at, n = [], 0, np.diff(first)
        for k in odd.tolist():
            own = self.slow(texts[k].as_py())
            out += [flat[at : first[k]], own]
            at, n[k] = first[k], len(own)
        return np.concatenate([*out, flat[at:]]), np.concatenate([[0], np.cumsum(n)])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        data, off = text_bytes(texts)
        if not len(data) or strange(data, off).any():
            return np.diff(self.ids(texts)[1])
        _, n, index, begin = self._cut(data, off)
        total = np.concatenate([[0], np.cumsum(n[index])])
        return np.diff(total[np.searchsorted(begin, off)])

    def encode(self, text: str) -> np.ndarray:
        return self.ids(pa.array([text], pa.string()))[0]


def encoder(ranks_path: str | None = None, json_path: str | None = None) -> Encoder:
    """One encoder for each Python worker; the paths default to the installed public files."""
    import public_tokenizers

    key = (ranks_path or public_tokenizers.path(f"{VOCABULARY}.tiktoken"), json_path or public_tokenizers.path(f"{VOCABULARY}.json"))
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]
