"""Containers around an asset's tables: plain, zlib-wrapped, Brotli-wrapped, embedded, LZSS."""

from __future__ import annotations

import struct
import zlib

#: Signatures.
OUTLINES = {0x00010000: "TrueType", 0x74727565: "TrueType", 0x4F54544F: "Cff"}
COLLECTION = 0x74746366
SZDD = bytes.fromhex("535A444488F02733")
#: Tables that metadata comes from; wrapped containers unpack no others.
WANTED = {b"head", b"name", b"OS/2", b"maxp", b"cmap", b"fvar", b"GSUB", b"GPOS"}
_MOST = 256 << 20


class Corrupt(ValueError):
    """Input that is rejected, with the reason."""


def u16(b, at: int) -> int:
    return struct.unpack_from(">H", b, at)[0]


def u32(b, at: int) -> int:
    return struct.unpack_from(">I", b, at)[0]


def plain_tables(data: bytes) -> tuple[str, dict[bytes, bytes]]:
    """Outline kind and tables of an sfnt; a table out of bounds is left out, the rest may do."""
    if len(data) < 12:
        raise Corrupt("too short for a table directory")
    kind = _outline(u32(data, 0))
    n = u16(data, 4)
    if len(data) < 12 + 16 * n:
        raise Corrupt("table directory cut off")
    rows = struct.iter_unpack(">4sIII", data[12 : 12 + 16 * n])
    return kind, {tag: data[at : at + size] for tag, _, at, size in rows if at + size <= len(data)}


def _outline(version: int) -> str:
    if version == COLLECTION:
        raise Corrupt("collections are not supported")
    if version not in OUTLINES:
        raise Corrupt(f"unknown signature {version:08X}")
    return OUTLINES[version]


def woff_tables(data: bytes) -> tuple[str, dict[bytes, bytes]]:
    if len(data) < 44 or data[:4] != b"wOFF":
        raise Corrupt("no WOFF signature")
    n = u16(data, 12)
    if len(data) < 44 + 20 * n:
        raise Corrupt("WOFF directory cut off")
    tables = {}
    for tag, at, packed, size, _ in struct.iter_unpack(">4sIIII", data[44 : 44 + 20 * n]):
        if at + packed > len(data) or size > _MOST:
            raise Corrupt(f"WOFF table out of bounds: {tag!r}")
        if tag in WANTED:
            raw = data[at : at + packed]
            tables[tag] = raw if packed == size else _inflate(raw, size)
    return _outline(u32(data, 4)), tables


def _inflate(raw: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(raw, size)  # bounded by the declared size
    except zlib.error as e:
        raise Corrupt(f"zlib: {e}") from e
    if len(out) != size:
        raise Corrupt("WOFF table shorter than declared")
    return out


# The numbered tags of a WOFF2 directory.
WOFF2_TAGS = (
    "cmap head hhea hmtx maxp name OS/2 post cvt  fpgm glyf loca prep CFF  VORG EBDT "
    "EBLC gasp hdmx kern LTSH PCLT VDMX vhea vmtx BASE GDEF GPOS GSUB EBSC JSTF MATH "
    "CBDT CBLC COLR CPAL SVG  sbix acnt avar bdat bloc bsln cvar fdsc feat fmtx fvar "
    "gvar hsty just lcar mort morx opbd prop trak Zapf Silf Glat Gloc Feat Sill"
)


def _base128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(5):
        if at >= len(data):
            raise Corrupt("WOFF2 directory cut off")
        byte = data[at]
        at += 1
        if k == 0 and byte == 0x80:
            raise Corrupt("WOFF2 number with leading zeros")
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            if value >= 1 << 32:
                break
            return value, at
    raise Corrupt("WOFF2 number too long")


def woff2_tables(data: bytes) -> tuple[str, dict[bytes, bytes]]:
    """Needs a Brotli module; without one the file is rejected with that reason."""
    if len(data) < 48 or data[:4] != b"wOF2":
        raise Corrupt("no WOFF2 signature")
    kind = _outline(u32(data, 4))
    n, packed, at = u16(data, 12), u32(data, 20), 48
    rows = []
    for _ in range(n):
        if at >= len(data):
            raise Corrupt("WOFF2 directory cut off")
        flags = data[at]
        at += 1
        if flags & 63 == 63:
            tag = bytes(data[at : at + 4])
            at += 4
        else:
            tag = WOFF2_TAGS[5 * (flags & 63) :][:4].encode()
        size, at = _base128(data, at)
        changed = (flags >> 6 == 0) if tag in (b"glyf", b"loca") else (flags >> 6 != 0)
        if changed:
            size, at = _base128(data, at)
        if size > 2 * _MOST:
            raise Corrupt("WOFF2 table too large")
        rows.append((tag, size, changed))
    if at + packed > len(data):
        raise Corrupt("WOFF2 stream cut off")
    try:
        import brotli
    except ImportError as e:
        raise Corrupt("no Brotli module installed") from e
    try:
        stream = brotli.decompress(bytes(data[at : at + packed]))
    except brotli.error as e:
        raise Corrupt(f"brotli: {e}") from e
    tables, at = {}, 0
    for tag, size, changed in rows:
        if tag in WANTED:
            if changed:
                raise Corrupt(f"transformed metadata table {tag!r}")
            tables[tag] = stream[at : at + size]
        at += size
    if at > len(stream):
        raise Corrupt("WOFF2 stream shorter than declared")
    return kind, tables


def embedded(data: bytes) -> bytes:
    """The sfnt at the end of an EOT file; one compressed by the system's own coder is rejected."""
    if len(data) < 40:
        raise Corrupt("EOT header cut off")
    size, flags, magic = struct.unpack_from("<I", data, 4)[0], struct.unpack_from("<I", data, 12)[0], struct.unpack_from("<H", data, 34)[0]
    if magic != 0x504C:
        raise Corrupt("no EOT magic number")
    if not 0 < size <= len(data):
        raise Corrupt("EOT data size out of bounds")
    body = data[-size:]
    if flags & 0x10000000:
        body = bytes(body).translate(bytes(x ^ 0x50 for x in range(256)))
    if flags & 4:
        raise Corrupt("EOT compression needs an operating-system library")
    return body


def expand_szdd(data: bytes) -> bytes:
    """LZSS over a ring of 4096 spaces; a stream that ends early is rejected."""
    if len(data) < 14 or data[:8] != SZDD:
        raise Corrupt("no SZDD signature")
    if data[8] != 0x41:
        raise Corrupt("unknown SZDD mode")
    size = struct.unpack_from("<I", data, 10)[0]
    # The ring is the output itself, seen through 4096 bytes of spaces before it.
    out = bytearray(b" " * 4096)
    whole, at = 4096 + size, 14
    while at < len(data) and len(out) < whole:
        flags, at = data[at] | 0x100, at + 1
        while flags > 1 and len(out) < whole and at < len(data):
            if flags & 1:
                out.append(data[at])
                at += 1
            else:
                if at + 1 >= len(data):
                    at = len(data)
                    break
                ring, more = data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 15) + 3
                at += 2
                # Output byte k lies at ring position (k - 16) mod 4096, k counted from the spaces' end.
                back = (len(out) - 16 - ring) % 4096 or 4096
                for _ in range(min(more, whole - len(out))):
                    out.append(out[-back])
            flags >>= 1
    if len(out) != whole:
        raise Corrupt(f"SZDD stream cut off at {len(out) - 4096} of {size} bytes")
    return bytes(out[4096:])
