"""Minimal assets of every kind, written from their parts: for the decoder queries and the tests."""

import io
import struct
import zipfile
import zlib


def name_table(records):
    """records: (platform, encoding, language, name id, text)."""
    body, rows = b"", b""
    for platform, encoding, language, number, text in records:
        raw = text.encode("utf-16-be" if platform in (0, 3) else "latin-1")
        rows += struct.pack(">6H", platform, encoding, language, number, len(raw), len(body))
        body += raw
    return struct.pack(">3H", 0, len(records), 6 + len(rows)) + rows + body


def cmap4(segments):
    """segments: (first, last, delta); the closing one is added."""
    rows = [*segments, (0xFFFF, 0xFFFF, 1)]
    n = len(rows)
    put = lambda values: struct.pack(f">{n}H", *(v & 0xFFFF for v in values))
    return struct.pack(">7H", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + put(r[1] for r in rows) + b"\0\0" + put(r[0] for r in rows) + put(r[2] for r in rows) + put([0] * n)


def cmap12(groups):
    return struct.pack(">HHIII", 12, 0, 16 + 12 * len(groups), 0, len(groups)) + b"".join(struct.pack(">III", *g) for g in groups)


def cmap_table(subs):
    """subs: (platform, encoding, bytes)."""
    at, head, body = 4 + 8 * len(subs), b"", b""
    for platform, encoding, raw in subs:
        head += struct.pack(">HHI", platform, encoding, at + len(body))
        body += raw
    return struct.pack(">HH", 0, len(subs)) + head + body


def gsub_table(features, lookups):
    """features: (tag, lookup numbers); lookups: (kind, subtable bytes)."""
    rows, bodies, at = b"", b"", 2 + 6 * len(features)
    for tag, numbers in features:
        rows += tag.encode() + struct.pack(">H", at + len(bodies))
        bodies += struct.pack(f">HH{len(numbers)}H", 0, len(numbers), *numbers)
    fl = struct.pack(">H", len(features)) + rows + bodies
    heads, bodies, at = b"", b"", 2 + 2 * len(lookups)
    for kind, sub in lookups:
        heads += struct.pack(">H", at + len(bodies))
        bodies += struct.pack(">4H", kind, 0, 1, 8) + sub
    ll = struct.pack(">H", len(lookups)) + heads + bodies
    return struct.pack(">HHHHH", 1, 0, 0, 10, 10 + len(fl)) + fl + ll


def ligature_sub(first, ligatures):
    """One first glyph; ligatures: (glyph, other components)."""
    rows, at = b"", 2 + 2 * len(ligatures)
    heads = b""
    for glyph, rest in ligatures:
        heads += struct.pack(">H", at + len(rows))
        rows += struct.pack(f">HH{len(rest)}H", glyph, len(rest) + 1, *rest)
    group = struct.pack(">H", len(ligatures)) + heads + rows
    cover = struct.pack(">HHH", 1, 1, first)
    return struct.pack(">HHHH", 1, 8 + len(group), 1, 8) + group + cover


def extension(kind, sub):
    return struct.pack(">HHI", 1, kind, 8) + sub


NAMES = [(3, 1, 0x409, 1, "Demo Sans"), (3, 1, 0x409, 2, "Bold"), (3, 1, 0x409, 5, "Version 2.10")]


def tables(names=None, glyphs=7, **more):
    out = {
        b"maxp": struct.pack(">IH", 0x00010000, glyphs),
        b"name": name_table(NAMES if names is None else names),
        b"cmap": cmap_table([(3, 1, cmap4([(65, 70, 0), (71, 75, 0), (97, 99, 0)]))]),
    }
    return out | {k.encode().ljust(4): v for k, v in more.items()}


def sfnt(t=None, version=0x00010000):
    t = tables() if t is None else t
    at, head, body = 12 + 16 * len(t), b"", b""
    for tag, raw in sorted(t.items()):
        head += tag + struct.pack(">III", 0, at + len(body), len(raw))
        body += raw
    return struct.pack(">IHHHH", version, len(t), 0, 0, 0) + head + body


def woff(t=None, packed=True):
    t = tables() if t is None else t
    at, head, body = 44 + 20 * len(t), b"", b""
    for tag, raw in sorted(t.items()):
        z = zlib.compress(raw) if packed else raw
        z = z if len(z) < len(raw) else raw
        head += tag + struct.pack(">IIII", at + len(body), len(z), len(raw), 0)
        body += z
    return b"wOFF" + struct.pack(">IIHH", 0x00010000, at + len(body), len(t), 0) + b"\0" * 28 + head + body


def eot(font, xor=False, flags=0):
    if xor:
        font, flags = bytes(b ^ 0x50 for b in font), flags | 0x10000000
    head = bytearray(100)
    struct.pack_into("<II", head, 0, 100 + len(font), len(font))
    struct.pack_into("<I", head, 12, flags)
    struct.pack_into("<H", head, 34, 0x504C)
    return bytes(head) + font


def szdd(raw):
    """Literals, and one back-reference where four bytes repeat the four before."""
    items, i = [], 0
    while i < len(raw):
        if i >= 4 and raw[i : i + 4] == raw[i - 4 : i] and i + 4 <= len(raw):
            at = (4096 - 16 + i - 4) % 4096
            items.append((0, bytes([at & 255, (at >> 8) << 4 | 1])))
            i += 4
        else:
            items.append((1, raw[i : i + 1]))
            i += 1
    out = b"SZDD\x88\xf0\x27\x33A\0" + struct.pack("<I", len(raw))
    for k in range(0, len(items), 8):
        part = items[k : k + 8]
        out += bytes([sum(bit << j for j, (bit, _) in enumerate(part))]) + b"".join(x for _, x in part)
    return out


def encrypt(plain, key=55665):
    out = bytearray()
    for p in b"\0\0\0\0" + plain:
        c = p ^ key >> 8
        out.append(c)
        key = ((c + key) * 52845 + 22719) & 0xFFFF
    return bytes(out)


def zipped(members):
    """members: (name, bytes)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in members:
            z.writestr(name, raw)
    return out.getvalue()


def type1(kind="pfb", family="Old"):
    clear = b"%!PS-AdobeFont-1.0: Old\n/FontName /Old-Bold def\n/FamilyName (" + family.encode() + b") readonly def\n/Weight (Bold) def /ItalicAngle -12.0 def /version (3.5) def\ncurrentfile eexec\n"
    private = b"/CharStrings 3 dict dup begin\n/.notdef 1 RD x ND\n/A 1 RD x ND\n/eacute 1 RD x ND\nend"
    hidden = encrypt(private)
    if kind == "pfb":
        seg = lambda t, b: b"\x80" + bytes([t]) + struct.pack("<I", len(b)) + b
        return seg(1, clear) + seg(2, hidden) + b"\x80\x03"
    return clear + hidden.hex().encode()
