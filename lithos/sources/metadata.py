"""Metadata of an asset from its tables: names, coverage, axes, features, ligatures."""

from __future__ import annotations

import re
import struct

from lithos.functions.names import FREE_WORDING, PAID_WORDING
from lithos.sources.binary import SZDD, Corrupt, embedded, expand_szdd, plain_tables, u16, u32, woff2_tables, woff_tables
from lithos.sources.type1 import is_type1, type1_record

#: Name IDs and the field each fills.
NAME_FIELDS = {0: "copyright", 1: "family", 2: "style", 4: "full_name", 5: "version", 6: "ps_name", 13: "licence_text", 14: "licence_url", 16: "typo_family", 17: "typo_subfamily"}
LOOKUP_KINDS = ("?", "Single", "Multiple", "Alternate", "Ligature", "Context", "ChainContext", "Extension", "ReverseChain")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")


def tag_text(raw: bytes) -> str:
    return "".join(chr(b) for b in raw if 0x20 <= b < 0x7F).rstrip(" ")


def names_of(table: bytes, beyond: bytes = b"") -> dict[str, str]:
    """The preferred value of each known name ID."""
    if len(table) < 6:
        return {}
    strings = u16(table, 4)
    best: dict[int, tuple[int, str]] = {}
    for k in range(min(u16(table, 2), (len(table) - 6) // 12)):
        platform, _, language, name, size, at = struct.unpack_from(">6H", table, 6 + 12 * k)
        raw = table[strings + at : strings + at + size]
        rank = {3: 4 if language == 0x0409 else 3, 0: 2, 1: 1 if language == 0 else 0}.get(platform, 0)
        if name not in NAME_FIELDS or len(raw) < size or not rank or best.get(name, (0,))[0] >= rank:
            continue
        text = raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace").strip()
        if text:
            best[name] = (rank, text)
    return {NAME_FIELDS[k]: v for k, (_, v) in best.items()}


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _maps(cmap: bytes, exact: bool) -> list[int]:
    """Offsets of the usable subtables, the best first."""
    found = []
    for k in range(min(u16(cmap, 2), (len(cmap) - 4) // 8) if len(cmap) >= 4 else 0):
        platform, encoding, at = struct.unpack_from(">HHI", cmap, 4 + 8 * k)
        if at + 4 > len(cmap):
            continue
        if (platform, encoding) == (3, 10):
            rank = 5
        elif platform == 0:
            rank = 4 if encoding in (4, 5, 6) else 2 if encoding == 3 or not exact else 1
        elif (platform, encoding) == (3, 1):
            rank = 3
        else:
            rank = 0 if exact else 1
        if rank:
            found.append((-rank, k, at))
    return [at for *_, at in sorted(found)]


def _segments(cmap: bytes, at: int):
    """(first, last, delta, range offset, its place) of a format-4 subtable; None if it does not fit."""
    n = u16(cmap, at + 6) // 2 if at + 14 <= len(cmap) else 0
    if not n or at + 16 + 8 * n > len(cmap) and at + 16 + 4 * n > len(cmap):
        return None
    whole = at + 16 + 8 * n <= len(cmap)
    column = lambda k, pad: struct.unpack_from(f">{n}H", cmap, at + 14 + 2 * n * k + pad)
    ends, starts = column(0, 0), column(1, 2)
    deltas, offsets = (column(2, 2), column(3, 2)) if whole else ((None,) * n, (None,) * n)
    places = range(at + 16 + 6 * n, at + 16 + 8 * n, 2)
    return list(zip(starts, ends, deltas, offsets, places, strict=True))


def coverage_of(cmap: bytes) -> list[tuple[int, int]]:
    """Covered code points.  Whole segments count, whether or not each point has a glyph."""
    for at in _maps(cmap, exact=True):
        kind = u16(cmap, at)
        if kind == 12 and at + 16 <= len(cmap):
            n = u32(cmap, at + 12)
            if at + 16 + 12 * n <= len(cmap):
                rows = struct.iter_unpack(">III", cmap[at + 16 : at + 16 + 12 * n])
                return united([(a, min(b, 0x10FFFF)) for a, b, _ in rows if a <= b and a <= 0x10FFFF])
        elif kind == 4 and (rows := _segments(cmap, at)) is not None:
            return united([(a, b) for a, b, *_ in rows if a <= b and not a == b == 0xFFFF])
    return []


def glyph_points(cmap: bytes) -> dict[int, int]:
    """Glyph to the first code point that maps to it."""
    out: dict[int, int] = {}
    at = next(iter(_maps(cmap, exact=False)), None)
    if at is None:
        return out
    kind = u16(cmap, at)
    if kind == 12 and at + 16 <= len(cmap):
        n = min(u32(cmap, at + 12), (len(cmap) - at - 16) // 12)
        for first, last, glyph in struct.iter_unpack(">III", cmap[at + 16 : at + 16 + 12 * n]):
            for cp in range(first, min(last, 0x10FFFF) + 1):
                out.setdefault((glyph + cp - first) & 0xFFFF, cp)
    elif kind == 4:
        for first, last, delta, offset, place in _segments(cmap, at) or []:
            if first == 0xFFFF or delta is None:
                continue
            for cp in range(first, last + 1):
                if not offset:
                    glyph = (cp + delta) & 0xFFFF
                else:
                    there = place + offset + 2 * (cp - first)
                    glyph = u16(cmap, there) if there + 2 <= len(cmap) else 0
                    glyph = (glyph + delta) & 0xFFFF if glyph else 0
                if glyph:
                    out.setdefault(glyph, cp)
    return out


def axes_of(fvar: bytes) -> list[tuple[str, float, float, float]]:
    if len(fvar) < 16:
        return []
    at, _, n, size = struct.unpack_from(">4H", fvar, 4)
    rows = [at + k * size for k in range(n)] if size >= 20 else []
    return [(tag_text(fvar[r : r + 4]), *(x / 65536 for x in struct.unpack_from(">3i", fvar, r + 4))) for r in rows if r + 20 <= len(fvar)]


def feature_tags(layout: bytes) -> list[str]:
    """Tags of a GSUB or GPOS feature list, in order, with repeats."""
    at = u16(layout, 6) if len(layout) >= 8 else 0
    if not at or at + 2 > len(layout):
        return []
    n = min(u16(layout, at), (len(layout) - at - 2) // 6)
    return [t for t in (tag_text(layout[at + 2 + 6 * k : at + 6 + 6 * k]) for k in range(n)) if t]


def licence_of(texts: list[str], fs_type: int) -> str:
    text = " ".join(texts).lower()
    if any(w in text for w in FREE_WORDING):
        return "Free"
    return "Paid" if fs_type & 2 or any(w in text for w in PAID_WORDING) else "Unknown"


def record_of(kind: str, tables: dict[bytes, bytes]) -> dict:
    """The typed metadata of one asset."""
    maxp = tables.get(b"maxp", b"")
    if len(maxp) < 6:
        raise Corrupt("no usable maxp table")
    got = names_of(tables.get(b"name", b""))
    number = _NUMBER.search(got.get("version", ""))
    version = number[0] if number else ""
    if not version and len(head := tables.get(b"head", b"")) >= 8:
        version = f"{u32(head, 4) / 65536:.3f}".rstrip("0").rstrip(".")
    display = got.get("typo_family") or got.get("family") or got.get("ps_name")
    if not display:
        raise Corrupt("no display name")
    style = got.get("style") or "Regular"
    os2 = tables.get(b"OS/2")
    scored = [got.get("family"), got.get("typo_family"), style, got.get("typo_subfamily"), got.get("full_name"), got.get("ps_name"), version]
    features = feature_tags(tables.get(b"GSUB", b"")) + feature_tags(tables.get(b"GPOS", b""))
    return {
        "display_name": display, "family": got.get("family", ""), "typo_family": got.get("typo_family", ""), "style": style,
        "typo_subfamily": got.get("typo_subfamily", ""), "full_name": got.get("full_name", ""), "ps_name": got.get("ps_name", ""),
        "version": version, "glyph_count": u16(maxp, 4), "outline": kind, "is_variable": b"fvar" in tables,
        "metadata_score": sum(map(bool, scored)) + (os2 is not None),
        "license": licence_of([got.get(k, "") for k in ("copyright", "licence_text", "licence_url")], u16(os2, 8) if os2 and len(os2) >= 10 else 0),
        "coverage": coverage_of(tables.get(b"cmap", b"")), "axes": axes_of(tables.get(b"fvar", b"")), "features": list(dict.fromkeys(features)),
    }


def tables_of(data: bytes, ext: str) -> tuple[str, dict[bytes, bytes]]:
    if ext == "woff":
        return woff_tables(data)
    if ext == "woff2":
        return woff2_tables(data)
    return plain_tables(embedded(data) if ext == "eot" else data)


def decode(data: bytes, ext: str) -> tuple[str, dict]:
    """(container, metadata) of one file; LZSS and Type 1 are recognised by their signatures."""
    if data[:8] == SZDD:
        data = expand_szdd(data)
    if is_type1(data):
        return "otf", type1_record(data)
    return ext, record_of(*tables_of(data, ext))


def _lookups(gsub: bytes) -> list[tuple[int, list[int]]]:
    at = u16(gsub, 8)
    out = []
    for k in range(u16(gsub, at)):
        if at + 4 + 2 * k > len(gsub):
            break
        one = at + u16(gsub, at + 2 + 2 * k)
        if one + 6 > len(gsub):
            out.append((0, []))
            continue
        kind, n = u16(gsub, one), u16(gsub, one + 4)
        real, subs = kind, []
        for s in range(min(n, (len(gsub) - one - 6) // 2)):
            sub = one + u16(gsub, one + 6 + 2 * s)
            if kind == 7 and sub + 8 <= len(gsub):
                real, sub = u16(gsub, sub + 2), sub + u32(gsub, sub + 4)
            if sub < len(gsub):
                subs.append(sub)
        out.append((real, subs))
    return out


def _covered_glyphs(gsub: bytes, at: int) -> list[int]:
    if at + 4 > len(gsub):
        return []
    kind, n = u16(gsub, at), u16(gsub, at + 2)
    if kind == 1:
        return [u16(gsub, p) for p in range(at + 4, min(at + 4 + 2 * n, len(gsub) - 1), 2)]
    rows = [struct.unpack_from(">HH", gsub, p) for p in range(at + 4, min(at + 4 + 6 * n, len(gsub) - 5), 6)] if kind == 2 else []
    return [g for a, b in rows for g in range(a, b + 1)]


def ligature_rows(data: bytes, ext: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, tuple[int, ...]]], dict[int, int]]:
    """(tag, lookup, kind) rows, (tag, ligature glyph, component glyphs) rows, and glyph to code point.

    The relational operators make the report of these: distinct ligatures, counts per
    feature, labels of the components.
    """
    _, tables = tables_of(data, ext)
    gsub = tables.get(b"GSUB", b"")
    if len(gsub) < 10 or not u16(gsub, 6) or not u16(gsub, 8):
        return [], [], {}
    lookups, at = _lookups(gsub), u16(gsub, 6)
    used, ligatures = [], []
    for k in range(u16(gsub, at)):
        row = at + 2 + 6 * k
        if row + 6 > len(gsub):
            break
        tag, feature = tag_text(gsub[row : row + 4]), at + u16(gsub, row + 4)
        if feature + 4 > len(gsub):
            continue
        for i in range(min(u16(gsub, feature + 2), (len(gsub) - feature - 4) // 2)):
            number = u16(gsub, feature + 4 + 2 * i)
            if number >= len(lookups):
                continue
            kind, subs = lookups[number]
            used.append((tag, number, kind))
            for sub in subs if kind == 4 else ():
                if sub + 6 <= len(gsub) and u16(gsub, sub) == 1:
                    ligatures += [(tag, *x) for x in _ligature_set(gsub, sub)]
    return used, ligatures, glyph_points(tables.get(b"cmap", b""))


def _ligature_set(gsub: bytes, sub: int):
    first = _covered_glyphs(gsub, sub + u16(gsub, sub + 2))
    for i in range(min(u16(gsub, sub + 4), len(first), (len(gsub) - sub - 6) // 2)):
        group = sub + u16(gsub, sub + 6 + 2 * i)
        for j in range(min(u16(gsub, group), (len(gsub) - group - 2) // 2) if group + 2 <= len(gsub) else 0):
            one = group + u16(gsub, group + 2 + 2 * j)
            if one + 4 > len(gsub):
                continue
            glyph, n = struct.unpack_from(">HH", gsub, one)
            if 1 <= n <= 16 and one + 2 + 2 * n <= len(gsub):
                yield glyph, (first[i], *struct.unpack_from(f">{n - 1}H", gsub, one + 4))
