"""Metadata of Type 1 assets (PFB and PFA): names from the clear part, glyphs from the encrypted one.

Outlines are not converted: the catalogue needs names, glyph count and coverage alone.
"""

from __future__ import annotations

import re
import struct
import unicodedata

from lithos.sources.binary import Corrupt

_FIELD = rb"/%s\s*\(((?:[^()\\]|\\.)*)\)"


def is_type1(data: bytes) -> bool:
    return data[:1] == b"\x80" or data[:2] == b"%!"


def parts(data: bytes) -> tuple[bytes, bytes]:
    """The clear and the encrypted part."""
    if data[0] == 0x80:
        clear, hidden, at = b"", b"", 0
        while at + 6 <= len(data) and data[at] == 0x80 and data[at + 1] != 3:
            size = struct.unpack_from("<I", data, at + 2)[0]
            body = data[at + 6 : at + 6 + size]
            if data[at + 1] != 1:
                hidden += body
            elif not hidden:
                clear += body
            at += 6 + size
        return clear, hidden
    clear, mark, rest = data.partition(b"eexec")
    if not mark:
        raise Corrupt("no eexec section")
    rest = rest.lstrip(b"\r\n \t")
    if re.match(rb"[0-9A-Fa-f]{4}", rest):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", rest)
        rest = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    return clear, rest


def decrypt(cipher: bytes, key: int = 55665, skip: int = 4) -> bytes:
    out = bytearray(len(cipher))
    for i, c in enumerate(cipher):
        out[i] = c ^ key >> 8
        key = ((c + key) * 52845 + 22719) & 0xFFFF
    return bytes(out[skip:])


# Glyph names that no rule gives.
_SIGNS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?",
    "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "\xa1", "cent": "\xa2", "sterling": "\xa3",
    "fraction": "⁄", "yen": "\xa5", "florin": "ƒ", "section": "\xa7", "currency": "\xa4", "quotedblleft": "“",
    "quotedblright": "”", "quotedblbase": "„", "quotesinglbase": "‚", "guillemotleft": "\xab", "guillemotright": "\xbb",
    "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "emdash": "—",
    "dagger": "†", "daggerdbl": "‡", "periodcentered": "\xb7", "paragraph": "\xb6", "bullet": "•", "ellipsis": "…",
    "perthousand": "‰", "questiondown": "\xbf", "acute": "\xb4", "circumflex": "ˆ", "tilde": "˜", "macron": "\xaf",
    "breve": "˘", "dotaccent": "˙", "dieresis": "\xa8", "ring": "˚", "cedilla": "\xb8", "hungarumlaut": "˝",
    "ogonek": "˛", "caron": "ˇ", "degree": "\xb0", "plusminus": "\xb1", "multiply": "\xd7", "divide": "\xf7", "minus": "−",
    "mu": "\xb5", "brokenbar": "\xa6", "logicalnot": "\xac", "registered": "\xae", "copyright": "\xa9", "trademark": "™",
    "Euro": "€", "euro": "€", "onequarter": "\xbc", "onehalf": "\xbd", "threequarters": "\xbe", "onesuperior": "\xb9",
    "twosuperior": "\xb2", "threesuperior": "\xb3", "ordfeminine": "\xaa", "ordmasculine": "\xba", "AE": "\xc6", "ae": "\xe6",
    "OE": "Œ", "oe": "œ", "Oslash": "\xd8", "oslash": "\xf8", "Lslash": "Ł", "lslash": "ł", "germandbls": "\xdf",
    "dotlessi": "ı", "Thorn": "\xde", "thorn": "\xfe", "Eth": "\xd0", "eth": "\xf0",
}
_MARKS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA"}


def glyph_codepoint(name: str) -> int:
    """The code point of a glyph name, by list or by rule, else -1."""
    stem = name.partition(".")[0] or name
    if len(stem) == 1 and stem.isascii() and stem.isalpha():
        return ord(stem)
    if stem in _SIGNS:
        return ord(_SIGNS[stem])
    letter, mark = stem[:1], _MARKS.get(stem[1:])
    try:
        if mark and letter.isascii() and letter.isalpha():
            cp = ord(unicodedata.lookup(f"LATIN {'CAPITAL' if letter.isupper() else 'SMALL'} LETTER {letter.upper()} WITH {mark}"))
            return cp if cp < 0x100 else -1
        if stem in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"):
            return ord(unicodedata.lookup(f"DIGIT {stem.upper()}"))
    except KeyError:
        return -1
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", stem):
        return int(m[1] or m[2], 16)
    return -1


def type1_record(data: bytes) -> dict:
    clear, hidden = parts(data)

    def field(name: bytes, pattern: bytes = _FIELD) -> str:
        m = re.search(pattern % name, clear, re.S)
        return m[1].decode("latin-1").replace("\0", "").strip() if m else ""

    ps_name = field(b"FontName", rb"/%s\s*/(\S+)")
    family = field(b"FamilyName") or ps_name
    if not family:
        raise Corrupt("no display name")
    weight = field(b"Weight").lower()
    slanted = float(field(b"ItalicAngle", rb"/%s\s+(-?[0-9.]+)") or 0) != 0
    style = " ".join(w for w, on in (("Bold", any(x in weight for x in ("bold", "black", "heavy"))), ("Italic", slanted)) if on) or "Regular"
    private = decrypt(hidden)
    glyphs = re.findall(rb"/(\S+)\s+\d+\s+(?:RD|-\||\S+)\s", private.partition(b"/CharStrings")[2])
    names = dict.fromkeys(g.decode("latin-1") for g in glyphs)
    from lithos.sources.metadata import licence_of, united

    points = sorted({cp for cp in map(glyph_codepoint, names) if cp >= 0})
    version = re.search(r"\d+(?:\.\d+)?", field(b"version"))
    full = field(b"FullName") or f"{family} {style}"
    version_text = version[0] if version else "001.000"
    return {
        "display_name": family, "family": family, "typo_family": "", "style": style, "typo_subfamily": "", "full_name": full,
        "ps_name": ps_name, "version": version_text, "glyph_count": max(1, len(names)), "outline": "Cff", "is_variable": False,
        "metadata_score": sum(map(bool, (family, style, full, ps_name, version_text))) + 1,
        "license": licence_of([field(b"Notice")], 0), "coverage": united([(p, p) for p in points]), "axes": [], "features": [],
    }
