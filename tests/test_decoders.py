import io
import struct
import zipfile

import pytest

from lithos.sources.binary import Corrupt, expand_szdd
from lithos.sources.files import entry_row, members
from lithos.sources.metadata import coverage_of, decode, glyph_points, ligature_rows, names_of, united
from lithos.sources.type1 import glyph_codepoint
from lithos.sources import samples as a


def test_plain_font():
    ext, r = decode(a.sfnt(), "ttf")
    assert ext == "ttf" and r["display_name"] == "Demo Sans" and r["style"] == "Bold" and r["version"] == "2.10"
    assert r["glyph_count"] == 7 and r["outline"] == "TrueType" and not r["is_variable"]
    assert r["coverage"] == [(65, 75), (97, 99)]  # adjacent segments unite
    assert r["metadata_score"] == 3
    assert decode(a.sfnt(version=0x4F54544F), "otf")[1]["outline"] == "Cff"


@pytest.mark.parametrize("wrapped,ext", [(a.woff(), "woff"), (a.woff(packed=False), "woff"), (a.eot(a.sfnt()), "eot"), (a.eot(a.sfnt(), xor=True), "eot"), (a.szdd(a.sfnt()), "ttf")])
def test_wrapped_fonts_give_the_same_record(wrapped, ext):
    assert decode(wrapped, ext)[1] == decode(a.sfnt(), "ttf")[1]


@pytest.mark.parametrize(
    "data,ext",
    [
        (a.sfnt(version=0x74746366), "ttf"),
        (b"\1\2\3\4" * 9, "ttf"),
        (a.sfnt({k: v for k, v in a.tables().items() if k != b"maxp"}), "ttf"),
        (a.sfnt(a.tables(names=[])), "ttf"),
        (a.eot(a.sfnt(), flags=4), "eot"),
        (a.szdd(a.sfnt())[:-9], "ttf"),
        (a.woff()[:60], "woff"),
        (b"wOF2" + b"\0" * 60, "woff2"),
    ],
)
def test_rejects(data, ext):
    row = entry_row("x", ext, data)
    assert row["status"] == "rejected" and row["error"]


def test_size_bounds_and_missing_content():
    assert entry_row("x", "ttf", b"12345678901")["error"] == "size out of bounds"
    assert entry_row("x", "ttf", None)["error"] == "no content"


def test_table_out_of_bounds_is_left_out():
    t = a.tables() | {b"fvar": b"\0" * 20}
    data = bytearray(a.sfnt(t))
    at = data.index(b"fvar")
    struct.pack_into(">I", data, at + 8, 1 << 30)
    assert not decode(bytes(data), "ttf")[1]["is_variable"]


def test_name_preference():
    n = names_of(a.name_table([(1, 0, 0, 1, "Mac"), (0, 3, 0, 1, "Uni"), (3, 1, 0x407, 1, "Deutsch"), (3, 1, 0x409, 1, "  "), (3, 1, 0x409, 2, "A"), (3, 1, 0x409, 2, "B")]))
    assert n["family"] == "Deutsch" and n["style"] == "A"


def test_cmap_12_is_preferred_and_reverse_map():
    c = a.cmap_table([(3, 1, a.cmap4([(65, 66, 0)])), (3, 10, a.cmap12([(65, 70, 1), (68, 80, 4), (0x1F600, 0x1F601, 30)]))])
    assert coverage_of(c) == [(65, 80), (0x1F600, 0x1F601)]
    assert glyph_points(c)[1] == 65 and glyph_points(c)[30] == 0x1F600


def test_united():
    assert united([(5, 6), (1, 4), (8, 8), (8, 8), (9, 20), (10, 12)]) == [(1, 6), (8, 20)]


def test_axes_and_features():
    fvar = struct.pack(">IHHHHHH", 0x00010000, 16, 2, 2, 20, 0, 0) + b"wght" + struct.pack(">3iHH", 100 << 16, 400 << 16, 900 << 16, 0, 0) + b"slnt" + struct.pack(">3iHH", -(12 << 16), 0, 0, 0, 0)
    g = a.gsub_table([("liga", [0]), ("kern", [0]), ("liga", [1])], [(4, a.ligature_sub(5, [(9, [6])])), (7, a.extension(4, a.ligature_sub(5, [(9, [6]), (10, [6, 7])])))])
    data = a.sfnt(a.tables(fvar=fvar, GSUB=g))
    r = decode(data, "ttf")[1]
    assert r["axes"] == [("wght", 100.0, 400.0, 900.0), ("slnt", -12.0, 0.0, 0.0)] and r["is_variable"]
    assert r["features"] == ["liga", "kern"]
    used, ligatures, points = ligature_rows(data, "ttf")
    assert used == [("liga", 0, 4), ("kern", 0, 4), ("liga", 1, 4)]
    assert ("liga", 10, (5, 6, 7)) in ligatures and points[65] == 65


def test_licences():
    def licence(text, fs_type=0):
        os2 = b"\0" * 8 + struct.pack(">H", fs_type)
        return decode(a.sfnt(a.tables(names=[*a.NAMES, (3, 1, 0x409, 13, text)], **{"OS/2": os2})), "ttf")[1]["license"]

    assert [licence("SIL Open Font License"), licence("", 2), licence("All Rights Reserved"), licence(""), licence("under the GPL", 2)] == ["Free", "Paid", "Paid", "Unknown", "Free"]


@pytest.mark.parametrize("kind", ["pfb", "pfa"])
def test_type1(kind):
    ext, r = decode(a.type1(kind), kind)
    assert ext == "otf" and r["display_name"] == "Old" and r["style"] == "Bold Italic" and r["version"] == "3.5"
    assert r["glyph_count"] == 3 and r["coverage"] == [(65, 65), (0xE9, 0xE9)]


def test_glyph_names():
    assert [glyph_codepoint(n) for n in ("A", "eacute", "uni20AC", "u1F600", "seven", "germandbls", "a.alt", "nonsense", "")] == [65, 0xE9, 0x20AC, 0x1F600, 0x37, 0xDF, 97, -1, -1]


def test_szdd_matches_lie_anywhere():
    raw = b"abcdabcdabcdabcd    xyz"
    assert expand_szdd(a.szdd(raw)) == raw
    with pytest.raises(Corrupt):
        expand_szdd(b"no")


def test_archive_members():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("a/demo.TTF", "readme.txt", "._x.ttf", "../evil.ttf"):
            z.writestr(name, a.sfnt())
    got = {p: e for p, _, _, e in members("z.zip", "zip", buf.getvalue())}
    assert got == {"z.zip!a/demo.TTF": None, "z.zip!../evil.ttf": "path leaves the archive"}
    assert [e for *_, e in members("z.7z", "7z", b"")] == ["no reader for .7z archives"]
    assert [e for *_, e in members("z.zip", "zip", b"junk")][0].startswith("archive")
