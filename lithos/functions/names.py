"""Scalar expressions over names, styles, versions, licences and paths.

All of them take and return Columns and stay inside generated code; only the sorting
letter needs Unicode decomposition, which Spark SQL lacks, and is an Arrow-batched UDF
that sees the one character it is about.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Wording that marks a free licence, and wording that marks a paid one.
FREE_WORDING = (
    "open font license", "openfontlicense", "ofl.txt", "scripts.sil.org/ofl",
    "apache license", "gnu general public", "gnu lesser general public", "gpl",
    "ubuntu font licence", "ubuntu font license", "creative commons", "cc0",
    "public domain", "mit license", "the unlicense", "wtfpl",
)
PAID_WORDING = (
    "all rights reserved", "may not be", "is not permitted", "without permission",
    "commercial", "purchase", "eula", "end user license", "end-user license",
    "license agreement", "licensed to", "proprietary", "unauthorized", "unauthorised",
    "is prohibited",
)
# Containers from the most to the least preferred.
PRIORITY = {"otf": 5, "ttf": 4, "woff2": 3, "woff": 2, "eot": 1}
LIGATURE_FEATURES = ("liga", "dlig", "rlig", "clig", "hlig")


def normal_name(c: Column) -> Column:
    """Lower case, runs of spaces collapsed, edges of each part trimmed."""
    parts = F.transform(F.split(F.lower(c), " "), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " ")


def effective_style(subfamily: Column, style: Column) -> Column:
    return F.when(F.length(subfamily) > 0, subfamily).otherwise(style)


def style_or_regular(style: Column) -> Column:
    return F.when(F.length(style) > 0, style).otherwise(F.lit("Regular"))


def display_name(typographic: Column, family: Column, postscript: Column) -> Column:
    """The first non-empty of the three; null (a reject) when all are empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in (typographic, family, postscript)])


def group_key(display: Column, style: Column) -> Column:
    return F.concat_ws(" ", normal_name(display), normal_name(style))


def strict_group_key(display: Column, style: Column) -> Column:
    """As group_key, but the two parts cannot run into each other."""
    return F.struct(normal_name(display).alias("family"), normal_name(style).alias("style"))


def version_number(c: Column) -> Column:
    """The first number in a version string, else 0."""
    return F.coalesce(F.regexp_extract(c, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"), F.lit(0.0))


def format_priority(ext: Column) -> Column:
    bare = F.regexp_replace(F.lower(ext), r"^\.", "")
    return F.coalesce(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])[bare], F.lit(0))


def known_extension(path: Column) -> Column:
    """The container of a path by its extension, in lower case; null if it is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin(*PRIORITY), ext)


@F.pandas_udf(StringType())
def _letter(heads: pd.Series) -> pd.Series:
    def one(head: str) -> str:
        up = unicodedata.normalize("NFD", head or "")[:1].upper()
        return up if len(up) == 1 and "A" <= up <= "Z" else "#"

    return heads.map(one)


def sorting_letter(family: Column) -> Column:
    """A-Z by the first character without its marks, else #.  Plain ASCII never leaves the JVM's side of the CASE."""
    head = F.substring(F.regexp_replace(family, r"^\p{Mn}+", ""), 1, 1)  # marks before it count for nothing
    first = F.upper(head)
    return F.when(first.rlike("^[A-Z]$") & head.rlike(r"^[\x00-\x7f]$"), first).when(head.rlike(r"^[\x00-\x7f]?$"), F.lit("#")).otherwise(_letter(head))


def chip_letter(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.upper(F.substring(name, 1, 1))).otherwise(F.lit("#"))


def path_component(c: Column) -> Column:
    """Characters that Windows forbids become '-'; trailing dots and spaces go; never empty."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r'[\x00-\x1f"<>|:*?\\/]', "-"), r"[. ]+$", ""), r"^\s+|\s+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("-"))


def name_part(c: Column) -> Column:
    return F.replace(path_component(c), F.lit("_"), F.lit("-"))


def hex8(crc: Column) -> Column:
    return F.lpad(F.hex(crc), 8, "0")


def vault_path(display: Column, style: Column, version: Column, glyphs: Column, ext: Column, crc: Column | None = None) -> Column:
    """letter/family/display_style_vVERSION_gGLYPHS[_cCRC].ext"""
    shown = F.when(F.length(version) > 0, name_part(version)).otherwise(F.lit("0"))
    name = [name_part(display), F.lit("_"), name_part(style), F.lit("_v"), shown, F.lit("_g"), glyphs.cast("string")]
    if crc is not None:
        name += [F.lit("_c"), hex8(crc)]
    family = path_component(display)
    return F.concat(sorting_letter(family), F.lit("/"), family, F.lit("/"), *name, F.lit("."), ext)


def licence_class(copyright_: Column, description: Column, url: Column, fs_type: Column) -> Column:
    """Free wording first, then the restricted-embedding bit, then paid wording, else Unknown."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (copyright_, description, url)]))
    restricted = fs_type.bitwiseAND(2) != 0
    return bound(text, lambda t: F.when(any_of(t, FREE_WORDING), "Free").when(restricted, "Paid").when(any_of(t, PAID_WORDING), "Paid").otherwise("Unknown"))


def bound(c: Column, use) -> Column:
    """use(c) with c computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(c), use), 1)


def any_of(text: Column, words) -> Column:
    """Whether any of the words occurs, taken literally."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def has_ligatures(features: Column) -> Column:
    """Whether any of the features substitutes ligatures."""
    return F.coalesce(F.arrays_overlap(features, F.array(*[F.lit(t) for t in LIGATURE_FEATURES])), F.lit(False))


def metadata_score(names: list[Column], has_os2: Column) -> Column:
    """How many of the names are filled, plus one for an OS/2 table."""
    return sum((F.coalesce((F.length(c) > 0).cast("int"), F.lit(0)) for c in names), F.coalesce(has_os2.cast("int"), F.lit(0)))


def human_size(n: Column) -> Column:
    """Steps of 1024 from B to PB; above B one decimal, which is left out when it is 0."""
    step = lambda k, unit: F.concat(F.regexp_replace(F.round(n / F.lit(1024.0**k), 1).cast("string"), r"\.0$", ""), F.lit(unit))
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(n < 1024 ** (k + 1), step(k, unit))
    return out.otherwise(step(5, "PB"))


# Weight classes by style wording, in order of precedence.
_WEIGHTS = (
    (("extrabold", "ultrabold"), 800),
    (("semibold", "demi"), 600),
    (("black", "heavy"), 900),
    (("bold",), 700),
    (("extralight", "ultralight"), 200),
    (("light",), 300),
    (("medium",), 500),
    (("thin",), 100),
)
# The order in which a declared weight is read.
_DECLARED = (
    (("thin",), 100),
    (("extralight", "ultralight"), 200),
    (("light",), 300),
    (("medium",), 500),
    (("semibold", "demi"), 600),
    (("extrabold", "ultrabold"), 800),
    (("black", "heavy"), 900),
    (("bold",), 700),
)


def _by_wording(c: Column, table, otherwise) -> Column:
    def use(t: Column) -> Column:
        out = F
        for words, value in table:
            out = out.when(any_of(t, words), value)
        return out.otherwise(otherwise)

    return bound(F.lower(c), use)


def style_weight(style: Column) -> Column:
    return _by_wording(style, _WEIGHTS, 400)


def declared_weight(weight: Column) -> Column:
    return _by_wording(weight, _DECLARED, 400)


def is_bold(weight: Column) -> Column:
    return _by_wording(weight, ((("bold", "black", "heavy"), True),), False)


def style_slant(style: Column) -> Column:
    return _by_wording(style, ((("italic", "oblique"), "Italic"),), "Normal")


def marker_name(display: Column, style: Column, crc: Column, ext: Column) -> Column:
    """Name of a file put into the system's font folder: carries .fv and eight hex digits."""
    return F.concat(name_part(display), F.lit("_"), name_part(style), F.lit(".fv"), hex8(crc), F.lit("."), ext)


def marker_crc(path: Column) -> Column:
    """The checksum in a marker name, else null."""
    digits = F.regexp_extract(path, r"\.fv([0-9A-Fa-f]{8})\.[^.]+$", 1)
    return F.when(F.length(digits) == 8, F.conv(digits, 16, 10).cast("bigint"))


def codepoints(text: Column) -> Column:
    """The code points of a text, in order."""
    return F.transform(F.filter(F.split(text, ""), lambda ch: F.length(ch) > 0), F.ascii)


def distinct_codepoints(text: Column) -> Column:
    """The distinct code points of a text; repeats go before anything is computed on them."""
    return F.transform(F.filter(F.array_distinct(F.split(text, "")), lambda ch: F.length(ch) > 0), F.ascii)


def glyph_label(codepoint: Column, glyph: Column) -> Column:
    """The character; U+XXXX for blanks and controls; #glyph if there is no character."""
    blank = (codepoint <= 32) | codepoint.between(127, 160)
    return F.when(codepoint.isNull(), F.concat(F.lit("#"), glyph.cast("string"))).when(blank, F.concat(F.lit("U+"), F.lpad(F.hex(codepoint), 4, "0"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(codepoint), 8, "0")), "UTF-32"))


def block_label(name: Column, start: Column, end: Column, present: Column) -> Column:
    """Name, bounds and how many of the block's points are covered."""
    point = lambda c: F.lpad(F.hex(c), F.greatest(F.lit(4), F.length(F.hex(c))), F.lit("0"))
    return F.concat(name, F.lit(" \u2014 U+"), point(start), F.lit("..U+"), point(end), F.lit(" ("), present.cast("string"), F.lit("/"), (end - start + 1).cast("string"), F.lit(")"))
