"""Search, filter, group and sort over a catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    """What a user can set; unset parts do not filter."""

    needle: str = ""
    ext: str | None = None
    licence: str | None = None
    variable_only: bool = False
    installed_only: bool = False
    favourites_only: bool = False
    sort: str = "name"  # name, glyphs, variants


def has_text(names: list[Column], needle: str) -> Column:
    """The trimmed, lower-cased needle inside the lower-cased names, taken literally; empty: all."""
    needle = needle.strip().lower()
    if not needle:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws("\n", *names)), F.lit(needle))


def passes(request: Request, names: list[str]) -> Column:
    """Whether an entry passes every set part of the request but favourites, which are judged by group."""
    out = F.lit(True)
    if request.variable_only:
        out = out & F.col("is_variable")
    if request.installed_only:
        out = out & (F.col("install_state") != 0)
    if request.licence:
        out = out & (F.col("licence") == request.licence)
    if request.ext:
        out = out & (F.col("ext") == request.ext)
    return out & has_text([F.col(n) for n in names], request.needle)


def matching(entries: DataFrame, request: Request, names: list[str]) -> DataFrame:
    """Entries that pass every set part of the request; plain predicates, so they can reach the scan."""
    return entries.filter(passes(request, names))


def families(entries: DataFrame, name: str, glyphs: str, order: str) -> DataFrame:
    """Entries grouped by name without regard to case; the label is the first spelling by ``order``."""
    return entries.groupBy(F.upper(name).alias("family_key")).agg(
        F.min_by(name, F.struct(order, name)).alias("family"), F.count(F.lit(1)).alias("variants"), F.max(glyphs).alias("max_glyphs")
    )


def flag_favourites(groups: DataFrame, favourites: DataFrame, name: str) -> DataFrame:
    marked = favourites.select(F.upper(name).alias("family_key")).distinct().withColumn("_f", F.lit(True))
    return groups.join(marked, "family_key", "left").withColumn("is_favourite", F.coalesce("_f", F.lit(False))).drop("_f")


def sorted_families(groups: DataFrame, sort: str = "name") -> DataFrame:
    first = {"name": [], "glyphs": [F.desc("max_glyphs")], "variants": [F.desc("variants")]}[sort]
    return groups.orderBy(*first, "family_key")


def search(entries: DataFrame, request: Request, names: list[str], name: str, glyphs: str, order: str, favourites: DataFrame | None = None) -> DataFrame:
    """The whole interactive query: filter, group, favourites, sort."""
    groups = families(matching(entries, request, names), name, glyphs, order)
    if favourites is not None:
        groups = flag_favourites(groups, favourites, name)
        if request.favourites_only:
            groups = groups.filter("is_favourite")
    return sorted_families(groups, request.sort)


def first_family(groups: DataFrame, sort: str = "name") -> DataFrame:
    """The family that is selected at first: the top one in the given order."""
    return sorted_families(groups, sort).limit(1)


def visible_total(entries: DataFrame, request: Request, names: list[str]) -> DataFrame:
    """Visible and total counts in one pass, by every set part of the request but favourites."""
    return entries.agg(F.count(F.when(passes(request, names), 1)).alias("visible"), F.count(F.lit(1)).alias("total"))
