"""Aggregates over records decoded from assets: names, features, ligatures, glyph maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_preference(platform: Column, language: Column) -> Column:
    """Windows en-US, Windows, Unicode, Macintosh English; 0: never used."""
    return F.when((platform == 3) & (language == 0x0409), 4).when(platform == 3, 3).when(platform == 0, 2).when((platform == 1) & (language == 0), 1).otherwise(0)


def best_names(records: DataFrame, keys: list[str], preference: Column, value: str, order: str) -> DataFrame:
    """The value of the most preferred record of a key; blanks never win, ties keep the first."""
    clean = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    usable = records.withColumn("_v", clean).withColumn("_s", preference).filter((F.col("_s") > 0) & (F.length("_v") > 0))
    return usable.groupBy(*keys).agg(F.max_by("_v", F.struct("_s", (-F.col(order)).alias("o"))).alias("name"))


def distinct_in_order(df: DataFrame, keys: list[str], tag: str, order: str) -> DataFrame:
    """Distinct tags of a key in the order first seen."""
    first = df.groupBy(*keys, tag).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", tag))), lambda s: s[tag]).alias("tags"))


def feature_summary(lookups: DataFrame, keys: list[str]) -> DataFrame:
    """Per feature: number of lookups and the sorted distinct kinds of them (columns tag, lookup, kind)."""
    return lookups.groupBy(*keys, "tag").agg(F.count_distinct("lookup").alias("lookup_count"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("lookup_types"))


def new_ligatures(ligatures: DataFrame, keys: list[str]) -> DataFrame:
    """Per feature the ligatures that no feature before it has (columns tag, glyph, components, ord); zeros included."""
    first = ligatures.groupBy(*keys, "glyph", "components").agg(F.min_by("tag", F.struct("ord", "tag")).alias("tag"))
    counts = first.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("new_ligatures"))
    tags = ligatures.select(*keys, "tag").distinct()
    return tags.join(counts, [*keys, "tag"], "left").withColumn("new_ligatures", F.coalesce("new_ligatures", F.lit(0).cast("bigint")))


def distinct_ligatures(ligatures: DataFrame, keys: list[str], most: int = 1500) -> DataFrame:
    """Ligatures distinct by (glyph, components), the first ``most`` of each key by order (a feature of the report)."""
    first = ligatures.groupBy(*keys, "glyph", "components").agg(F.min("ord").alias("ord"))
    kept = first.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "glyph", "components"))), 1, most).alias("l"))
    return kept.select(*keys, F.explode("l").alias("l")).select(*keys, "l.glyph", "l.components")


def glyph_to_codepoint(cmap: DataFrame, keys: list[str]) -> DataFrame:
    """The first code point that maps to each glyph (columns glyph, codepoint, ord)."""
    return cmap.filter("glyph <> 0").groupBy(*keys, "glyph").agg(F.min_by("codepoint", F.struct("ord", "codepoint")).alias("codepoint"))


def name_to_codepoint(names: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Glyph names to code points: the part before '.', a table, uniXXXX or uXXXX[XX], else -1.

    ``table`` (glyph_name, codepoint) is joined, not broadcast, unless Spark finds it small.
    """
    stem = F.regexp_extract(F.col(name), r"^([^.]*)", 1)
    digits = F.coalesce(F.nullif(F.regexp_extract(stem, r"^uni([0-9A-Fa-f]{4})$", 1), F.lit("")), F.nullif(F.regexp_extract(stem, r"^u([0-9A-Fa-f]{4,6})$", 1), F.lit("")))
    listed = table.select(F.col("glyph_name").alias("_stem"), F.col("codepoint").alias("_cp"))
    joined = names.withColumn("_stem", stem).join(listed, "_stem", "left")
    return joined.withColumn("codepoint", F.coalesce("_cp", F.conv(digits, 16, 10).cast("int"), F.lit(-1))).drop("_stem", "_cp")
