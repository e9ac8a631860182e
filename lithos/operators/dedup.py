"""Exact duplicates of assets, and matching against a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators.skew import to_group


def fingerprint(df: DataFrame, content: str) -> DataFrame:
    """Length, CRC-32 and SHA-256 of the content, which is dropped before any shuffle."""
    raw = F.col(content).cast("binary")
    return df.withColumns({"file_size": F.octet_length(raw).cast("bigint"), "crc32": F.crc32(raw), "sha256": F.sha2(raw, 256)}).drop(content)


def exact_groups(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """One row per distinct content: the smallest path stands for it, all paths are kept."""
    return df.groupBy(*keys).agg(F.min(path).alias("representative"), F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_set(path)).alias("paths"))


def match_existing(new: DataFrame, existing: DataFrame, keys: list[str], label: str) -> DataFrame:
    """New rows whose content the catalog has, with the smallest label of the catalog's rows."""
    catalog = existing.groupBy(*keys).agg(F.min(label).alias("matched"))
    return to_group(new, catalog, keys, F.struct(*new.columns))


def unmatched(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return to_group(new, existing.select(*keys).distinct(), keys, F.struct(*new.columns), "left_anti")


def not_yet_done(paths: DataFrame, done: DataFrame, path: str) -> DataFrame:
    """Paths that were not processed before, without regard to case."""
    seen = done.select(F.upper(path).alias("_done"))
    return paths.join(seen, F.upper(paths[path]) == seen["_done"], "left_anti")


def union_ignoring_case(a: Column, b: Column) -> Column:
    """Both lists in order; of spellings that differ in case alone the first stays."""
    both = F.concat(a, b)
    return F.filter(both, lambda x, i: ~F.exists(F.slice(both, F.lit(1), i), lambda y: F.upper(y) == F.upper(x)))


def rejections(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
