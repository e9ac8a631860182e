"""Best-version ranking and additive selection as mergeable aggregates.

A variant's rank is one struct whose minimum is the best variant, so "best of a group" is
``min``: it combines on the map side and never collects a group in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITERIA = ("prio", "version", "glyphs", "coverage_n", "metadata")


def rank(with_path: bool = True) -> Column:
    """Ascending: best first.  Criteria descending, then the lowest checksum, then the path."""
    tail = [F.col("crc32").alias("crc32")] + ([F.col("path").alias("path")] if with_path else [])
    return F.struct(*[(-F.col(c)).alias(c) for c in CRITERIA], *tail)


def best_version(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the best entry's path and its criteria, and how many compete."""
    best = entries.groupBy(*keys).agg(F.min(rank()).alias("r"), F.count(F.lit(1)).alias("variants"))
    return best.select(*keys, F.col("r.path").alias("path"), *[(-F.col(f"r.{c}")).alias(c) for c in CRITERIA], "variants")


def additive_selection(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Which candidates join a catalog that never drops an entry.

    entries: keys, is_existing, the criteria, is_variable, crc32, path.  Returned with
    ``kept`` and ``winner`` (the path of the group's best entry after selection).

    The rule reads like a loop over candidates, best first, against a growing kept set; it
    has a closed form.  Only the first candidate can beat the best kept entry; whatever
    else is kept is kept by exception and has a lower container priority, so the best never
    changes again.  The exceptions look at the best entry alone, but for "variable while
    nothing kept is variable", which the best-ranked such candidate takes.
    """
    new, old = ~F.col("is_existing"), F.col("is_existing")
    summary = entries.groupBy(*keys).agg(
        F.min(F.when(old, rank())).alias("_kb"),
        F.min(F.when(new, rank())).alias("_c1"),
        F.max(F.when(old, F.col("is_variable"))).alias("_old_variable"),
        F.min_by("is_variable", F.when(new, rank())).alias("_c1_variable"),
        *[F.min(F.when(new & F.col("is_variable") & (F.col("prio") == p), rank())).alias(f"_v{p}") for p in range(6)],
    )
    bare = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in (*CRITERIA, "crc32")])
    top_new = F.col("_c1").isNotNull() & (F.col("_kb").isNull() | (bare("_c1") < bare("_kb")))
    summary = summary.withColumn("_top_new", top_new).withColumn("_best", F.when(F.col("_top_new"), F.col("_c1")).otherwise(F.col("_kb")))
    best_prio = -F.col("_best.prio")
    first_variable = F.least(F.lit(None).cast(summary.schema["_c1"].dataType), *[F.when(F.lit(p) < best_prio, F.col(f"_v{p}")) for p in range(6)])
    free = ~F.coalesce("_old_variable", F.lit(False)) & ~(F.col("_top_new") & F.coalesce("_c1_variable", F.lit(False)))
    summary = summary.withColumn("_take", F.when(free, first_variable))
    own, best = rank(), F.col("_best")
    better = F.lit(False)
    for c in CRITERIA[1:]:
        better = better | (-F.col(c) < best[c])
    exception = (F.col("prio") < -best["prio"]) & (better | (F.col("is_variable") & F.coalesce(own == F.col("_take"), F.lit(False))))
    kept = F.when(old, True).when(F.col("_top_new") & (own == F.col("_c1")), True).otherwise(exception)
    joined = entries.join(summary, keys)
    return joined.select(*entries.columns, kept.alias("kept"), best["path"].alias("winner"))


def merged_paths(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the winner and the paths of the candidates that lost to it."""
    return selected.groupBy(*keys, "winner").agg(F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("path")))).alias("merged"), F.count(F.when(~F.col("kept"), 1)).alias("losers"))
