"""Target paths without collisions, repair plans and install states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators.skew import to_group, with_group
from lithos.storage import settled


def name_with(base: Column, suffix: Column) -> Column:
    """The name with the suffix before its extension."""
    ext = F.regexp_extract(base, r"(\.[^./\\]*)$", 1)
    return F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(ext)), suffix, ext)


def resolve_collisions(files: DataFrame, base: str, suffix: Column, order: str) -> DataFrame:
    """Adds ``target``, no two alike: the base name, or it with the suffix, or with suffix_2, suffix_3, ...

    Names are compared without regard to case.  Whoever comes first by ``order`` (unique, not
    null) takes the first of its names that is still free, as if one file were named after
    the other against the set of all names used so far, also where a suffixed name is
    another file's base name.

    That loop is a matching in which all names prefer the file that comes first, so it has a
    parallel form: every file asks for a name, a name keeps the first that asks, the others
    ask for their next, until none is refused.  A file that cannot have a name, because
    files with the same list come before it, does not ask for it, so there are few rounds
    and no name is asked for by many.
    """
    rows = files.select(F.col(base).alias("_base"), suffix.alias("_suffix"), F.col(order).alias("_order"))
    rows = rows.withColumn("_key", F.upper("_base"))
    rows = with_group(rows, ["_key"], F.col("_order"), {"_first": ("min", "_order")})
    like = Window.partitionBy("_key", "_suffix").orderBy("_order")
    later = rows.filter("_order <> _first").withColumn("_at", F.row_number().over(like).cast("bigint"))
    asked = rows.filter("_order = _first").withColumn("_at", F.lit(0).cast("bigint")).unionByName(later).select("_base", "_suffix", "_order", "_at")
    mark = F.when(F.col("_at") == 0, "").when(F.col("_at") == 1, F.col("_suffix")).otherwise(F.concat("_suffix", F.lit("_"), F.col("_at").cast("string")))
    while True:
        named = asked.withColumn("target", name_with(F.col("_base"), mark)).withColumn("_name", F.upper("target"))
        held = named.groupBy("_name").agg(F.min("_order").alias("_holder"))
        asked = settled(named.join(held, "_name").withColumn("_refused", F.col("_order") != F.col("_holder")))
        if asked.filter("_refused").isEmpty():
            break
        asked = asked.select("_base", "_suffix", "_order", (F.col("_at") + F.col("_refused").cast("bigint")).alias("_at"))
    return files.join(asked.select(F.col("_order").alias(order), "target"), order)


def repair_plan(files: DataFrame, path: str, sha: str, target: str) -> DataFrame:
    """delete: an exact duplicate of a smaller path; move: the path is not the target; keep: else."""
    joined = with_group(files, [sha], F.col(path), {"_least": ("min", path)})
    action = F.when(F.col(path) != F.col("_least"), "delete").when(F.col(path) != F.col(target), "move").otherwise("keep")
    return joined.withColumn("action", action).drop("_least")


def install_states(entries: DataFrame, own: DataFrame, system: DataFrame) -> DataFrame:
    """0: not installed; 1: a marker names its content; 2: else, a system file has its content.

    All columns of ``own`` and of ``system`` are compared.  Markers of real files name a
    CRC-32 alone, which different contents share by chance from some 10,000 of them on, so
    listings that know more (size, SHA-256) should bring it.
    """
    own_keys, keys = own.columns, system.columns
    own, ext = own.distinct().withColumn("_own", F.lit(True)), system.distinct().withColumn("_ext", F.lit(True))
    row = F.struct(*entries.columns)
    joined = to_group(to_group(entries, own, own_keys, row, "left"), ext, keys, row, "left")
    return joined.withColumn("install_state", F.when(F.col("_own"), 1).when(F.col("_ext"), 2).otherwise(0)).drop("_own", "_ext")


def install_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    installed = F.col("install_state") != 0
    return states.groupBy(*keys).agg(F.count(F.when(installed, 1)).alias("installed"), F.count(F.lit(1)).alias("members"), F.bool_and(installed).alias("all_installed"))


def still_there(entries: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Entries whose file the listing (path) still has, as when they are dragged out."""
    return to_group(entries, listing.select(F.col("path").alias(path)).distinct(), [path], F.struct(*entries.columns))
