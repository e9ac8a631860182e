"""Joins of rows to one row per group, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salts_of(df: DataFrame) -> int:
    """Parts that a hot group is dealt over: as many as a shuffle has partitions, which follow the data."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salted(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts_of(rows))))


_MERGEABLE = {"min": F.min, "max": F.max, "sum": F.sum}


def with_group(rows: DataFrame, keys: list[str], by: Column, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with aggregates of their group, {name: (min, max or sum, column)}; ``by`` deals the rows of a hot group."""
    dealt = salted(rows, by)
    merged = dealt.groupBy(*keys, "_salt").agg(*[_MERGEABLE[f](c).alias(n) for n, (f, c) in aggregates.items()])
    groups = merged.groupBy(*keys).agg(*[_MERGEABLE[f](n).alias(n) for n, (f, _) in aggregates.items()], F.collect_list("_salt").alias("_salts"))
    return dealt.join(groups.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"]).drop("_salt")


def to_group(rows: DataFrame, groups: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """rows joined to ``groups`` (one row a key; inner, left or left_anti), dealt over the salts that occur."""
    dealt = salted(rows, by)
    there = dealt.groupBy(*keys, "_salt").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(F.collect_list("_salt").alias("_salts"))
    spread = there.join(groups, keys).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")
