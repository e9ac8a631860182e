"""Small text tables: favourites and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = ("vault", "user_folder", "sort", "theme")


def read_favourites(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blanks and repeats (without regard to case) go."""
    names = spark.read.text(path).select(F.trim("value").alias("family")).filter("length(family) > 0")
    return names.groupBy(F.upper("family").alias("k")).agg(F.min("family").alias("family")).select("family")


def write_favourites(favourites: DataFrame, path: str) -> None:
    favourites.orderBy(F.upper("family")).select("family").coalesce(1).write.mode("overwrite").text(path)


def toggled(favourites: DataFrame, names: DataFrame) -> DataFrame:
    """The favourites with each of the names taken out if it is in, and put in if not."""
    return favourites.join(names, F.upper(favourites["family"]) == F.upper(names["family"]), "left_anti").unionByName(
        names.join(favourites, F.upper(favourites["family"]) == F.upper(names["family"]), "left_anti")
    )


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    lines = [r["value"].strip() for r in spark.read.text(path, wholetext=False).limit(len(SETTINGS)).collect()]
    return dict(zip(SETTINGS, lines + [""] * len(SETTINGS), strict=False))


def write_settings(spark: SparkSession, settings: dict[str, str], path: str) -> None:
    """One line a setting, in their order; missing ones are empty."""
    lines = "\n".join(settings.get(k, "").replace("\n", " ") for k in SETTINGS)
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.mode("overwrite").text(path)
