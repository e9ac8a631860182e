"""Exact dedup by skew-safe combining.

Rows are keyed by the SHA-256 of their normalised text *and* the text itself:

1. the map-side aggregate removes copies within a task,
2. the groups (digest, content, salt) are merged; the salt comes from the row's id, so
   a group that holds a third of all rows is dealt over ``salts`` reducers (by default
   as many as a shuffle has partitions, which follow the table),
3. the salt winners, at most ``salts`` rows a group, are combined globally.

Content is part of the grouping key at each step, so equal digests alone never merge
rows.  The way back to the rows goes by (digest, salt), which is narrow and dealt as
evenly as step 2; were a digest ever shared by two contents, the rows of such digests
are resolved by a join on their content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import salts_of, settled


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int | None = None,
    digest: Callable[[Column], Column] = lambda c: F.unhex(F.sha2(c, 256)),
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays.  Null and empty texts are equal.  Rows that
    repeat the kept id are all marked kept (ids are expected to be unique); rows with a
    null id count in group_size and are kept only when their group has no other id.
    A text of any length is one value of an aggregate's buffer.  Other columns are ignored,
    whatever their names.  An empty table gives no rows.
    """
    salts = salts or salts_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))

    merged = rows.groupBy("digest", "norm", "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = merged.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )
    # Narrow from here on: the content has done its work.
    groups = settled(groups.select("digest", "keep_id", "group_size", "salts", F.sha2("norm", 256).alias("text_sha256")))
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")

    by_salt = groups.select("digest", "keep_id", "group_size", "text_sha256", F.explode("salts").alias("salt"))
    if shared.isEmpty():
        found = rows.select("id", "digest", "salt").join(by_salt, ["digest", "salt"])
    else:
        apart = rows.join(shared, "digest", "left_anti").select("id", "digest", "salt").join(by_salt, ["digest", "salt"])
        alike = rows.join(shared, "digest", "left_semi").select("id", "digest", "norm")
        winners = alike.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        together = alike.join(winners, ["digest", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        columns = ["id", "keep_id", "group_size", "text_sha256"]
        found = apart.select(*columns).unionByName(together.select(*columns))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
