"""Helpers over the shared storage: hot groups, bounded samples, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators.skew import salts_of
from lithos.storage import settled, shared_dir

__all__ = ["components", "contracted", "drawn", "joined", "least_partner", "rejoin", "salts_of", "settled", "shared_dir", "spread"]


def spread(rows: DataFrame, keys: list[str], id_col: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal keys, found without sending a hot group to one task.

    Returns rows with a ``salt``, and one settled row per group: keys, ``least`` (smallest
    id), ``size`` and ``salts``.  ``rejoin`` brings columns of the groups back to the rows.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    merged = rows.groupBy(*keys, "salt").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("size"))
    groups = merged.groupBy(*keys).agg(F.min("least").alias("least"), F.sum("size").alias("size"), F.collect_list("salt").alias("salts"))
    return rows, settled(groups)


def rejoin(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to their groups by keys and salt, so a hot group is dealt over its salts."""
    return rows.join(groups.withColumn("salt", F.explode("salts")).drop("salts"), [*keys, "salt"])


#: Rows of a key beyond which joined() deals them over salts, and the most keys it broadcasts for that.
HOT_ROWS, HOT_KEYS = 1_000, 1_000_000


def joined(rows: DataFrame, counts: DataFrame, key: str, n: str, id_col: str) -> DataFrame:
    """rows joined to the settled counts (one row a key; n: how many of rows have it), hot keys dealt over salts.

    The bound on a key's rows rises with the table only so that at most HOT_KEYS keys pass it.
    """
    salts = salts_of(rows)
    bound = max(HOT_ROWS, (counts.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot = counts.filter(F.col(n) > bound).select(key, F.lit(True).alias("_hot"))  # at most HOT_KEYS rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(id_col), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    places = F.when(F.col(n) > bound, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return rows.join(counts.withColumn("_salt", F.explode(places)), [key, "_salt"]).drop("_salt")


def drawn(df: DataFrame, draw, most: int) -> DataFrame:
    """The ``most`` rows with the least draws (a 64-bit hash Column).

    A limit sends each task's first rows to one place, which grows with the tasks; so rows
    that a draw this large keeps out are filtered first, by a count of all.
    """
    df = df.withColumn("_draw", F.shiftrightunsigned(draw, 1))
    total = df.count()
    if total > 8 * most:
        df = df.filter(F.col("_draw") <= int(2**63 * (4 * most / total)))
    return df.orderBy("_draw", *[c for c in df.columns if c != "_draw"]).limit(most).drop("_draw")


EDGES_PER_PART = 100_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one task as (node, smallest node it reaches there), at most one for each node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    pairs = [(u, v) for u in list(root) if (v := find(u)) != u]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def least_partner(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least v of its u; the pairs of a hot u are dealt over salts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts_of(pairs))))
    merged = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = merged.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected edges (a, b); a component is its smallest node.

    Alternates large-star and small-star steps, whose edge count never exceeds the input's,
    until the edges no longer change.  Between them each task contracts its own edges, so
    that edges held by one task need no rounds among themselves; each round is settled.
    What a single task contracts is final.
    """
    e = settled(edges.select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")).filter("u <> v").distinct())
    parts = 1 + e.count() // EDGES_PER_PART  # few edges in few files; the count never grows
    e = settled(e.coalesce(parts).mapInArrow(contracted, "u bigint, v bigint"))
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() if parts > 1 else None
        if now is None or tuple(now) == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = tuple(now)
        both = least_partner(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = least_partner(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        e = settled(small.distinct().coalesce(parts).mapInArrow(contracted, "u bigint, v bigint"))
