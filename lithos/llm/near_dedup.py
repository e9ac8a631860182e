"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each text becomes its set of distinct word shingles and a signature of ``COORDINATES``
   minima.  Texts with equal sets form one class (salted, so a class may hold a third of
   all rows); one representative stands for it from here on.
2. Representatives are posted under their (coordinate, value) pairs.  A value held by one
   representative alone can match nothing, so whoever has fewer than the match threshold
   of shared values is skipped; a first pass over ``FIRST`` coordinates leaves few for the
   pass over all.  Of m shared values, a partner with T matches must share one of the
   m - T + 1 rarest: that prefix alone is merged.
3. Short posting lists give all their pairs.  In longer ones each entry meets the head of
   its chunk, and the heads meet in turn, so a list of n entries gives n pairs.
   Collisions are counted over all coordinates; pairs at the match threshold go on and
   are confirmed on their full shingle sets.
4. Links give components.  A long list whose entries all lie in one component is settled.
   For the others an exact rest pass compares, block by block and inside the task, the
   signatures of entries that are not yet connected.  Only entries with a partner at the
   threshold come back with their texts; their pairs are confirmed inside the task, so a
   block pair gives a link for each two components it joins at most.

No key is joined whole: postings of frequent values, the entries of large clusters and the
members of large components are dealt over salts.

Thresholds leave five standard deviations: a pair at exactly the link similarity is
missed about once in 10^6.  Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import components, joined, rejoin, salts_of, settled, spread
from lithos.llm.textops import LOWER, SPACED, U, gram_hashes, hash_spans, mix, slices, text_bytes, word_spans

SHINGLE = 5
SIMILARITY = 80
COORDINATES, FIRST = 128, 40
#: Lists up to SHORT give all pairs, longer ones are chunked by CHUNK.
SHORT, CHUNK = 8, 32
#: The rest pass compares blocks of a sixteenth of a cluster, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 512, 4096

_R = np.random.default_rng(20240607)
_A = _R.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _R.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def least_matches(coordinates: int, similarity: int) -> int:
    """Five standard deviations under the matches expected at the link similarity."""
    s = similarity / 100
    return max(1, int(np.floor(coordinates * s - 5 * np.sqrt(coordinates * s * (1 - s)))))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (len + 1)."""
    data, off = text_bytes(texts)
    data = LOWER[data]
    start, end, first = word_spans(data, off, SPACED)
    h = hash_spans(data, start, end)
    g = gram_hashes(h, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(g[a : b - size + 1]))
        else:
            sets.append(mix(gram_hashes(h[a:b], b - a) + U(b - a)) if b > a else g[:0])
    return np.concatenate(sets) if sets else g[:0], np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            g, at = shingle_sets(rows.column("text"), size)
            n = np.diff(at)
            has = np.flatnonzero(n)
            sums = np.zeros((2, len(n)), np.uint64)
            minima = np.zeros((len(n), COORDINATES), np.uint32)
            if len(has):
                begin = at[:-1][has]
                sums[0, has] = np.add.reduceat(mix(g), begin)
                sums[1, has] = np.add.reduceat(mix(g ^ U(0xA5A5A5A5DEADBEEF)), begin)
                low = (g >> U(32)).astype(np.uint32)
                for k in range(COORDINATES):
                    minima[has, k] = np.minimum.reduceat(low * _A[k] + _B[k], begin)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([m.tobytes() for m in minima], pa.binary())],
                names=["id", "n", "set_a", "set_b", "sketch"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), COORDINATES)


def _postings(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = _matrix(b.column("sketch"))[:, :coordinates].astype(np.int64) | (np.arange(coordinates, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(b.num_rows), coordinates))), pa.array(key.ravel())], names=["id", "key"])

    return run


def shared_values(reps: DataFrame, coordinates: int) -> DataFrame:
    """(id, key, freq) of the values that at least two representatives hold."""
    posted = reps.select("id", "sketch").mapInArrow(_postings(coordinates), "id bigint, key bigint")
    freq = settled(posted.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"))
    return joined(posted, freq, "key", "freq", "id")


def _briefs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of each coordinate: enough to count collisions, where one in 256 is by chance, and a quarter to ship."""
    for b in batches:
        if b.num_rows:
            low = _matrix(b.column("sketch")).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "n", "brief"])


def _alike(similarity: int):
    least = least_matches(COORDINATES, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in ("brief_a", "brief_b"))
                ok = (x == y).sum(axis=1) >= least
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(size: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            (x, at), (y, to) = shingle_sets(b.column("text_a"), size), shingle_sets(b.column("text_b"), size)
            ok = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                p, q = x[at[k] : at[k + 1]], y[to[k] : to[k + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[k] = both > 0 and 100 * both >= similarity * (len(p) + len(q) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _survivors(similarity: int):
    """Entries of a block pair with a partner, in another component, at the match threshold."""
    least = least_matches(COORDINATES, similarity)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        comp, n, side = (group.column(k).to_numpy() for k in ("component", "n", "side"))
        m = np.frombuffer(b"".join(group.column("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        right = np.flatnonzero(side != 0)
        flag = np.zeros(len(n), bool)
        for i in np.flatnonzero(side != 1):  # side 2: the block meets itself
            js = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]))]
            js = js[np.count_nonzero(m[js] == m[i], axis=1) >= least]
            flag[js] = True
            flag[i] |= len(js) > 0
        return group.drop_columns(["n", "brief"]).filter(pa.array(flag))

    return run


def _blocks(size: int, similarity: int):
    """Links of one block pair's survivors, confirmed on full sets; entries that are connected already are not compared."""
    least = least_matches(COORDINATES, similarity)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, n, side = (group.column(k).to_numpy() for k in ("id", "component", "n", "side"))
        m = np.frombuffer(b"".join(group.column("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        sets, at = shingle_sets(group.column("text").combine_chunks(), size)
        parent = np.unique(comp, return_inverse=True)[1].astype(np.int64)
        root_of = np.arange(parent.max() + 1)  # union-find over components; parent: entry to component

        def root(x: int) -> int:
            while root_of[x] != x:
                root_of[x] = x = root_of[root_of[x]]
            return x

        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found: list[tuple[int, int]] = []
        for i in left:
            js = right[(parent[right] != parent[i]) & (100 * np.minimum(n[right], n[i]) >= similarity * np.maximum(n[right], n[i]))]
            js = js[np.count_nonzero(m[js] == m[i], axis=1) >= least]
            x = sets[at[i] : at[i + 1]]
            for j in js:
                a, b = root(int(parent[i])), root(int(parent[j]))
                if a == b:
                    continue
                y = sets[at[j] : at[j + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= similarity * (len(x) + len(y) - both):
                    root_of[max(a, b)] = min(a, b)
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        got = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= similarity * |union| of their sets
    of ``shingle``-word strings (of the whole sequence, for fewer words), lower-cased A-Z.
    Null, empty and wordless texts, and rows with a null id, are linked with nothing and
    kept.  Ids are integers and expected to be unique; rows repeating an id share a fate.
    Of equal or linked texts the smallest id stays.  A text of any length is one unit of a
    task's memory.  Columns but the two named are ignored, whatever their names; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = settled(rows.mapInArrow(_sketch(shingle), "id bigint, n bigint, set_a bigint, set_b bigint, sketch binary"))
    keys = ["set_a", "set_b", "n"]
    linked = sketch.filter("n > 0 and id is not null")
    salts = salts_of(docs)
    salted, classes = spread(linked.drop("sketch"), keys, "id", salts)

    # What is used several times is settled; so are the halves of long plans, which the driver holds whole, again at each stage.
    reps = settled(linked.join(classes.select(F.col("least").alias("id")), "id", "left_semi").select("id", "n", "sketch").dropDuplicates(["id"]))
    first = shared_values(reps, FIRST).groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least_matches(FIRST, similarity))
    likely = settled(reps.join(first.select("id"), "id", "left_semi"))
    least = least_matches(COORDINATES, similarity)
    values = shared_values(likely, COORDINATES).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "key"))).alias("v")).filter(F.size("v") >= least)
    values = values.select("id", F.slice("v", F.lit(1), F.size("v") - (least - 1)).alias("prefix"))
    entries = settled(likely.join(values, "id"))
    texts = settled(rows.join(entries.select("id"), "id", "left_semi").dropDuplicates(["id"]))
    lists = entries.select("id", F.explode("prefix").alias("p")).select("id", "p.freq", "p.key")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm(shingle, similarity), "a bigint, b bigint")

    short = lists.filter(F.col("freq") <= SHORT)
    pairs = short.select("key", F.col("id").alias("a")).join(short.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b")
    top = lists.agg(F.max("freq")).first()[0] or 0
    long = lists.filter(F.col("freq") > SHORT)
    nodes, width = long, top
    while top > SHORT:
        nodes = nodes.withColumn("freq", F.ceil(F.col("freq") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("key", "id"), F.col("freq")))
        heads = settled(nodes.groupBy("key", "chunk").agg(F.min("id").alias("a"), F.max("freq").alias("f")))
        pairs = pairs.unionByName(nodes.join(heads, ["key", "chunk"]).filter("id <> a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")))
        nodes = heads.select("key", F.col("a").alias("id"), F.col("f").alias("freq"))
        width = -(-width // CHUNK)
        if width <= 1:
            break
    briefs = settled(entries.select("id", "n", "sketch").mapInArrow(_briefs, "id bigint, n bigint, brief binary"))
    side = lambda x: briefs.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("brief").alias(f"brief_{x}"))
    alike = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    links = settled(confirmed(settled(alike.mapInArrow(_alike(similarity), "a bigint, b bigint"))))
    found = settled(components(links))

    # The rest: long lists over several components.
    if top > SHORT:
        labelled = long.join(found, long["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        labelled = labelled.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        merged = labelled.groupBy("key", "salt").agg(F.min("id").alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        open_lists = merged.groupBy("key").agg(F.min("head").alias("head"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("salt").alias("salts")).filter("lo < hi")
        # Lists that share entries become one cluster: each pair is compared once, not once a list.
        members = settled(rejoin(labelled, open_lists.select("key", "head", "salts"), ["key"]).select("id", "component", "head").distinct())
        clusters = components(members.select(F.col("head").alias("a"), F.col("id").alias("b")))
        own = members.select("id", "component").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
        own, sizes = spread(own, ["cluster"], "id", salts)
        own = rejoin(own, sizes.select("cluster", "size", "salts"), ["cluster"]).join(briefs, "id")
        block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("size") / 16)))
        own = own.withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
            "id", "component", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "n", "brief",
        )
        left = settled(dealt.groupBy("cluster", "i", "j").applyInArrow(_survivors(similarity), "id bigint, component bigint, cluster bigint, i bigint, j bigint, side int"))
        more = left.join(briefs, "id").join(texts, "id").groupBy("cluster", "i", "j").applyInArrow(_blocks(shingle, similarity), "a bigint, b bigint")
        more = settled(more)
        if not more.isEmpty():
            found = settled(components(links.unionByName(more)))

    component = classes.join(found, classes["least"] == found["node"], "left").select(*keys, "salts", F.coalesce("component", "least").alias("component_id"))
    grouped = rejoin(salted, component, keys).select("id", "n", "component_id")
    alone = sketch.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
