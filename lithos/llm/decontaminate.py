"""Benchmark decontamination with generalised suffix automata.

1. Items become word hashes.  A bitmap of the hashes of their windows (13 consecutive words,
   or a whole shorter item), of a fixed largest size, goes to all tasks.
2. One pass over the documents marks the windows that the bitmap knows.  Consecutive ones
   unite to passages; whatever lies outside of them can lie in no window of an item.
3. Items are dealt into blocks of at most some ``BLOCK_WORDS`` words (a longer item is cut
   into overlapping parts), and passages go to every block.  A task inserts its block's
   items into one suffix automaton, streams the passages through it and tracks the longest
   match ending at each word; wherever that length reaches a window, its words are hit and
   the items holding it are noted.  So false alarms of the bitmap end here.
4. Spans and items unite by document.  ``kept_text`` is the text without the spans.

Nothing depends on the number of blocks: the documents are read once, items never pass
through the driver, and passages are dealt by document, so a hot one loads no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import settled
from lithos.llm.textops import ALNUM, LOWER, U, gram_hashes, hash_spans, mix, slices, text_bytes, word_spans

WINDOW = 13
#: Words of items in one automaton (some 700 bytes a word).
BLOCK_WORDS = 100_000
#: Words of passages that one task streams through an automaton, about.
PASSAGE_WORDS = 250_000
#: Least and most bits of the bitmap of windows, as powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 20, 27
_CHUNK = 15  # bits of a place within a chunk of the bitmap


class Automaton:
    """Suffix automaton over the word hashes of a block of items."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [item for item, _ in items]
        whole: dict[int, dict[int, set[int]]] = {}
        paths = []
        for words in (w for _, w in items):
            last, path = 0, []
            for c in words:
                last = self._extend(last, c)
                path.append(last)
            paths.append(path)
        # Items are kept where strings as long as a window end; shorter strings matter only as whole items.
        ends: dict[int, set[int]] = {}
        for k, path in enumerate(paths):
            for state in path:
                while state > 0 and self.length[state] >= window and k not in ends.setdefault(state, set()):
                    ends[state].add(k)
                    state = self.link[state]
            if 0 < len(path) < window:
                whole.setdefault(path[-1], {}).setdefault(len(path), set()).add(k)
        self.items = {v: sorted(e) for v, e in ends.items()}
        self.whole = whole
        #: Nearest state with whole short items, itself included.
        self.short = [-1] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            if state in whole:
                self.short[state] = state
            elif self.link[state] >= 0:
                self.short[state] = self.short[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # another item already made this string
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, h: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(position, window length, items) of every window that ends at a position."""
        nxt, link, length = self.next, self.link, self.length
        state, have = 0, 0
        for i, c in enumerate(h):
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            else:
                state, have = 0, 0
            if have >= self.window:
                v = state
                while length[link[v]] >= self.window:
                    v = link[v]
                yield i, self.window, self.items[v]
            v = self.short[state]
            while v > 0:
                for n, ids in self.whole[v].items():
                    if n <= have:
                        yield i, n, sorted(ids)
                v = self.short[link[v]]


def _parts(window: int, part_words: int):
    """Items to parts of their word hashes: (item, words), every window in at least one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            data, off = text_bytes(rows.column("text"))
            data = LOWER[data]
            start, end, first = word_spans(data, off, ALNUM)
            h = hash_spans(data, start, end)
            owner, words = [], []
            for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                while lo < hi:
                    to = min(hi, lo + part_words)
                    owner.append(k), words.append(h[lo:to].tobytes())
                    lo = hi if to == hi else to - window + 1
            yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(owner, pa.int64())), pa.array(words, pa.binary())], names=["item", "words"])

    return run


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of n words; those of different lengths differ."""
    return mix(gram_hashes(h, n) ^ U(n))


def _slots(window: int, bits: int):
    """The bitmap's places that the windows of parts take, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("words").to_pylist():
                h = np.frombuffer(blob, np.uint64)
                slot = np.unique(window_hashes(h, min(window, len(h))) >> U(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot >> _CHUNK, pa.int32()), pa.array(slot & ((1 << _CHUNK) - 1), pa.int32())], names=["chunk", "place"])

    return run


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << _CHUNK, bool)
    bits[rows["place"].to_numpy()] = True
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})


def _passages(known, lengths: list[int], bits: int, keep_text: bool):
    """Documents to (row, id, n_words, passages); row numbers the rows, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, row = known.value, TaskContext.get().partitionId() << 40
        for rows in slices(batches, "text"):
            data, off = text_bytes(rows.column("text"))
            start, end, first = word_spans(LOWER[data], off, ALNUM)
            h = hash_spans(LOWER[data], start, end)
            owner = np.repeat(np.arange(rows.num_rows), np.diff(first))
            edge = np.zeros(len(h) + 1, np.int32)
            for n in lengths:
                if len(h) >= n:
                    at = np.flatnonzero(owner[: len(h) - n + 1] == owner[n - 1 :])
                    slot = window_hashes(h, n)[at] >> U(64 - bits)
                    at = at[(bitmap[slot >> U(3)] >> (U(7) - (slot & U(7))).astype(np.uint8)) & 1 == 1]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n, -1)
            inside = np.cumsum(edge[:-1]) > 0
            begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (owner[1:] != owner[:-1])])) if len(h) else first[:0]
            stop = np.flatnonzero(inside & np.concatenate([~inside[1:] | (owner[1:] != owner[:-1]), [True]])) + 1 if len(h) else first[:0]
            found: list[list] = [[] for _ in range(rows.num_rows)]
            for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                k = int(owner[a])
                found[k].append({"at": a - int(first[k]), "words": h[a:b].tobytes()})
            cols = [pa.array(np.arange(row, row + rows.num_rows)), rows.column("id"), pa.array(np.diff(first), pa.int64()), pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("words", pa.binary())])))]
            yield pa.RecordBatch.from_arrays([*cols, *([rows.column("text")] if keep_text else [])], names=["row", "id", "n_words", "passages", *(["text"] if keep_text else [])])
            row += rows.num_rows

    return run


def _stream(window: int):
    """Items, then passages of each (block, deal): (row, spans, items, unnamed) of what is found."""
    kind = pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, automaton = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["block"], r["deal"]) != key:
                    key, items, automaton = (r["block"], r["deal"]), [], None
                if r["row"] is None:
                    items.append((r["item"], np.frombuffer(r["words"], np.uint64).tolist()))
                    continue
                automaton = automaton or Automaton(items, window)
                h = np.frombuffer(r["words"], np.uint64).tolist()
                hit, names = np.zeros(len(h), bool), set()
                for i, n, ids in automaton.stream(h):
                    hit[i - n + 1 : i + 1] = True
                    names.update(automaton.ids[k] for k in ids)
                if names:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))) + r["at"]
                    out.append((r["row"], edge.reshape(-1, 2).tolist(), sorted(names - {None}), None in names))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), kind, pa.list_(pa.string()), pa.bool_()), strict=True)], names=["row", "spans", "items", "unnamed"])

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    coverage: tuple[int, int] = (1, 20),
    block_words: int = BLOCK_WORDS,
    keep_text: bool = False,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans, items
    and, if asked for, kept_text: the text without the spans and what lies between their words.

    ``spans`` are the [from, to) word ranges inside occurrences of item windows.  Null or
    wordless texts have no words and are never contaminated; their kept_text is the text.
    Ids of documents may repeat or be null: rows are judged one by one.  Items without words
    match nothing; items that repeat a text are all named, rows that repeat an item id are
    one item.  An item with a null id hits words and counts as one item more, but has no
    name to list.  A text of any length is one unit of a task's memory.  Other columns are
    ignored, whatever their names.  No items mark nothing; no documents give no rows.
    """
    spark = docs.sparkSession
    part_words = max(2 * window, block_words // 8)
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    parts = settled(texts.mapInArrow(_parts(window, part_words), "item string, words binary"))
    n = F.octet_length("words") / 8
    total, short = parts.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint"), F.collect_set(F.when(n < window, n.cast("int")))).first()  # at most window - 1 lengths
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * total).bit_length()))
    slots = parts.mapInArrow(_slots(window, bits), "chunk int, place int").distinct()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.groupBy("chunk").applyInPandas(_packed, "chunk int, bits binary").toLocalIterator():  # 4 KB each, 16 MB in all
        bitmap[r["chunk"] << (_CHUNK - 3) : (r["chunk"] + 1) << (_CHUNK - 3)] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(bitmap)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"row bigint, id {rows.schema['id'].dataType.simpleString()}, n_words bigint, passages array<struct<at:bigint,words:binary>>" + ", text string" * keep_text
    lengths = sorted({*short, window}) if total else []
    marked = settled(rows.mapInArrow(_passages(known, lengths, bits, keep_text), schema))
    own = ["row", "id", "n_words", *(["text"] if keep_text else [])]
    passages = marked.filter(F.size("passages") > 0).select("row", F.inline("passages"))

    blocks = max(1, -(-2 * total // block_words))
    deals = 1 + (passages.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // (8 * PASSAGE_WORDS)
    item_rows = parts.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint"))).alias("deal"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("at"), "words", "item")
    passage_rows = passages.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("row", "at"), F.lit(deals)).alias("deal"), "row", "at", "words", F.lit(None).cast("string").alias("item"))
    dealt = item_rows.unionByName(passage_rows).repartition(max(1, blocks * deals), "block", "deal").sortWithinPartitions("block", "deal", F.col("row").isNotNull())
    hits = dealt.mapInArrow(_stream(window), "row bigint, spans array<array<bigint>>, items array<string>, unnamed boolean")
    hits = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("unnamed").alias("unnamed"))
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<array<bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= s[0]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1])))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hits = hits.withColumn("spans", F.when(F.size("spans") > 1, merged).otherwise(F.col("spans")))
    clean = marked.filter(F.size("passages") == 0).select(
        *own, F.expr("cast(array() as array<array<bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"), F.lit(False).alias("unnamed")
    )
    none = {"spans": "array<array<bigint>>", "items": "array<string>"}
    found = marked.filter(F.size("passages") > 0).select(*own).join(hits, "row", "left")
    found = found.select(*own, *[F.coalesce(k, F.expr(f"cast(array() as {t})")).alias(k) for k, t in none.items()], F.coalesce("unnamed", F.lit(False)).alias("unnamed")).unionByName(clean)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s[1] - s[0])
    if keep_text:
        kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, text string, spans array<array<bigint>>, items array<string>, unnamed boolean"
        found = found.drop("row").mapInArrow(_without, kind)
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        (F.size("items") + F.col("unnamed").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * coverage[1] >= F.col("n_words") * coverage[0])).alias("contaminated"),
        "spans",
        "items",
        *([F.col("text").alias("kept_text")] if keep_text else []),
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has lost its spans."""
    for rows in slices(batches, "text"):
        spans = rows.column("spans").to_pylist()
        texts = [remove_spans(t, x) if x else t for t, x in zip(rows.column("text").to_pylist(), spans, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == "text" else rows.column(k) for k in rows.schema.names], names=rows.schema.names)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the given [from, to) word ranges; what is between them goes too."""
    raw = text.encode()
    data, off = text_bytes(pa.array([text], pa.string()))
    start, end, _ = word_spans(LOWER[data], off, ALNUM)
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at : start[lo]])
        at = int(end[hi - 1])
    return b"".join([*out, raw[at:]]).decode()
