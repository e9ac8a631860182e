"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Every word yields four hashed features: the word and the word pair, and the *shape* and
shape pair (capitals, digits, punctuation, length class, "same word again"), so that
layout junk is recognised whatever its vocabulary.  A document's vector is the mean of
its words' features; a score is the sigmoid of a sparse dot product with the weights.

The model is fitted on the driver on a bounded, documented sample of labelled rows
(``TRAIN_ROWS``, chosen by a hash of the id); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lithos.llm.shared import drawn
from lithos.llm.textops import LOWER, SPACED, U, gram_hashes, hash_spans, mix, per_document, pieces, slices, sums, text_bytes, word_spans

#: Most labelled rows a model is fitted on.
TRAIN_ROWS = 4000
BITS = 18
KINDS = 4
#: Texts whose features are computed and kept together while a model is fitted.
SLICE = 32
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[0x21:0x30] = _PUNCT[0x3A:0x41] = _PUNCT[0x5B:0x61] = _PUNCT[0x7B:0x7F] = True


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KINDS x words feature indices, and the first word of each document."""
    start, end, first = word_spans(data, off, SPACED)
    if not len(start):
        return np.zeros((KINDS, 0), np.int32), first
    count = lambda kind: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)]))
    upper, digit, punct = count(_UPPER), count(_DIGIT), count(_PUNCT)
    length = end - start
    word = hash_spans(LOWER[data], start, end)
    doc = per_document(first)
    joined = np.zeros(len(word), dtype=bool)
    joined[1:] = doc[1:] == doc[:-1]
    same = joined.copy()
    same[1:] &= word[1:] == word[:-1]
    last = np.where(_PUNCT[data[end - 1]], data[end - 1], 0).astype(np.uint64)
    shape = _UPPER[data[start]].astype(np.uint64)
    for part, size in (((upper >= 2) & (upper + punct + digit == length), 2), (np.minimum(punct, 4), 5), (np.minimum(digit, 3), 4), (np.minimum(np.log2(length + 1).astype(int), 7), 8), (same, 2)):
        shape = shape * U(size) + part.astype(np.uint64)
    shape = mix(shape * U(256) + last + U(1))
    out = np.empty((KINDS, len(word)), dtype=np.int32)
    for k, (h, n) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2))):
        g = h
        if n == 2:
            g = mix(h ^ U(0x51))
            g[1:] = np.where(joined[1:], gram_hashes(h, 2), g[1:])
        out[k] = (mix(g + U(k + 1)) >> U(64 - BITS)).astype(np.int32)
    return out, first


def logits(weights: np.ndarray, bias: float, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One for each text; a single one may be of any length and is read in pieces."""
    if len(off) == 2:
        total, n = 0.0, 0
        for piece, skip in pieces(data, SPACED, 2):  # features look back two words
            idx, _ = features(piece, np.array([0, len(piece)]))
            total += float(weights[idx[:, skip:]].sum(dtype=np.float64))
            n += idx.shape[1] - skip
        return np.array([bias + total / max(n, 1)])
    idx, first = features(data, off)
    per_word = weights[idx].sum(axis=0, dtype=np.float64) if idx.shape[1] else np.zeros(0)
    return bias + sums(per_word, first) / np.maximum(np.diff(first), 1)


def ftrl(texts: list[str], y: np.ndarray, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal over sparse mean vectors; returns weights and bias.

    The rows are kept as 32-bit features and counts, slice by slice: the driver holds them all.
    """
    parts = []
    for i in range(0, len(texts), SLICE):
        data, off = text_bytes(pa.array(texts[i : i + SLICE], pa.string()))
        idx, first = features(data, off)
        found = [np.unique(idx[:, a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        at = np.concatenate([[0], np.cumsum([len(u) for u, _ in found])])
        parts.append((np.concatenate([u for u, _ in found]), np.concatenate([c for _, c in found]).astype(np.int32), at, np.maximum(1, np.diff(first))))

    def row(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and their shares of the words, the bias last."""
        u, c, at, words = parts[k // SLICE]
        a, b = at[k % SLICE : k % SLICE + 2]
        return np.append(u[a:b], 1 << BITS), np.append(c[a:b] / words[k % SLICE], 1.0)

    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(seed)
    weight = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
    for _ in range(epochs):
        for k in order.permutation(len(texts)):
            i, x = row(k)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[k]) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most`` rows that may be learnt from, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    wanted = drawn(usable, F.xxhash64("id", F.lit(seed)), most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(wanted), "id").orderBy("id").limit(most).toArrow()  # at most `most` rows
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), dtype=np.float64)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted.

    Null and empty texts score the bias alone.  Without any usable label every score is 0.5.
    Repeated rows score alike; rows with a null id are scored and never learnt from.  Scores
    at the threshold are predicted 1.  Very long texts are read in pieces.  Other columns
    are ignored, whatever their names, but for those of ``keep``, which come along; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    texts, y = labelled(docs, labels, label_col, id_col, text_col, train_rows, 11)
    model = ftrl(texts, y) if len(texts) else (np.zeros(1 << BITS, np.float32), 0.0)
    shared = spark.sparkContext.broadcast(model)  # 1 MB whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in slices(batches, "text"):
            s = 1 / (1 + np.exp(-np.clip(logits(weights, bias, *text_bytes(batch.column("text"))), -30, 30)))
            more = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.round(s, 9)), *map(batch.column, more)], names=["id", "score", *more])

    own = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *own)
    schema = StructType([rows.schema["id"], StructField("score", DoubleType()), *rows.schema.fields[2:]])
    scored = rows.mapInArrow(score, schema)
    out = [F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)]
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *out)
