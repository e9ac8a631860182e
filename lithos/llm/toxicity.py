"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the hashed embeddings of the lower-cased word and of its
leading 3, 4, 5 and 6 bytes, so inflected and unseen forms share what they have in
common.  Filters of widths 1, 2 and 3 run over the words, each is max-pooled over the
whole text, and a logistic layer reads the pooled values.  Training (numpy, Adam) uses a
bounded, documented sample (``TRAIN_ROWS``, half of them toxic at most); scoring covers
every whole text.

The logit cut-off is calibrated per language on rows kept aside from training and folded
into the score, so that 0.5 is the calibrated threshold in every language.  The language
is estimated from the text's own function words, never read from a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.quality import held_out
from lithos.llm.shared import drawn
from lithos.llm.textops import ALNUM, LOWER, U, hash_spans, mix, pieces, slices, sums, text_bytes, word_spans

#: Most labelled rows a model is fitted on, and the share of them kept aside for calibration.
TRAIN_ROWS = 4000
ASIDE = 0.2
BITS, DIM, FILTERS, WIDTHS = 14, 12, 8, (1, 2, 3)
PIECES = (0, 3, 4, 5, 6)  # 0: the whole word

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to that is was with for",
    "fr": "le la les des et du une qui dans",
    "de": "der die und den das nicht von mit ist",
    "es": "el los las que y por una para del",
}


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), end - [len(r) for r in raw], end)


#: Bytes of words before lower-casing.
_WORDY = ALNUM[LOWER]
_FUNCTION = [np.sort(_hash_words(w.split())) for w in FUNCTION_WORDS.values()]


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PIECES x words embedding rows, each document's first word, each document's language (-1: unknown)."""
    out, first, counts = rows_of(data, off)
    return out, first, language_of(counts)


def language_of(counts: np.ndarray) -> np.ndarray:
    """The language with the most function words; -1 if there are none."""
    return np.where(counts.max(axis=0, initial=0) > 0, counts.argmax(axis=0), -1) if counts.shape[1] else np.zeros(0, int)


def rows_of(data: np.ndarray, off: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PIECES x words embedding rows, each document's first word, languages x documents counts of function words.

    The first ``skip`` words of the first document are not counted.
    """
    data = LOWER[data]
    start, end, first = word_spans(data, off, ALNUM)
    out = np.empty((len(PIECES), len(start)), np.int32)
    counts = np.zeros((len(_FUNCTION), len(off) - 1), np.int64)
    for k, n in enumerate(PIECES):
        h = hash_spans(data, start, np.minimum(end, start + n) if n else end)
        if not n:
            for lang, known in enumerate(_FUNCTION):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = (known[at] == h).astype(np.int64)
                hit[:skip] = 0
                counts[lang] = sums(hit, first)
        out[k] = (mix(h + U(k)) >> U(64 - BITS)).astype(np.int32) + (k << BITS)
    return out, first, counts


class Network:
    """Embeddings, filters and output layer; forward() keeps what backward() needs."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.1, (len(PIECES) << BITS, DIM)), "o": r.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.full(1, -1.0)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 0.5 / np.sqrt(w), (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def pooled(self, idx: np.ndarray, first: np.ndarray, lead: int = 0) -> tuple[np.ndarray, dict]:
        """documents x (WIDTHS * FILTERS) maxima, and the words they come from.

        Each document is preceded by max(WIDTHS)-1 blank words, so short and empty texts pool
        too; the first ``lead`` places of each are left out.
        """
        docs, pad = len(first) - 1, max(WIDTHS) - 1
        n = np.diff(first)
        x = np.zeros((idx.shape[1] + pad * (docs + 1), DIM), np.float32)
        rows = np.arange(idx.shape[1]) + pad * (1 + np.repeat(np.arange(docs), n))
        v = self.p["e"][idx[0]]
        for one in idx[1:]:
            v += self.p["e"][one]
        x[rows] = v
        lo = first[:-1] + pad * np.arange(docs) + lead
        out, at = np.empty((docs, len(WIDTHS) * FILTERS), np.float32), np.empty((docs, len(WIDTHS) * FILTERS), np.int64)
        for j, w in enumerate(WIDTHS):
            m = len(x) - w + 1
            c = self.p[f"w{w}"][:DIM].T @ x[:m].T
            for i in range(1, w):
                c += self.p[f"w{w}"][i * DIM : (i + 1) * DIM].T @ x[i : i + m].T
            c += self.p[f"b{w}"][:, None]
            part = slice(j * FILTERS, (j + 1) * FILTERS)
            # Blocks start at a document's blanks; the filter may not reach past its last word.
            hi = np.minimum(np.maximum(lo - lead + pad + np.maximum(n, 1) - w + 1, lo + 1), m)
            edges = np.stack([lo, hi], axis=1).ravel()
            edges[1::2] = np.minimum(edges[1::2], m - 1)
            out[:, part] = np.maximum.reduceat(c, edges, axis=1)[:, ::2].T if docs else 0
            at[:, part] = 0
            if self.training:
                for d in range(docs):
                    at[d, part] = lo[d] + c[:, lo[d] : max(lo[d] + 1, edges[2 * d + 1])].argmax(axis=1)
        return out, {"x": x, "at": at, "rows": rows, "idx": idx}

    training = False

    def logits(self, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
        out, self.kept = self.pooled(idx, first)
        self.act = np.maximum(out, 0)
        return self.act @ self.p["o"] + self.p["c"][0]

    def logit_of_long(self, data: np.ndarray) -> tuple[float, int]:
        """The logit and language of one text of any length, pooled over overlapping pieces."""
        pad = max(WIDTHS) - 1
        best, counts = None, 0
        for piece, skip in pieces(data, _WORDY, pad):
            idx, first, found = rows_of(piece, np.array([0, len(piece)]), skip)
            counts = counts + found
            if skip and idx.shape[1] == skip:  # no word of its own
                continue
            out, _ = self.pooled(idx, first, pad if skip == pad else 0)  # fewer: the piece begins with the text
            best = out if best is None else np.maximum(best, out)
        return float((np.maximum(best, 0) @ self.p["o"] + self.p["c"][0])[0]), int(language_of(counts)[0])

    def step(self, idx: np.ndarray, first: np.ndarray, y: np.ndarray, rate: float) -> None:
        z = self.logits(idx, first)
        d = ((1 / (1 + np.exp(-z))) - y).astype(np.float32) / len(y)
        g = {"o": self.act.T @ d, "c": d.sum(keepdims=True)}
        back = d[:, None] * self.p["o"] * (self.act > 0)
        x, at = self.kept["x"], self.kept["at"]
        dx = np.zeros_like(x)
        for j, w in enumerate(WIDTHS):
            b, a = back[:, j * FILTERS : (j + 1) * FILTERS], at[:, j * FILTERS : (j + 1) * FILTERS]
            gw = np.zeros_like(self.p[f"w{w}"])
            for i in range(w):
                gw[i * DIM : (i + 1) * DIM] = np.einsum("df,dfk->kf", b, x[a + i])
                np.add.at(dx, a + i, b[:, :, None] * self.p[f"w{w}"][i * DIM : (i + 1) * DIM].T[None])
            g[f"w{w}"], g[f"b{w}"] = gw, b.sum(axis=0)
        hot = np.flatnonzero(np.abs(dx[self.kept["rows"]]).sum(axis=1))
        touched = idx[:, hot].ravel()
        self.t += 1
        u, inverse = np.unique(touched, return_inverse=True)
        ge = np.zeros((len(u), DIM), np.float32)
        np.add.at(ge, inverse, np.tile(dx[self.kept["rows"]][hot], (len(PIECES), 1)))
        self._adam("e", ge, rate, u)
        for k, v in g.items():
            self._adam(k, v, rate, slice(None))

    def _adam(self, k: str, g: np.ndarray, rate: float, at) -> None:
        self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
        self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * g * g
        self.p[k][at] -= rate * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)


def train(texts: list[str], y: np.ndarray, epochs: int = 4, batch: int = 16, rate: float = 0.01, seed: int = 3) -> tuple[dict, np.ndarray]:
    """Parameters, and the calibrated logit cut-off of each language (last: unknown)."""
    order = np.random.default_rng(seed)
    net = Network()
    docs = []
    for i in range(0, len(texts), 256):
        idx, first, lang = encode(*text_bytes(pa.array(texts[i : i + 256], pa.string())))
        docs += [(idx[:, a:b], int(g)) for a, b, g in zip(first[:-1], first[1:], lang, strict=True)]
    perm = order.permutation(len(docs))
    aside, use = np.split(perm, [int(len(docs) * ASIDE)])
    put = lambda ks: (np.concatenate([docs[k][0] for k in ks], axis=1), np.concatenate([[0], np.cumsum([docs[k][0].shape[1] for k in ks])]))
    net.training = True
    for e in range(epochs):
        use = order.permutation(use)
        for i in range(0, len(use), batch):
            ks = use[i : i + batch]
            net.step(*put(ks), y[ks].astype(np.float32), rate / (1 + e))
    net.training = False
    cuts = np.zeros(len(FUNCTION_WORDS) + 1)
    if len(aside):
        z = np.concatenate([net.logits(*put(aside[i : i + 64])) for i in range(0, len(aside), 64)])
        g = np.array([docs[k][1] for k in aside])
        for lang in range(len(cuts)):
            own = (g == lang) if lang < len(FUNCTION_WORDS) else np.ones(len(g), bool)
            cuts[lang] = cutoff(z[own], y[aside][own], cuts[-1])
    return net.p, cuts


def cutoff(z: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """The middle of the gap between neighbouring logits with the best F1; too few rows: as given."""
    if (y == 1).sum() < 5 or (y == 0).sum() < 5:
        return otherwise
    order = np.argsort(-z)
    z, hit = z[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + hit[-1])
    k = int(f1.argmax())
    return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)


def labelled_halves(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> tuple[list[str], np.ndarray]:
    """At most ``most`` rows that may be learnt from, positives first up to half of them."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    part = lambda y, n: drawn(own.filter(F.col("y") == y), F.xxhash64("id", F.lit(23)), n)
    wanted = part(1, most // 2).unionByName(part(0, most - most // 2))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(wanted), "id").orderBy("id").limit(most).toArrow()  # at most `most` rows
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), dtype=np.float64)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted.

    Null and empty texts pool blank words only.  Without usable labels, or with labels of
    one class, every score is 0.  Repeated rows score alike; rows with a null id are scored
    and never learnt from.  Scores at the threshold are predicted 1.  Very long texts are
    pooled over overlapping pieces.  Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    texts, y = labelled_halves(docs, labels, label_col, id_col, text_col, train_rows)
    model = train(texts, y) if len(set(y)) == 2 else None
    shared = spark.sparkContext.broadcast(model)  # 4 MB whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        if shared.value is not None:
            net, cuts = Network.__new__(Network), shared.value[1]
            net.p = shared.value[0]
        for batch in slices(batches, "text", 1 << 19):
            s = np.zeros(batch.num_rows)
            if net is not None:
                data, off = text_bytes(batch.column("text"))
                if len(off) == 2:
                    z, lang = (np.array([x]) for x in net.logit_of_long(data))
                else:
                    idx, first, lang = encode(data, off)
                    z = net.logits(idx, first)
                s = 1 / (1 + np.exp(-np.clip(z - cuts[lang], -30, 30)))
            # Rounded: float32 sums differ a little with a row's place in its batch.
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.round(s, 6), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
