import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithos.llm.quality import features, ftrl, score_quality
from lithos.llm.textops import text_bytes
from lithos.llm.toxicity import score_toxicity


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture
def corpus(spark, frame):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for k in range(500):
        words = [word() for _ in range(r.randint(20, 80))]
        good, toxic = k % 5 != 0, k % 7 == 0
        if not good:
            words = [x for w in words[:12] for x in [w] * 6]
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = "zqux" + word()
        rows.append((k, ("the of and " if k % 2 else "der und die ") + " ".join(words)))
        labels.append((k, int(good), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "z" * 100_000), (None, "no id"), (3, rows[3][1])]
    labels += [(2000, 1, 0), (None, 1, 1), (4, None, None)]
    return frame(rows).withColumn("score", F.lit("clash")).withColumn("label", F.lit(3)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (q, t) for k, q, t in labels if k is not None}


@pytest.mark.parametrize("score,column,least", [(score_quality, 0, 0.3), (score_toxicity, 1, 0.5)])
def test_classifier(corpus, score, column, least):
    docs, labels, truth = corpus
    got = score(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)
    test = [r for r in got if r.held_out and truth.get(r.doc_id, (None, None))[column] is not None]
    assert len(test) > 50
    right = sum(r.predicted == truth[r.doc_id][column] for r in test)
    assert right / len(test) > 0.93
    assert len({r.score for r in got if r.doc_id == 3}) == 1  # repeated rows


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_without_labels_or_rows(corpus, score):
    docs, labels, _ = corpus
    assert score(docs.limit(3), labels.limit(0)).count() == 3
    assert score(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learnt(corpus):
    """Turning every held-out label around changes no score."""
    docs, labels, _ = corpus
    held_ids = [i for i in range(500) if held(i)]
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held_ids), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r.doc_id or -1, round(r.score, 9)) for r in df.collect())
    assert key(score_quality(docs, labels)) == key(score_quality(docs, turned))


@pytest.mark.parametrize("most", [1, 7, 60, 10_000])
def test_long_texts_in_pieces(monkeypatch, most):
    """Pieces of any size give what the whole text gives."""
    from lithos.llm import quality, textops, toxicity

    r = random.Random(2)
    words = ["the", "der", "Naïve", "x" * 30, "zq.ux", "12", "a", "--", "UPPER"]
    net, weights = toxicity.Network(), np.random.default_rng(1).normal(0, 1, 1 << quality.BITS).astype(np.float32)
    real = textops.pieces
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "pieces", lambda data, kind, overlap: real(data, kind, overlap, most))
    for k in range(40):
        raw = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 50, 300]))).encode()
        data = np.frombuffer(raw, np.uint8)
        two = np.concatenate([data, data]), np.array([0, len(data), 2 * len(data)])
        assert np.allclose(quality.logits(weights, 0.5, data, np.array([0, len(data)])), quality.logits(weights, 0.5, *two)[0])
        idx, first, lang = toxicity.encode(*two)
        z, own = net.logit_of_long(data)
        assert np.isclose(z, net.logits(idx, first)[0], atol=1e-5) and own == lang[0], (k, raw)


def test_pieces_part_no_word():
    from lithos.llm.textops import SPACED, pieces

    data = np.frombuffer(b"one two  three four " + b"x" * 50 + b" five", np.uint8)
    for most in (1, 5, 200):
        words = []
        for piece, skip in pieces(data, SPACED, 2, most):
            own = piece.tobytes().split()
            assert own[:skip] == words[len(words) - skip :]
            words += own[skip:]
        assert words == data.tobytes().split()


@pytest.mark.parametrize("score,label", [(score_quality, "quality"), (score_toxicity, "toxic")])
def test_one_class_and_very_long_words(frame, spark, score, label):
    docs = frame([(1, "a b"), (2, "w" * 2_000_000 + " " + "v" * 2_000_000), (3, "the " * 700_000)])
    got = score(docs, spark.createDataFrame([(1, 1), (3, 1)], f"doc_id long, {label} int")).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_quality_rows_are_held_in_eight_bytes_a_feature():
    """While a model is fitted, the driver holds features and counts of 32 bits, besides 16 MB for the weights."""
    texts = [" ".join(f"{k}w{i}" for i in range(1000)) for k in range(1200)] + ["", " "]
    idx, first = features(*text_bytes(pa.array(texts[:1])))
    held = 1200 * len(np.unique(idx[:, first[0] : first[1]]))
    tracemalloc.start()
    try:
        weights, _ = ftrl(texts, np.array([k % 2 for k in range(len(texts))], float), epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.isfinite(weights).all()
    assert peak < 10 * held + 16e6, (peak, held)
