import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithos.llm import substring
from lithos.llm.exact_dedup import exact_dedup
from lithos.llm.near_dedup import SHORT, least_matches, near_dedup
from lithos.llm.shared import components, drawn
from lithos.llm.substring import least, substring_dedup

EDGE = [(1, None), (2, ""), (3, " \n"), (None, "lonely text"), (4, "w" * 200_000), (5, "a b"), (5, "a b"), (6, "a  b"), (7, "A\tb")]


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def exact_by_force(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [None, 1])
def test_exact_dedup(frame, bits):
    """Also with a digest of two values, where the contents alone keep rows apart."""
    r = random.Random(2)
    rows = EDGE + [(100 + k, f"text {r.randint(0, 30)}" if k % 3 else "hot") for k in range(300)]
    weak = {} if bits is None else {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1) < "8"}
    if bits:
        rows = [x for x in rows if x[0] != 5] + [(5, "a b")]
    assert by_id(exact_dedup(frame(rows), salts=4, **weak)) == exact_by_force(rows)


def test_exact_dedup_of_nothing(frame):
    assert exact_dedup(frame([])).count() == 0


def substring_by_force(rows, window):
    seen, out = {}, []
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    for i, w in words.items():
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] != (i, s) for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("slice_bytes,hot,group", [(200, 500_000, 500_000), (1 << 20, 500_000, 60), (1 << 20, 3, 500_000), (200, 0, 60)])
def test_substring_dedup(monkeypatch, frame, slice_bytes, hot, group):
    """In one slice and many, with few and many groups, with prefixes as they are and lengthened."""
    monkeypatch.setattr(substring, "GROUP", group)
    r = random.Random(3)
    shared = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(30)) for _ in range(4)]
    rows = [(k, " ".join(x for _ in range(r.randint(0, 4)) for x in (r.choice(shared), f"own{k} é{r.randint(0, 99)}\n"))) for k in range(60)]
    rows += [(100, "same " * 700), (101, None), (102, ""), (103, "one two"), (104, "x" * 100_000 + " " + shared[0])]
    r.shuffle(rows)
    df = frame(rows).repartition(5)
    assert by_id(substring_dedup(df, window=20, keep_text=True, slice_bytes=slice_bytes, hot=hot)) == sorted(substring_by_force(rows, 20), key=repr)


@pytest.mark.parametrize("window", [1, 2, 3, 7, 8, 13])
def test_nodes_are_the_repeated_strings(window):
    r = np.random.default_rng(4)
    size = r.integers(1, 40, 30)
    word = r.integers(0, 3, size.sum())
    left = np.concatenate([np.arange(n, 0, -1) for n in size])
    at, node = substring.nodes(word, left, window)
    strings = {}
    for i in np.flatnonzero(left >= window):
        strings.setdefault(tuple(word[i : i + window]), set()).add(int(i))
    got = {}
    for i, k in zip(at.tolist(), node.tolist(), strict=True):
        got.setdefault(k, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in strings.values() if len(x) > 1)


def test_substring_hashes_alone_remove_nothing(monkeypatch):
    """Windows of different tasks whose prefixes and paths all collide are told apart by their words."""
    real = substring.gram_hashes
    monkeypatch.setattr(substring, "gram_hashes", lambda h, n: np.full(len(real(h, n)), 7, np.uint64))
    text = lambda k: " ".join(f"d{k}w{j}" for j in range(21))
    tasks = [[(1, text(1))], [(2, text(2))], [(3, text(1))]]

    class none:
        value = np.zeros(0, np.uint64)

    sent = [b for rows in tasks for b in substring._suffixes(20, 1, 1 << 20, none)(iter([pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})]))]
    cuts = [tuple(r.values()) for b in substring._subtrees(20)(iter(sent)) for r in b.to_pylist()]
    assert cuts == [(3, 0, 21)]


def test_substring_hot_string_in_distinct_windows(spark):
    """300,000 documents share four words and no window: nothing goes, and no group grows with them."""
    words = lambda a, b: F.concat_ws(" ", F.transform(F.sequence(F.lit(a), F.lit(b)), lambda j: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"), j.cast("string"))))
    docs = spark.range(300_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", words(0, 9), F.lit("one hot four words"), words(10, 18)))
    assert substring_dedup(docs).agg(F.sum("n_removed"), F.count(F.lit(1))).first()[:] == (0, 300_000)


def test_substring_lengthened_prefix_spreads_a_hot_string():
    """A string shorter than the window in every document: lengthened, its windows are dealt over the groups."""
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(7)] + [f"hot{j}" for j in range(18)] + [f"b{k}x{j}" for j in range(7)])) for k in range(500)]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    census = {}
    for b in substring._census(20, 1 << 20)(iter([batch])):
        for r in b.to_pylist():
            census[r["prefix"]] = census.get(r["prefix"], 0) + r["n"]
    assert sum(census.values()) == 500 * 13

    class hot:
        value = np.sort(np.array([k for k, n in census.items() if n > 100], np.int64).view(np.uint64))

    def largest(longer):
        held = {}
        for b in substring._suffixes(20, 64, 1 << 20, longer)(iter([batch])):
            for r in b.to_pylist():
                held[r["bucket"]] = held.get(r["bucket"], 0) + int(substring._get(r["blob"])[2].sum())
        assert sum(held.values()) == 500 * 13
        return max(held.values())

    class none:
        value = np.zeros(0, np.uint64)

    assert len(hot.value) and largest(hot) < 250 < largest(none)


def test_substring_edges(frame):
    twenty = " ".join(f"w{k}" for k in range(20))
    got = {(r.doc_id, r.n_removed) for r in substring_dedup(frame([(1, twenty), (1, twenty), (2, twenty), (None, twenty)])).collect()}
    assert got == {(1, 0), (2, 20), (None, 0)}
    assert substring_dedup(frame([])).count() == 0


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for n in (1, 2, 5, 17):
        assert least(x, n).tolist() == [min(x[i : i + n]) for i in range(50 - n + 1)]


def near_by_force(rows, size):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def edited(r, words, share):
    return " ".join(w if r.random() > share else f"new{r.randint(0, 10**6)}" for w in words)


def test_near_dedup(frame):
    """Small groups, a large group over the short-list bound, chains, and documents sharing half of their text."""
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 10**6)}"
    rows, k = [], 0
    for size, share in [(2, 0.02), (3, 0.04), (60, 0.012), (40, 0.025), (12, 0.05)]:
        base = [word() for _ in range(150)]
        for _ in range(size):
            rows.append((k, edited(r, base, share)))
            k += 1
    passage = [word() for _ in range(90)]
    for _ in range(40):
        rows.append((k, " ".join(passage + [word() for _ in range(50)])))
        k += 1
    rows += [(1000, None), (1001, ""), (1002, "A b"), (1003, "a  B"), (1004, "a b c"), (1005, "z" * 50_000), (1006, rows[0][1].upper())]
    assert by_id(near_dedup(frame(rows), shingle=4)) == sorted(near_by_force(rows, 4), key=repr)
    assert 40 > SHORT


def test_near_dedup_edges(frame):
    assert near_dedup(frame([])).count() == 0
    got = {tuple(x) for x in near_dedup(frame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "A B c d e")])).collect()}
    assert got == {(None, 1, None, True), (3, 1, 2, False), (2, 1, 2, True)}


def test_thresholds():
    assert least_matches(128, 80) == 79 and least_matches(40, 80) == 19


def test_matches_at_the_link_similarity(monkeypatch):
    """Pairs of exactly 80 % similarity, of five set sizes: none falls under the match threshold."""
    from lithos.llm import near_dedup as module

    r = np.random.default_rng(11)
    missed = total = 0
    for union in (5, 20, 50, 100, 400):
        pairs = 40_000 // union * 5
        g = r.integers(0, 2**63, (pairs, union), dtype=np.int64).view(np.uint64)
        low = (g >> np.uint64(32)).astype(np.uint32)
        shared, alone = union * 4 // 5, union // 5
        in_a = np.arange(union) < shared + alone // 2 + alone % 2
        in_b = (np.arange(union) < shared) | ~in_a
        assert (in_a & in_b).sum() * 100 == 80 * union
        same = np.zeros(pairs, int)
        for k in range(module.COORDINATES):
            h = low * module._A[k] + module._B[k]
            same += h[:, in_a].min(axis=1) == h[:, in_b].min(axis=1)
        missed += int((same < least_matches(module.COORDINATES, 80)).sum())
        total += pairs
    assert total > 40_000 and missed == 0


@pytest.mark.parametrize("blocks", [(2, 4), (512, 4096)])
def test_rest_pass_in_blocks_of_any_size(frame, monkeypatch, blocks):
    """Many texts share a passage of five eighths; some of them are near-duplicates, which the heads of the lists need not show."""
    monkeypatch.setattr("lithos.llm.near_dedup.LEAST_BLOCK", blocks[0])
    monkeypatch.setattr("lithos.llm.near_dedup.MOST_BLOCK", blocks[1])
    r = random.Random(13)
    word = lambda: f"w{r.randint(0, 10**6)}"
    passage = [word() for _ in range(75)]
    rows = []
    for k in range(60):
        own = passage + [word() for _ in range(45)]
        rows.append((k, " ".join(own)))
        if k % 4 == 0:
            rows.append((100 + k, " ".join(own[:-3] + [word() for _ in range(3)])))
    r.shuffle(rows)
    assert by_id(near_dedup(frame(rows), shingle=4)) == sorted(near_by_force(rows, 4), key=repr)


@pytest.mark.parametrize("per_part", [40, 10**6])
def test_components(spark, monkeypatch, per_part):
    """In one task and over many."""
    monkeypatch.setattr("lithos.llm.shared.EDGES_PER_PART", per_part)
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)] + [(5, 5)]
    comp = {}

    def root(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        comp[y] = x
    want = sorted((x, root(x)) for x in comp if x != 5 or any(5 in e and e != (5, 5) for e in edges))
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect())) == want


@pytest.mark.parametrize("most", [5, 50, 5000])
def test_drawn_is_the_least_draws(spark, most):
    df = spark.range(2000)
    draw = F.xxhash64("id")
    want = [r.id for r in df.orderBy(F.shiftrightunsigned(draw, 1), "id").limit(most).collect()]
    assert sorted(r.id for r in drawn(df, draw, most).collect()) == sorted(want)
