"""Language identification of web pages by Bayesian evidence fusion.

Per page the log-likelihoods of the visible text under hashed character-trigram models
are combined with three other kinds of evidence:

* the language declared in the markup, by P(declared | language),
* the address suffix (a two-letter part of the path, else the top-level domain), by
  P(suffix | language),
* a prior of the host, smoothed towards its domain, that towards the whole collection.

All of these are grouped counts of the text-only decision over the whole collection, so
what "at" or "mx" tell is learnt, and a page's own decision is taken out of the counts that
judge it.  Host counts are joined back by salted keys, domain counts too, so one host may
hold a third of all pages and one domain a third of all hosts.  Of declared languages and
suffixes the ``VALUES`` most frequent have counts of their own, all others share one.
The trigram models are fitted on at most ``TRAIN_ROWS`` labelled documents per language;
the languages are a parameter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.shared import drawn, rejoin, salts_of, settled
from lithos.llm.textops import LOWER, U, mix, slices, text_bytes

LANGUAGES = ("de", "en", "es", "fr")
TRAIN_ROWS = 300
SLICE = 1 << 20
BITS = 16
#: Trigrams of running text are far from independent; their joint weight is that of so many.
TEMPER = 60.0
#: Counts a child borrows from its parent in the host hierarchy.
BORROW = 5.0
#: Declared languages and suffixes that have counts of their own (a map of some 100 bytes each).
VALUES = 2_000
_OPEN = re.compile(r"<(script|style|nav|title)\b", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "nav", "title")}


def visible(page: str) -> str:
    """The page's text without markup, scripts and navigation, in one pass.

    A comment without an end hides the rest of the page; an element without an end hides
    nothing but its tag; a "<" that no ">" follows is text.
    """
    out, at, without_end = [], 0, set()
    while (lo := page.find("<", at)) >= 0:
        out.append(page[at:lo])
        name = _OPEN.match(page, lo)
        kind = name[1].lower() if name else None
        if page.startswith("<!--", lo):
            end = page.find("-->", lo + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if kind and kind not in without_end:
            if end := _CLOSE[kind].search(page, lo):
                at = end.end()
                continue
            without_end.add(kind)
        end = page.find(">", lo)
        if end < 0:
            out[-1] += page[lo:]
            at = len(page)
        else:
            at = end + 1
    out.append(page[at:])
    return " ".join(html.unescape(" ".join(out)).split())


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts, and each text's first (len + 1); none span two texts."""
    d = LOWER[data].astype(np.uint64)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    g = mix(d[at] | d[at + 1] << U(8) | d[at + 2] << U(16)) >> U(64 - BITS)
    return g.astype(np.int64), np.searchsorted(at, off)


def fit(texts: list[str], langs: list[str], languages: tuple[str, ...]) -> np.ndarray:
    """languages x buckets log probabilities, with add-half smoothing."""
    counts = np.full((len(languages), 1 << BITS), 0.5)
    for i in range(0, len(texts), 256):
        g, first = trigrams(*text_bytes(pa.array(texts[i : i + 256], pa.string())))
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            counts[languages.index(langs[i + k])] += np.bincount(g[a:b], minlength=1 << BITS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(shared, languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "html", SLICE):
            if part.num_rows:
                texts = pa.array([visible(x or "") for x in part.column("html").to_pylist()], pa.string())
                g, first = trigrams(*text_bytes(texts))
                n = np.diff(first)
                out = np.zeros((part.num_rows, len(languages)))
                for k in range(len(languages)):
                    c = np.concatenate([[0.0], np.cumsum(model[k][g], dtype=np.float64)])
                    out[:, k] = (c[first[1:]] - c[first[:-1]]) / np.maximum(1, n) * np.minimum(n, TEMPER)
                out -= out.max(axis=1, keepdims=True, initial=-np.inf) if len(out) else 0
                cols = [part.column("page"), part.column("url"), part.column("declared"), pa.array(out.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page", "url", "declared", "ll", "n"])

    return run


def identify(
    pages: DataFrame, docs: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    languages: tuple[str, ...] = LANGUAGES, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per page: page_col, host, declared, suffix, text_lang, lang, confidence.

    text_lang is the text-only decision, null for pages without text; such pages rest on
    the other evidence and the priors.  Null html and url are empty; a page that declares
    nothing has "", values beyond the most frequent are "other".  Repeated pages and null
    ids count and score like any.  Of languages that are equally likely the first of
    ``languages`` is taken.  A page of any length is one unit of a task's memory.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    usable = docs.filter(F.col(lang_col).isin(*languages) & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sample = None
    for k in languages:  # a bounded number of each language, chosen by ids alone
        part = drawn(usable.filter(F.col(lang_col) == k).select(F.col(id_col).alias("id")), F.xxhash64("id"), train_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sample = texts.join(F.broadcast(sample), "id").orderBy("id", "lang").limit(train_rows * len(languages))
    got = sample.toArrow()
    shared = spark.sparkContext.broadcast(fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), languages))

    markup, url = F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    declared = F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{1,8})""", 1))
    rows = pages.select(F.col(page_col).alias("page"), url.alias("url"), declared.alias("declared"), markup.alias("html"))
    kind = rows.schema["page"].dataType.simpleString()
    seen = rows.mapInArrow(_likelihoods(shared, languages), f"page {kind}, url string, declared string, ll array<double>, n bigint")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split("host", r"\.")
    path = F.lower(F.regexp_extract("url", r"://[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    seen = seen.withColumn("host", host).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
    seen = seen.withColumn("suffix", F.when(F.length(path) > 0, path).otherwise(F.element_at(labels, -1)))
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    seen = settled(seen.select("page", "host", "domain", "declared", "suffix", "ll", F.when(F.col("n") > 0, best).alias("k")))

    every = range(len(languages))
    hits = F.array(*[F.count(F.when(F.col("k") == i, 1)).cast("double") for i in every])
    total = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in every])
    # Host counts first, combined over salts; domains and the whole add them up.
    salts = salts_of(pages)
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)))
    merged = salted.groupBy("host", "domain", "salt").agg(hits.alias("c"))
    hosts = settled(merged.groupBy("host", "domain").agg(total("c").alias("by_host"), F.collect_list("salt").alias("salts")))
    dealt = hosts.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(salts)))
    domains = dealt.groupBy("domain", "salt").agg(total("by_host").alias("c"))
    domains = settled(domains.groupBy("domain").agg(total("c").alias("by_domain"), F.collect_list("salt").alias("salts")))
    whole = [float(x or 0) for x in domains.agg(total("by_domain")).first()[0]]
    hosts = rejoin(dealt.withColumnRenamed("salts", "pages_salts"), domains, ["domain"]).select("host", "by_host", "by_domain", F.col("pages_salts").alias("salts"))

    own = lambda i: F.when(F.col("k") == i, 1.0).otherwise(0.0)
    some = F.when(F.col("k").isNull(), 0.0).otherwise(1.0)
    sum_of = lambda c: sum((F.col(c)[i] for i in every), F.lit(0.0))
    n_all = float(sum(whole))

    def prior(i: int):
        """P(language) on the host by the other pages' decisions."""
        p = (F.lit(whole[i]) - own(i) + 1.0) / (F.lit(n_all) - some + float(len(languages)))
        for level in ("by_domain", "by_host"):
            p = (F.col(level)[i] - own(i) + BORROW * p) / (sum_of(level) - some + BORROW)
        return p

    def evidence(column: str):
        """(the value or "other", log P(value | language) by the other pages' decisions, drawn towards P(value))."""
        counts = seen.groupBy(column).agg(hits.alias("c"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(VALUES)
        found = {r[column]: [float(x) for x in r["c"]] for r in counts.collect()}  # at most VALUES rows
        rest = [whole[i] - sum(c[i] for c in found.values()) for i in every]
        table = F.create_map(*[x for v, c in {**found, "other": rest}.items() for x in (F.lit(v), F.array(*[F.lit(y) for y in c]))])
        value = F.when(F.array_contains(F.array(*[F.lit(v) for v in found]) if found else F.array(F.lit("")), F.col(column)), F.col(column)).otherwise(F.lit("other"))
        share = (sum_of(f"{column}_n") - some + 1.0) / (F.lit(n_all) - some + float(len(found) + 1))
        return value, table, [F.log((F.col(f"{column}_n")[i] - own(i) + BORROW * share) / (F.lit(whole[i]) - own(i) + BORROW)) for i in every]

    fused = rejoin(salted, hosts, ["host"])
    odds = [F.col("ll")[i] + F.log(prior(i)) for i in every]
    for column in ("declared", "suffix"):
        value, table, told = evidence(column)
        fused = fused.withColumn(column, value).withColumn(f"{column}_n", table[F.col(column)])
        odds = [x + y for x, y in zip(odds, told, strict=True)]
    fused = fused.withColumn("log_p", F.array(*odds))
    at = F.array_position("log_p", F.array_max("log_p")).cast("int")
    mass = F.aggregate("log_p", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("log_p")))
    name = F.array(*[F.lit(k) for k in languages])
    return fused.select(
        F.col("page").alias(page_col), "host", "declared", "suffix", F.get(name, F.col("k")).alias("text_lang"), F.element_at(name, at).alias("lang"), F.round(1 / mass, 6).alias("confidence")
    )
