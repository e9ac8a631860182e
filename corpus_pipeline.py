"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

A filtering stage removes the rows its operator rejects and nothing else.  Operators name
rows by an integer id.  Ids are expected to be unique; rows whose id is null or repeated
get a number of their own for the stage, beyond all ids, so they are judged one by one.
Empty input passes through; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.decontaminate import decontaminate
from lithos.llm.exact_dedup import exact_dedup
from lithos.llm.near_dedup import near_dedup
from lithos.llm.packing import pack_documents
from lithos.llm.quality import score_quality
from lithos.llm.shared import settled, shared_dir
from lithos.tables import table


def _free(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column has it."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column that is the id where that is unique, else a number of the row's own."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = settled(counts.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")))
    if again.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("bigint"))
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    own = F.when(F.col("_again"), F.lit(top + 1).cast("bigint") + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("bigint"))
    whole = F.struct(*docs.columns).alias("_row")
    marked = docs.select(F.col("doc_id"), whole).join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return settled(marked.select("_row.*", own.alias(key)))  # the numbers must stay


def _without(docs: DataFrame, reject) -> DataFrame:
    """docs but for the rows that ``reject`` (numbered docs, name of the number) returns."""
    key = _free(docs, "_number")
    numbered = _numbered(docs, key)
    return numbered.join(reject(numbered, key).select(key), key, "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, in the one pass that scores them."""
    rest = _free(docs, "_rest")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others).alias(rest))
    kept = score_quality(rows, table(spark, sf_dir, "labels"), keep=(rest, "text")).filter("predicted = 1")
    return kept.select(*[F.col("text") if c == "text" else F.col(rest)[c].alias(c) for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, lambda rows, key: exact_dedup(rows, id_col=key).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, by the shingles (four words) and similarity (0.8) of the operator's query."""
    return _without(docs, lambda rows, key: near_dedup(rows, id_col=key, shingle=4).filter("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark's items."""
    bench = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows, key: decontaminate(rows, bench, id_col=key).filter("contaminated"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale-factor folder; the last one's rows."""
    at = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(at)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:  # what the next stage has read and written goes
            fs.delete_dir(f"{root}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
