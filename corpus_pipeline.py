"""The corpus pipeline: documents through five operators of quern.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Table, fresh
from quern.llm.decontamination import decontaminate
from quern.llm.minhash_dedup import deduplicate
from quern.llm.packing import pack
from quern.llm.quality_classifier import classify, train
from quern.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as texts without words; equal texts are judged alike;
    rows of one id are judged each by its text; without usable labels all rows have the
    share of label 1 (a half without any) and stay or go together; an empty table gives an
    empty table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score, verdict = fresh(docs, "score", "verdict")
    model = train(docs, labels)
    return classify(docs, model, score=score, predicted=verdict).where(F.col(verdict) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: a row of the smallest doc_id.

    Null and empty texts are one class; rows without doc_id stay only in classes without
    any; rows alike in id and text are one; rows of one id and different texts are different
    documents; an empty table gives an empty table."""
    return deduplicate(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters covered by a repeated string of 200 bytes go; n_chars follows.

    Every row stays, with an empty text where all of it is repeated (exact copies of 200
    bytes or more, rows that stand twice); texts without removed bytes stay as they are,
    null ones null; a character goes only if all its bytes do; an empty table gives an
    empty table."""
    (repeats,) = fresh(docs, "repeats")
    found = remove_repeats(docs, whole_characters=True, into=repeats)
    unchanged, kept = F.col(repeats)["n_removed"] == 0, F.col(repeats)["kept"]
    changed = found.withColumn("text", F.when(unchanged, F.col("text")).otherwise(kept.cast("string")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(unchanged, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; equal texts go together; an empty benchmark
    lets all stay; an empty table gives an empty table."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left.

    Null and empty texts are one piece, the end mark; rows that stand twice are packed
    twice; an empty table gives an empty table."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: SQL has no trained classifier, signatures or tokenizer; tests/llm hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again.  The written
    tables of the stages but the last stay in the shared folder.  Null and empty texts pass
    all stages as the first of their class, if the classifier keeps them; rows that stand
    twice are one after the second stage; ties are settled there by the smaller doc_id,
    then by a hash of the text; an empty table of documents gives an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = Table(out).read() if k < len(STAGES) - 1 else out
    return docs
