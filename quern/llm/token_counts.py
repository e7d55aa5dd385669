"""Exact length histogram of encoded documents, with suffix sums.

Documents are encoded once and aggregated by length; from there on only the
histogram is used.  Running sums over it answer, for every context limit and
exactly, how many documents fit, how many tokens there are, how many remain when
each document is truncated to the limit, and every quantile of the lengths.  The
sums go over blocks of lengths, then within each block, so that no task holds the
whole histogram even when every length occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesnp import pieces
from .common import Table
from .encode import default_path, encoder


def encoded_lengths(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """length, documents: counts of each task's rows, by encoded length."""
    path = tokenizer or default_path()

    def rows(batches):
        encode = encoder(path)
        for batch in pieces(batches, "text"):
            lengths = [len(encode(value)) if value else 0 for value in batch.column("text").to_pylist()]
            length, n = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "documents"])

    return docs.select(F.col(text).alias("text")).mapInArrow(rows, "length long, documents long")


def histogram(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None, block: int = 64) -> DataFrame:
    """One row per encoded length that occurs: length, documents,
    documents_at_least and tokens_at_least (suffix sums, this length included),
    documents_total, tokens_total, truncated_total (tokens left when all documents
    are cut to this length) and quantile (share of documents of at most this
    length).

    Null and empty texts have length 0; repeated rows count each; an empty table
    gives an empty table; other columns are not read."""
    counts = encoded_lengths(docs, text=text, tokenizer=tokenizer).groupBy("length").agg(F.sum("documents").alias("documents"))
    # written once: the sums below read the counts twice, the texts are encoded once
    return suffix_sums(Table(counts).read(), block=block)


def suffix_sums(counts: DataFrame, *, block: int = 64) -> DataFrame:
    """The histogram's sums from (length, documents)."""
    blocked = counts.withColumn("block", F.floor(F.col("length") / block))
    tokens = F.col("length") * F.col("documents")
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    blocks = (
        blocked.groupBy("block").agg(F.sum("documents").alias("d"), F.sum(tokens).alias("t"))
        .select(
            "block",
            (F.sum("d").over(later) - F.col("d")).alias("d_later"),
            (F.sum("t").over(later) - F.col("t")).alias("t_later"),
            F.sum("d").over(whole).alias("documents_total"),
            F.sum("t").over(whole).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = blocked.withColumns({"d_in": F.sum("documents").over(inside), "t_in": F.sum(tokens).over(inside)}).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_later"), F.col("t_in") + F.col("t_later")
    return at_least.select(
        "length", "documents", docs_ge.alias("documents_at_least"), tokens_ge.alias("tokens_at_least"), "documents_total", "tokens_total",
        (F.col("tokens_total") - tokens_ge + docs_ge * F.col("length")).alias("truncated_total"),
        F.round((F.col("documents_total") - docs_ge + F.col("documents")) / F.col("documents_total"), 9).alias("quantile"),
    )


def _exploded(hist: DataFrame, values: list, name: str, answers) -> DataFrame:
    """One pass over the histogram for all values; answers: value -> aggregates."""
    flat = [a.alias(f"x{i}_{k}") for i, v in enumerate(values) for k, a in answers(v).items()]
    rows = [F.struct(F.lit(v).alias(name), *[F.col(f"x{i}_{k}").alias(k) for k in answers(v)]) for i, v in enumerate(values)]
    return hist.agg(*flat).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, documents_over, truncated_total and tokens_lost for any context
    limits, whether or not a document has just that length: each is read off the
    suffix sums of the next longer length that occurs."""

    def answers(v: int) -> dict[str, Column]:
        longer = F.min_by(F.struct("documents_at_least", "tokens_at_least"), F.when(F.col("length") > v, F.col("length")))
        over, tokens = (F.coalesce(longer[c], F.lit(0)) for c in ("documents_at_least", "tokens_at_least"))
        total = F.coalesce(F.max("tokens_total"), F.lit(0))
        return {"documents_over": over, "truncated_total": total - tokens + over * v, "tokens_lost": tokens - over * v}

    return _exploded(hist, [int(x) for x in limits], "limit", answers)


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least that share of the
    documents does not exceed."""
    at_most = F.col("documents_total") - F.col("documents_at_least") + F.col("documents")
    reached = lambda share: at_most >= F.col("documents_total") * F.lit(share)
    return _exploded(hist, [float(s) for s in shares], "share", lambda s: {"length": F.min(F.when(reached(s), F.col("length")))})


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
