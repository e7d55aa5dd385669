"""Counters, profiles and text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_diversity, strip, words
from ..shared import written
from .order import following


def _share(a: Column, b: Column, digits: int = 3) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)


def achievement(counts: DataFrame, n: str, target: int) -> DataFrame:
    return counts.withColumn("achieved", F.col(n) >= target).withColumn("achievement", F.round(F.col(n) * 100.0 / target, 1))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def profile(df: DataFrame, text: str, position: str, sample: int = 100) -> DataFrame:
    """n_docs, and over the first rows by position: avg, min, max length of the
    non-blank texts, and their share in per cent."""
    head = df.orderBy(position).limit(sample).select(text)
    valid = F.length(strip(F.col(text))) > 0
    size = F.when(valid, F.length(text))
    sampled = head.agg(
        F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"), F.coalesce(F.min(size), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_length"), F.coalesce(F.count_if(valid) * 100.0 / F.count("*"), F.lit(0.0)).alias("valid_ratio"),
    ).withColumn("one", F.lit(1))
    return df.agg(F.count("*").alias("n_docs")).withColumn("one", F.lit(1)).join(sampled, "one").drop("one")


def quality_issues(profiled: DataFrame) -> DataFrame:
    """The profile with its issues: texts too short, too few documents, too few valid."""
    issues = F.array_compact(
        F.array(F.when(F.col("avg_length") < 50, "short_texts"), F.when(F.col("n_docs") < 100, "few_documents"), F.when(F.col("valid_ratio") < 80, "invalid_texts"))
    )
    return profiled.withColumn("issues", F.array_join(issues, ","))


def recommendation(n_docs: Column, critical: Column | None = None) -> Column:
    out = F.when(n_docs < 1000, "more_data_recommended").when(n_docs < 10000, "enough_for_tests").otherwise("enough_for_training")
    return out if critical is None else F.when(critical, "download_first").otherwise(out)


def word_metrics(df: DataFrame, text: str) -> DataFrame:
    """avg_words (words a text) and repetition_ratio (mean of 1 - distinct / words over
    texts of more than one word)."""
    n = F.size(words(F.col(text)))
    return df.agg(
        F.round(F.avg(n), 6).alias("avg_words"),
        F.round(F.coalesce(F.avg(F.when(n > 1, 1 - lexical_diversity(F.col(text)))), F.lit(0.0)), 6).alias("repetition_ratio"),
    )


def distinct_bigrams(df: DataFrame, text: str, position: str) -> DataFrame:
    """n_bigrams, n_distinct and their ratio over all texts in a row: bigrams cross from
    one text to the next that has words."""
    spelled = df.select(position, words(F.col(text)).alias("w")).where(F.size("w") > 0)
    # words hold no blanks, so a pair is one string
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    inside = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), pair)
    within = spelled.where(F.size("w") > 1).select(F.explode(inside).alias("g"))
    # two words of each text, as a table: they are bucketed and numbered
    ends = written(spelled.select(position, F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last")))
    across = following(ends, position, "first", "after").where("after IS NOT NULL").select(pair(F.col("last"), F.col("after")).alias("g"))
    counted = within.unionAll(across).groupBy("g").agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bigrams"), F.count("*").alias("n_distinct")).withColumn("ratio", _share(F.col("n_distinct"), F.col("n_bigrams"), 6))


def perplexity(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """exp of the token-weighted mean loss (infinite without tokens), and exp of the
    plain mean."""
    weighted = F.exp(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)))
    return df.agg(F.round(F.coalesce(weighted, F.lit(float("inf"))), 6).alias("perplexity"), F.round(F.exp(F.avg(loss)), 6).alias("batch_perplexity"))


def masked_accuracy(df: DataFrame, predicted: str, target: str, ignored: int = -100) -> DataFrame:
    """Share of the targets, shifted by one and not ignored, that were predicted."""
    pairs = F.arrays_zip(F.slice(F.col(predicted), F.lit(1), F.size(predicted) - 1).alias("p"), F.slice(F.col(target), F.lit(2), F.size(target) - 1).alias("t"))
    counted = F.filter(pairs, lambda x: x["t"] != ignored)
    right = F.size(F.filter(counted, lambda x: x["p"] == x["t"]))
    return df.where(F.size(target) > 1).agg(F.sum(F.size(counted)).alias("n"), F.sum(right).alias("correct")).withColumn("accuracy", _share(F.col("correct"), F.col("n"), 6))


def running_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias("mean"))


def timer_summary(df: DataFrame, name: str, seconds: str) -> DataFrame:
    return df.groupBy(name).agg(
        F.round(F.sum(seconds), 4).alias("total"), F.round(F.avg(seconds), 6).alias("average"), F.count("*").alias("count"), F.min(seconds).alias("min"), F.max(seconds).alias("max")
    )


def benchmark_rates(df: DataFrame, seconds: str, tokens: str) -> DataFrame:
    """Mean time and tokens, and tokens a second as the ratio of the means."""
    return df.agg(
        F.round(F.avg(seconds), 6).alias("avg_time"), F.round(F.avg(tokens), 6).alias("avg_tokens"),
        F.round(F.avg(tokens) / F.avg(seconds), 4).alias("tokens_per_second"), F.min(seconds).alias("min_time"), F.max(seconds).alias("max_time"),
    )


# ---------------------------------------------------------------------- logits


def top_k(df: DataFrame, group: str, logit: str, k: int, tie: str, with_ties: bool = False) -> DataFrame:
    """The k largest of each group; with_ties all that equal the k-th."""
    by = Window.partitionBy(group).orderBy(F.desc(logit), *([] if with_ties else [tie]))
    return df.withColumn("__r", (F.rank() if with_ties else F.row_number()).over(by)).where(F.col("__r") <= k).drop("__r")


def nucleus(df: DataFrame, group: str, logit: str, tie: str, top_p: float) -> DataFrame:
    """Tokens whose predecessors' probability is at most top_p; the first stays."""
    by = Window.partitionBy(group).orderBy(F.desc(logit), tie)
    probability = F.exp(F.col(logit)) / F.sum(F.exp(F.col(logit))).over(Window.partitionBy(group))
    with_p = df.withColumn("__p", probability)
    before = F.coalesce(F.sum("__p").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return with_p.withColumn("__before", before).where(F.col("__before") <= top_p).drop("__p", "__before")


def repetition_penalty(logit: Column, seen: Column, penalty: float) -> Column:
    return F.when(~seen, logit).when(logit < 0, logit * penalty).otherwise(logit / penalty)
