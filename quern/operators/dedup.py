"""Exact dedup that keeps the first row of a key.

The first row is found by min_by with map-side combination, so a key that holds a
third of all rows is reduced before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[Column], order: list[str], copies: str | None = None) -> DataFrame:
    """The first row of each key by `order`; copies: how many rows it stands for."""
    keyed = df.select(*[k.alias(f"__k{i}") for i, k in enumerate(key)], F.struct(*order).alias("__order"), F.struct("*").alias("__row"))
    found = keyed.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.min_by("__row", "__order").alias("__row"), F.count("*").alias("__n"))
    return found.select(*[F.col("__row")[c].alias(c) for c in df.columns], *([F.col("__n").alias(copies)] if copies else []))


def duplicate_statistics(df: DataFrame, key: Column, group: str) -> DataFrame:
    """group, seen, unique, removed.  Counted in two steps, so that no task holds
    one group's keys."""
    per_key = df.select(F.col(group), key.alias("__k")).groupBy(group, "__k").agg(F.count("*").alias("n"))
    return per_key.groupBy(group).agg(F.sum("n").alias("seen"), F.count("*").alias("unique"), (F.sum("n") - F.count("*")).alias("removed"))
