"""Numbers as text, and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_number(n: Column) -> Column:
    out = F.when(n < 1000, n.cast("string"))
    for limit, unit, letter in ((1e6, 1e3, "K"), (1e9, 1e6, "M"), (math.inf, 1e9, "B")):
        text = F.format_string(f"%.1f{letter}", n / F.lit(unit))
        out = out.otherwise(text) if limit == math.inf else out.when(n < limit, text)
    return out


def format_time(seconds: Column) -> Column:
    """Seconds in Korean units."""
    whole = lambda x: F.floor(x).cast("long")
    rest = seconds - F.floor(seconds / 60) * 60
    return (
        F.when(seconds < 60, F.format_string("%.1f초", seconds))
        .when(seconds < 3600, F.format_string("%d분 %.1f초", whole(seconds / 60), rest))
        .otherwise(F.format_string("%d시간 %d분 %.1f초", whole(seconds / 3600), whole((seconds % 3600) / 60), rest))
    )


def cosine_rate(step: Column, warmup: int, total: int) -> Column:
    """Share of the full rate: linear warm-up, then half a cosine."""
    part = (step - warmup) / F.lit(max(1, total - warmup))
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(F.greatest(F.lit(0.0), (F.cos(part * math.pi) + 1) / 2))
