"""Instruction pairs from conversations, and their augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import instruct as I
from ..functions.text import instruction_hash, strip
from ..shared import written
from .order import shuffle_key


def pairs(turns: DataFrame) -> DataFrame:
    """conv_id, instruction, output: the first and second turn, whatever their roles;
    conversations of one turn give none."""
    first = F.min(F.struct("turn", "text")).alias("one")
    ones = turns.groupBy("conv_id").agg(first)
    rest = turns.join(ones, "conv_id").where(F.col("turn") > F.col("one.turn"))
    return rest.groupBy("conv_id").agg(F.first("one.text").alias("instruction"), F.min_by("text", "turn").alias("output")).select("conv_id", strip(F.col("instruction")).alias("instruction"), strip(F.col("output")).alias("output"))


def chat_prompts(turns: DataFrame, entries: int = 5) -> DataFrame:
    """conv_id, prompt: the last entries as alternating lines, then an open reply."""
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("back", F.row_number().over(recent)).where(F.col("back") <= entries)
    line = F.when(F.col("role") == "user", F.concat(F.lit("사용자: "), "text")).otherwise(F.concat(F.lit("봇: "), "text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return kept.groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n봇: ")).alias("prompt"))


def augmentation_need(counts: DataFrame, target: int, ratios: dict[str, float]) -> DataFrame:
    """language, needed: max(0, int(target * ratio) - rows)."""
    wanted = F.when(F.col("language") == "ko", int(target * ratios["ko"])).otherwise(int(target * ratios["en"]))
    return counts.select("language", F.greatest(F.lit(0), wanted - F.col("n")).cast("long").alias("needed"))


def candidates(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """All variants of all rows: key, method, instruction, input, output, language,
    source; those that a method can't make are left out."""
    text, language, by = F.col("instruction"), F.col("language"), F.col(key).cast("string")
    made = {
        "paraphrase": I.paraphrase(text, language),
        "context": I.with_context(text, language, by),
        "formality": I.change_formality(text, language),
        "examples": I.with_examples(text, language, by),
    }
    variants = F.array(*[F.struct(F.lit(m).alias("method"), v.alias("instruction"), F.lit(I.SUFFIXES[m]).alias("suffix")) for m, v in made.items()])
    exploded = rows.select(key, "input", "output", "language", "source", F.explode(variants).alias("v"))
    return exploded.where("v.instruction IS NOT NULL").select(key, "v.method", "v.instruction", "input", "output", "language", F.concat("source", "v.suffix").alias("source"))


def augment(rows: DataFrame, needed: Column, key: str = "conv_id", seed: int = 42) -> DataFrame:
    """`needed` (by language) variants that equal no row and no other variant, in
    shuffled order: as many as there are, where the walk at random gave up earlier."""
    from .order import first_rows

    h = instruction_hash(F.col("instruction"), F.col("input"), F.col("output"))
    unseen = candidates(rows, key).withColumn("h", h).join(rows.select(h.alias("h")).distinct(), "h", "left_anti")
    order = shuffle_key(seed, F.concat_ws("/", F.col(key).cast("string"), "method"))
    one = unseen.withColumn("__order", order).groupBy("h").agg(F.min_by(F.struct(*unseen.columns, "__order"), "__order").alias("r")).select("r.*")
    # the variants are made once, and read thrice
    return first_rows(written(one), ["language"], F.col("__order"), 32, lambda total, every: needed, "__first").where("__first").drop("__first", "__order", "h")
