"""The three preparation pipelines: corpus, instructions, configured sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.extract import instruction_fields
from ..functions.instruct import classify_task
from ..operators.dedup import keep_first
from ..operators.instructions import augment
from ..operators.metrics import distribution, profile, quality_issues
from ..operators.order import mix_by_ratio, mix_prefix
from ..shared import written
from ..sources import sinks
from ..sources.readers import read_sources
from ..sources.specs import SourceSpec, license_manifest

SUPPORTED = ("ko", "en")


@dataclass(frozen=True)
class PretrainConfig:
    rules: T.DocumentRules = field(default_factory=T.DocumentRules)
    korean_ratio: float = 0.7
    english_ratio: float = 0.3
    target: int | None = None
    seed: int = 42


#: Presets of the mixing ratio.
RECIPES = {"commercial": (0.5, 0.5), "performance": (0.5, 0.5), "korean_focused": (0.7, 0.3), "korean_heavy": (0.8, 0.2)}


def recipe(name: str, **changes) -> PretrainConfig:
    korean, english = RECIPES[name]
    return PretrainConfig(korean_ratio=korean, english_ratio=english, **changes)


def judged(records: DataFrame, rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """Records (text, and if there language) with language and failure."""
    own = T.missing_to_null(F.col("language")) if "language" in records.columns else F.lit(None).cast("string")
    detected = T.detect_language(F.col("text"))
    language = F.coalesce(own, detected) if not detect else detected
    marked = records.withColumn("language", language)
    return marked.withColumn("failure", T.document_failure(F.col("text"), F.col("language"), rules))


def mark(records: DataFrame, rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """All records with language, failure, and the hash of those that pass."""
    return judged(records, rules, detect).withColumn("hash", F.when(F.col("failure").isNull(), T.text_hash(F.col("text"))))


def passing(records: DataFrame, rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """The records that pass, with language and hash; the rules are evaluated once."""
    return judged(records, rules, detect).where("failure IS NULL").drop("failure").withColumn("hash", T.text_hash(F.col("text")))


def clean(records: DataFrame, order: list[str], rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """The records kept: rules passed, first of their hash, language supported; with
    `copies`.  The first of a hash is found before the language is looked at, so an
    unsupported first copy takes the others with it."""
    return keep_first(passing(records, rules, detect), [F.col("hash")], order, "copies").where(F.col("language").isin(*SUPPORTED))


def _firsts(records: DataFrame, order: list[str], rules: T.DocumentRules, detect: bool) -> DataFrame:
    """hash, n, first (its order, language and length): one row for each key that passed,
    and one without hash for all that failed.  One pass; keys and counts are shuffled."""
    marked = mark(records, rules, detect)
    first = F.min(F.struct(*order, "language", F.length("text").alias("length"))).alias("first")
    return marked.groupBy("hash").agg(F.count("*").alias("n"), first)


def counters(records: DataFrame, order: list[str], rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """One row of counters.  Duplicates are counted as copies of kept keys."""
    passed, language = F.col("hash").isNotNull(), F.col("first.language")
    sums = _firsts(records, order, rules, detect).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_processed"), F.count_if(passed & (language == "ko")).alias("korean_texts"),
        F.count_if(passed & (language == "en")).alias("english_texts"), F.coalesce(F.sum(F.when(~passed, F.col("n"))), F.lit(0)).alias("filtered_out"),
        F.coalesce(F.sum(F.when(passed, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
    )
    n = F.col("korean_texts") + F.col("english_texts")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0)), 3)
    return sums.withColumns({"korean_ratio": share("korean_texts"), "english_ratio": share("english_texts")})


def clean_statistics(records: DataFrame, order: list[str], rules: T.DocumentRules = T.DocumentRules(), detect: bool = True) -> DataFrame:
    """language, kept, chars of what clean() keeps, and the counters of the whole run."""
    passed = F.col("hash").isNotNull()
    language = F.when(passed & F.col("first.language").isin(*SUPPORTED), F.col("first.language"))
    by_language = _firsts(records, order, rules, detect).groupBy(language.alias("language")).agg(
        F.count_if(passed).alias("kept"), F.sum(F.col("first.length")).cast("long").alias("chars"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~passed, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(passed, F.col("n") - 1)), F.lit(0)).alias("copies"),
    )
    every = Window.partitionBy(F.lit(0))  # a row for each language at most
    summed = by_language.select(
        "language", "kept", "chars", F.sum("n").over(every).alias("total_processed"), F.sum("failed").over(every).alias("filtered_out"), F.sum("copies").over(every).alias("duplicates_removed")
    )
    return summed.where("language IS NOT NULL")


def pretrain(records: DataFrame, key: str, order: list[str], config: PretrainConfig = PretrainConfig()) -> DataFrame:
    """Clean, then mix by ratio; what is kept is written once, since ranks read it twice."""
    kept = written(clean(records, order, config.rules))
    return mix_by_ratio(kept, key, config.korean_ratio, config.english_ratio, config.target, config.seed)


#: What prepare() writes below its folder: the corpus and the files that describe it.
OUTPUTS = ("corpus", "preprocessing_stats", "language_distribution", "quality_analysis", "license_manifest")


def prepare(records: DataFrame, path: str, key: str, order: list[str], config: PretrainConfig = PretrainConfig(), registry: DataFrame | None = None, stats_only: bool = False, force: bool = False) -> DataFrame:
    """Cleans and mixes the records into path/corpus and writes statistics beside it;
    stats_only leaves the corpus out, force replaces what is there.  Returns outputs()."""
    kept = written(clean(records, order, config.rules))
    if not stats_only:
        mixed = mix_by_ratio(kept, key, config.korean_ratio, config.english_ratio, config.target, config.seed)
        sinks.write_corpus(mixed, f"{path}/corpus", force=force)
    described = {
        "preprocessing_stats": counters(records, order, config.rules),
        "language_distribution": distribution(kept, "language"),
        "quality_analysis": quality_issues(profile(kept, "text", key)),
        "license_manifest": license_manifest(registry) if registry is not None else None,
    }
    for name, frame in described.items():
        if frame is not None:
            sinks.write(frame, f"{path}/{name}", format="json", force=force)
    return outputs(records.sparkSession, path)


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """name, there: which of the outputs a folder has."""
    return spark.createDataFrame([(name, sinks.exists(spark, f"{path}/{name}")) for name in OUTPUTS], "name string, there boolean")


@dataclass(frozen=True)
class InstructionConfig:
    target: int = 100_000
    min_target: int = 50_000
    korean_ratio: float = 0.6
    english_ratio: float = 0.4
    augment: bool = True
    seed: int = 42


def instruction_rows(raw: DataFrame, key: str) -> DataFrame:
    """key, instruction, input, output, language, source, task_category, failure."""
    fields = raw.withColumn("f", instruction_fields(raw)).where("f IS NOT NULL")
    language = F.coalesce("language", F.lit("ko")) if "language" in raw.columns else F.lit("ko")
    rows = fields.select(key, "f.instruction", "f.input", "f.output", language.alias("language"), "source")
    return rows.withColumn("task_category", classify_task(F.col("instruction"))).withColumn("failure", T.instruction_failure(F.col("instruction"), F.col("output")))


def instructions(raw: DataFrame, key: str, config: InstructionConfig = InstructionConfig()) -> DataFrame:
    """Extracted, filtered, without copies, augmented up to the target, mixed.  Of one key
    there may be a row and its variants, told apart by their source."""
    good = instruction_rows(raw, key).where("failure IS NULL").drop("failure")
    h = T.instruction_hash(F.col("instruction"), F.col("input"), F.col("output"))
    rows = written(keep_first(good, [h], ["source", key]))
    if config.augment:
        have = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count("*").alias("n")).where(F.col("language").isin(*SUPPORTED)).collect()}
        need = {k: max(0, int(config.target * r) - have.get(k, 0)) for k, r in (("ko", config.korean_ratio), ("en", config.english_ratio))}
        more = augment(rows, F.when(F.col("language") == "ko", need["ko"]).otherwise(need["en"]), key, config.seed)
        rows = rows.unionByName(more.withColumn("task_category", classify_task(F.col("instruction"))).select(*rows.columns))
    named = written(rows.withColumn("__id", F.concat_ws("/", F.col(key).cast("string"), "source")))
    return mix_by_ratio(named, "__id", config.korean_ratio, config.english_ratio, config.target, config.seed).drop("__id")


def corpus(spark: SparkSession, specs: list[SourceSpec], mode: str = "full", korean: float = 0.7, english: float = 0.3, failed: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Configured sources, first copy by priority within a language, then the first
    share of each language, in order of the texts' hashes; `failed` and `strict` as in read_sources."""
    rows = read_sources(spark, specs, mode, failed=failed, strict=strict).withColumn("hash", T.raw_hash(F.col("text")))
    kept = keep_first(rows, [F.col("language"), F.col("hash")], ["priority", "source", "text"])
    placed = written(kept.withColumn("pos", F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")))
    return mix_prefix(placed, "pos", korean, english)
