"""Recipes, ingestion and settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh
from . import sinks
from .readers import read_source
from .specs import SourceSpec


def load_recipe(text: str) -> tuple[dict[str, float], list[SourceSpec]]:
    """(share of each language, sources) of a recipe in JSON: one component for each
    language with its datasets; shares by the components' target sizes where the recipe
    names no ratio."""
    recipe = json.loads(text)
    parts = {lang: recipe.get(f"{name}_component", {}) for lang, name in (("ko", "korean"), ("en", "english"))}
    sizes = {k: float(p.get("target_size_gb", 0)) for k, p in parts.items()}
    total = sum(sizes.values())
    given = recipe.get("mixing_ratio", {})
    shares = {k: float(given.get(n, sizes[k] / total if total else 0.5)) for k, n in (("ko", "korean"), ("en", "english"))}
    specs = [
        SourceSpec(d["name"], path=d.get("path", d["name"]), language=lang, priority=d.get("priority", 999), description=d.get("description", ""), license_type=str(d.get("license", "")))
        for lang, p in parts.items() for d in p.get("datasets", [])
    ]
    return shares, specs


def ingest(spark: SparkSession, specs: list[SourceSpec], path: str, mode: str = "full", force: bool = False) -> DataFrame:
    """Writes each source as JSON lines under its name, with its language; returns the
    manifest: source, path, language, files, bytes, written."""
    rows = []
    for spec in specs:
        to = f"{path}/{spec.name.replace('/', '_')}"
        done = sinks.write(read_source(spark, spec, mode), to, format="json", force=force)
        used = sinks.disk_usage(sinks.manifest(spark, to, "part-*")).first()
        rows.append((spec.name, to, spec.language, used["files"], used["bytes"], done))
    return spark.createDataFrame(rows, "source string, path string, language string, files long, bytes long, written boolean")


def merge_weighted(frames: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """The rows of each frame int(weight) times, with its name as source."""
    from ..operators.order import replicate

    def copies(name: str, df: DataFrame, weight: float) -> DataFrame:
        x = fresh(df, "weight", "copy")
        weighted = df.withColumns({"source": F.lit(name), x["weight"]: F.lit(float(weight))})
        return replicate(weighted, x["weight"], x["copy"]).drop(*x.values())

    parts = [copies(name, df, weight) for name, (df, weight) in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@dataclass
class ModelConfig:
    """Settings of a model that reads the corpus."""

    vocab_size: int = 32000
    d_model: int = 768
    n_heads: int = 12
    n_layers: int = 12
    max_seq_len: int = 2048
    learning_rate: float = 1e-4
    batch_size: int = 8
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> ModelConfig:
        return cls(**json.loads(text))


_NEEDED = ("vocab_size", "d_model", "n_heads", "n_layers", "max_seq_len", "learning_rate", "batch_size")
_POSITIVE = ("vocab_size", "learning_rate")


def config_errors(config: dict) -> list[str]:
    """What is missing or out of range."""
    errors = [f"missing: {k}" for k in _NEEDED if k not in config]
    errors += [f"must be positive: {k}" for k in _POSITIVE if k in config and config[k] <= 0]
    if config.get("n_heads") and "d_model" in config and config["d_model"] % config["n_heads"]:
        errors.append("d_model must be a multiple of n_heads")
    return errors


def config_errors_of(settings: DataFrame) -> Column:
    """The same for a table with a row for each run's settings, as one text; a setting that is
    null or has no column is missing.  No errors give an empty text."""
    known = lambda k: F.col(k) if k in settings.columns else F.lit(None).cast("double")
    errors = [F.when(known(k).isNull(), f"missing: {k}") for k in _NEEDED]
    errors += [F.when(known(k) <= 0, f"must be positive: {k}") for k in _POSITIVE]
    errors.append(F.when(known("d_model") % F.nullif(known("n_heads"), F.lit(0)) != 0, "d_model must be a multiple of n_heads"))
    return F.concat_ws("; ", *errors)
