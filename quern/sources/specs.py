"""The registry of sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourceSpec:
    """One source: where it is, which field holds its text, and its limits."""

    name: str
    path: str = ""
    format: str = "json"
    text_field: str = "text"
    language: str = "ko"
    limits: dict[str, int | None] = field(default_factory=lambda: {"small": None, "full": None})
    min_text_length: int = 0
    max_text_length: int | None = None
    enabled: bool = True
    priority: int = 999
    streaming: bool = False
    filter_field: str | None = None
    filter_value: str | None = None
    fallback_action: str = "skip"
    license_type: str = ""
    commercial_use: bool = False
    description: str = ""

    @staticmethod
    def from_json(entry: dict, language: str = "ko") -> SourceSpec:
        """name, split, description, text_field, limits and min_text_length must be
        there; the rest has defaults."""
        for key in ("name", "split", "description", "text_field", "limits", "min_text_length"):
            if key not in entry:
                raise KeyError(key)
        licence, rule = entry.get("license", {}), entry.get("filter") or {}
        return SourceSpec(
            name=entry["name"], path=entry.get("path", entry["name"]), format=entry.get("format", "json"), text_field=entry["text_field"], language=language, limits=entry["limits"],
            min_text_length=entry["min_text_length"], max_text_length=entry.get("max_text_length"), enabled=entry.get("enabled", True), priority=entry.get("priority", 999),
            streaming=entry.get("streaming", False), filter_field=rule.get("field"), filter_value=rule.get("value"), fallback_action=entry.get("fallback", {}).get("action", "skip"),
            license_type=licence.get("type", ""), commercial_use=licence.get("commercial_use", False), description=entry["description"],
        )


def active(specs: list[SourceSpec]) -> list[SourceSpec]:
    """The enabled ones by priority; equal priorities keep their order."""
    return sorted((s for s in specs if s.enabled), key=lambda s: s.priority)


def registry_frame(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    rows = [(k, s.name, s.description, s.language, s.enabled, s.priority, s.license_type, s.commercial_use) for k, s in enumerate(specs)]
    return spark.createDataFrame(rows, "position int, name string, description string, language string, enabled boolean, priority int, license string, commercial_use boolean")


def active_frame(registry: DataFrame) -> DataFrame:
    """The same on a table of sources."""
    return registry.where(F.coalesce("enabled", F.lit(True))).orderBy(F.coalesce("priority", F.lit(999)), "position")


def listing(registry: DataFrame) -> DataFrame:
    """What there is: name, description, priority, enabled."""
    return registry.select("name", "description", F.coalesce("priority", F.lit(999)).alias("priority"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def license_manifest(registry: DataFrame) -> DataFrame:
    return registry.select("name", "license", "commercial_use")


def commercial_only(df: DataFrame, registry: DataFrame, source: str = "source", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sources that may be used commercially and aren't excluded."""
    allowed = registry.where(F.col("commercial_use") & ~F.col("name").isin(*excluded)).select(F.col("name").alias(source))
    return df.join(allowed, source, "left_semi")
