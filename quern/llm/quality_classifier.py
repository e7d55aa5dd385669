"""Quality classifier: a factorization machine over hashed words, structure
statistics of the text, and its length as metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factorization import Model, Settings, held_out, learn, scored

SETTINGS = Settings(buckets=1 << 14, epochs=8, seed=11)
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Learned from labels (doc_id, quality) by the rules of factorization.learn: held-out
    rows, null labels and labels without a document teach nothing; an empty table, or
    one class only, gives a constant model."""
    return learn(docs, labels, "quality", settings, structure=True)


def classify(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Every row of docs with a score (0 to 1, higher: label 1 likelier) and the prediction.

    Null and empty texts get the score of a text without words; equal texts score
    equal; other columns stay and are no inputs; an empty table gives an empty
    table."""
    return scored(docs, model, text=text, into=score).withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
