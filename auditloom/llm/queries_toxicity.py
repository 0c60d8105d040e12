"""The query of toxicity scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import toxicity
from auditloom.registry import Registry, read


def held_out(key: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """A model learned from the labelled rows of docs that aren't held out."""
    labels = read(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.fit(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, model_of(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_windows_hit")


def register(registry: Registry) -> None:
    registry.add("op10_toxicity")(op10_toxicity)
