"""The query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import fingerprints
from auditloom.registry import Registry, read


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents and its edited text, with their fingerprints and how alike they are."""
    return fingerprints.compared(read(spark, sf_dir, "documents").select("doc_id", "text"))


def register(registry: Registry) -> None:
    registry.add("op13_fingerprints")(op13_fingerprints)
