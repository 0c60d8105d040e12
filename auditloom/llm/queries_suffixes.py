"""The query of suffix-array dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.suffixes import dedup
from auditloom.registry import Registry, read


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without byte strings of 400 that start anywhere else."""
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def register(registry: Registry) -> None:
    registry.add("op3_suffix_dedup")(op3_suffix_dedup)
